"""LLM answer processing (X1-X14), one row per attempt / file, never per call.

The chain for a batch of files: ``request_rows`` (X1) -> ``run_extractor``
(X14, the user's model call, Arrow-batched) -> ``decode_envelopes`` (X2) ->
``json_span`` / ``parse`` (X3/X4) -> ``resolve_attempts`` (X5) -> ``promote``
(X9) -> ``upsert_extractions`` (X12). Everything but X14 is JVM-side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.functions import prompts
from berth.functions.expr import (answer_get, answer_has, answer_ok, bind, dmy_impossible, first_by, last_by,
                                  parse_answer, parse_dmy, with_json_span)
from berth.functions.json_text import quoted
from berth.operators.jobs import classify_error

# Error texts the reference produces on these paths.
MSG_NO_JSON = "No JSON object found in LLM response"
MSG_BAD_JSON = "Unexpected token in JSON"
MSG_NO_DETECTION = "Cannot read properties of undefined (reading 'confidence')"
MSG_BAD_ROW = "Extraction could not be stored"


# X1 -----------------------------------------------------------------------

def base64_plain(c: Column) -> Column:
    """Unchunked base64 (no MIME line breaks), whatever
    ``spark.sql.chunkBase64String.enabled`` says."""
    return F.translate(F.base64(c), "\r\n", "")


def request_rows(work: DataFrame, provider: str | Column, model: str | Column,
                 prompt: str | Column = prompts.EXTRACTION_PROMPT) -> DataFrame:
    """Vision request body per file, in the provider's shape (4096 max tokens).
    ``work`` has ``content`` (binary) and ``mime_type``."""
    p = F.lit(provider) if isinstance(provider, str) else provider
    m = F.lit(model) if isinstance(model, str) else model
    pr = F.lit(prompt) if isinstance(prompt, str) else prompt
    b64 = base64_plain(F.col("content"))
    mime = F.col("mime_type")
    text_part = {"type": F.lit("text"), "text": pr}
    anthropic = F.to_json(F.struct(
        m.alias("model"), F.lit(prompts.MAX_TOKENS).alias("max_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(
            F.struct(F.lit("image").alias("type"),
                     F.struct(F.lit("base64").alias("type"), mime.alias("media_type"),
                              b64.alias("data")).alias("source"),
                     F.lit(None).cast("string").alias("text")),
            F.struct(text_part["type"].alias("type"),
                     F.lit(None).cast("struct<type:string,media_type:string,data:string>").alias("source"),
                     text_part["text"].alias("text"))).alias("content"))).alias("messages")))
    openai = F.to_json(F.struct(
        m.alias("model"), F.lit(prompts.MAX_TOKENS).alias("max_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(
            F.struct(F.lit("image_url").alias("type"),
                     F.struct(F.concat(F.lit("data:"), mime, F.lit(";base64,"), b64).alias("url"))
                     .alias("image_url"),
                     F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("text").alias("type"),
                     F.lit(None).cast("struct<url:string>").alias("image_url"),
                     pr.alias("text"))).alias("content"))).alias("messages")))
    gemini = F.to_json(F.struct(F.array(F.struct(F.array(
        F.struct(F.struct(mime.alias("mime_type"), b64.alias("data")).alias("inline_data"),
                 F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"),
                 pr.alias("text"))).alias("parts"))).alias("contents")))
    body = (F.when(F.lower(p) == "anthropic", anthropic)
             .when(F.lower(p).isin("openai", "groq"), openai)
             .when(F.lower(p) == "gemini", gemini))
    return work.withColumn("provider", F.lower(p)).withColumn("body", body)


def text_request_rows(work: DataFrame, provider: str | Column, model: str | Column, prompt: str = "prompt") -> DataFrame:
    """Text request body per row of prompts (repair, validation), in the
    provider's shape and as compact as JSON.stringify prints it."""
    p = F.lower(F.lit(provider) if isinstance(provider, str) else provider)
    m = F.lit(model) if isinstance(model, str) else model
    text = quoted(F.col(prompt))
    chat = F.concat(F.lit('{"model":'), quoted(m), F.lit(f',"max_tokens":{prompts.MAX_TOKENS},"messages":[{{"role":"user","content":'), text, F.lit("}]}"))
    parts = F.concat(F.lit('{"contents":[{"parts":[{"text":'), text, F.lit("}]}]}"))
    body = F.when(p == "gemini", parts).when(p.isin("anthropic", "openai", "groq"), chat)
    return work.withColumn("provider", p).withColumn("body", body)


# X2 -----------------------------------------------------------------------

ENVELOPE_SCHEMA = (
    "candidates array<struct<content struct<parts array<struct<text string>>>>>, "
    "usageMetadata struct<promptTokenCount bigint, candidatesTokenCount bigint, totalTokenCount bigint>, "
    "content array<struct<text string>>, "
    "choices array<struct<message struct<content string>>>, "
    "usage struct<input_tokens bigint, output_tokens bigint, prompt_tokens bigint, "
    "completion_tokens bigint, total_tokens bigint>")


def decode_envelopes(raw: DataFrame, envelope: str = "envelope", provider: str = "provider") -> DataFrame:
    """Provider answer -> (text, prompt_tokens, completion_tokens, total_tokens).
    Missing text is ``''``; without a usage object all counts are null; the
    anthropic total is in + out (nulls as 0), the others' total as given."""
    e = F.from_json(F.col(envelope), ENVELOPE_SCHEMA)
    p = F.lower(F.col(provider))
    g_text = F.get(F.get(e["candidates"], 0)["content"]["parts"], 0)["text"]
    a_text = F.get(e["content"], 0)["text"]
    o_text = F.get(e["choices"], 0)["message"]["content"]
    text = F.coalesce(F.when(p == "gemini", g_text).when(p == "anthropic", a_text)
                      .when(p.isin("openai", "groq"), o_text), F.lit(""))
    um, u = e["usageMetadata"], e["usage"]
    prompt_t = (F.when(p == "gemini", um["promptTokenCount"]).when(p == "anthropic", u["input_tokens"])
                 .otherwise(u["prompt_tokens"]))
    compl_t = (F.when(p == "gemini", um["candidatesTokenCount"]).when(p == "anthropic", u["output_tokens"])
                .otherwise(u["completion_tokens"]))
    total_t = (F.when(p == "gemini", um["totalTokenCount"])
                .when(p == "anthropic", F.when(u.isNotNull(), F.coalesce(u["input_tokens"], F.lit(0))
                                               + F.coalesce(u["output_tokens"], F.lit(0))))
                .otherwise(u["total_tokens"]))
    return raw.withColumns({"text": text, "prompt_tokens": prompt_t,
                            "completion_tokens": compl_t, "total_tokens": total_t})


# X3 / X4 ------------------------------------------------------------------

def parse_extractions(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``span``, the ``answer`` (VARIANT: the one parse of a text; null
    unless strictly one JSON value) and ``ok``. Members are then taken with
    ``answer_get``; later steps carry the answer instead of parsing again."""
    parsed = bind(with_json_span(df, text, "span"), _parsed=parse_answer("span"))
    return (parsed.withColumn("ok", answer_ok("_parsed"))
            .withColumn("answer", F.when(F.col("ok"), F.col("_parsed"))).drop("_parsed"))


# X5 -----------------------------------------------------------------------

FILE_KEY = ["session_id", "fid"]


def resolve_attempts(attempts: DataFrame, key: list[str] | None = None, carry: tuple[str, ...] = (),
                     keep_answer: bool = True, text: Column | None = None, members: list[str] | None = None) -> DataFrame:
    """Choose the final answer per file (initial / repair / low-confidence retry).

    ``attempts(key..., attempt_no, stage, raw_text, error_message)``. One
    shuffle by the file key (≤ 3 rows each); each stage's latest attempt is
    a max-by aggregate behind it, as combining so few rows first would only
    sort all texts once more. Texts are parsed before it, and only what is
    asked for goes along: the ``answer`` (unless not wanted), or in its place
    the named ``members`` that ``promote`` takes from it; ``raw_text``, or in
    its place ``text``, made of it; not even that if nothing above reads it.
    ``carry`` names columns that are the same in all of a file's attempts. With
    a ``latency_ms`` column the calls' times are summed to
    ``processing_time_ms``."""
    key = key or FILE_KEY
    a = parse_extractions(attempts)
    kept = [] if not keep_answer else ["answer"] if members is None else ["members"]
    spends = ["latency_ms"] if "latency_ms" in attempts.columns else []
    a = a.select(
        *key, *[c for c in carry if c not in key], *spends, "stage", "attempt_no",
        F.struct("error_message", "ok", F.col("span").isNotNull().alias("has_span"),
                 answer_has("answer", "detection").alias("has_det"),
                 answer_get("answer", "detection.confidence").alias("conf")).alias("att"),
        (F.col("raw_text") if text is None else text).alias("raw_text"), *(["answer"] if keep_answer else []))
    if kept == ["members"]:
        a = with_members(a, members)
    a = a.repartition(*key)

    def latest(stage: str, value: str) -> Column:
        # members and variants have no order: the attempt number alone decides,
        # and for all values alike
        return F.max_by(value, F.when(F.col("stage") == stage, F.col("attempt_no")))

    stages = {"i": "INITIAL", "r": "REPAIR", "l": "LOW_CONF_RETRY"}
    spent = [F.sum("latency_ms").cast("long").alias("processing_time_ms")] if spends else []
    g = a.groupBy(*key).agg(
        *[latest(stage, "att").alias(n) for n, stage in stages.items()],
        *[latest(stage, c).alias(f"{n}_{c}") for c in ("raw_text", *kept) for n, stage in stages.items()],
        *[F.min(c).alias(c) for c in carry], *spent)
    more = [*carry, *(["processing_time_ms"] if spent else [])]
    i, r, low = F.col("i"), F.col("r"), F.col("l")
    i_err = i["error_message"].isNotNull()
    use_i = ~i_err & F.coalesce(i["ok"], F.lit(False))
    need_r = ~i_err & ~use_i
    r_err = need_r & r.isNotNull() & r["error_message"].isNotNull()
    r_ok = need_r & ~r_err & F.coalesce(r["ok"], F.lit(False))
    chosen = F.when(use_i, i).when(r_ok, r)
    has_det = F.coalesce(chosen["has_det"], F.lit(False))
    is_low = F.coalesce(chosen["conf"], F.lit("")) == "LOW"
    low_run = chosen.isNotNull() & has_det & is_low
    l_err = low_run & low.isNotNull() & low["error_message"].isNotNull()
    adopt = (low_run & ~l_err & low.isNotNull() & F.coalesce(low["ok"], F.lit(False))
             & F.coalesce(low["has_det"], F.lit(False)) & (F.coalesce(low["conf"], F.lit("")) != "LOW"))
    err = (F.when(i_err, i["error_message"])
            .when(r_err, r["error_message"])
            .when(need_r & r.isNull(), F.lit(MSG_NO_JSON))
            .when(need_r & ~r_ok, F.when(~r["has_span"], F.lit(MSG_NO_JSON))
                  .otherwise(F.lit(MSG_BAD_JSON)))
            .when(~has_det, F.lit(MSG_NO_DETECTION))
            .when(l_err, low["error_message"]))
    stage = F.when(adopt, "LOW_CONF_RETRY").when(use_i, "INITIAL").when(r_ok, "REPAIR")
    raw = (F.when(i_err, F.lit(None))
            .when(adopt, F.col("l_raw_text")).when(use_i, F.col("i_raw_text"))
            .otherwise(F.coalesce("r_raw_text", "i_raw_text")))
    retry = need_r.cast("int") + low_run.cast("int")
    taken = [F.when(adopt, F.col(f"l_{c}")).when(use_i, F.col(f"i_{c}")).when(r_ok, F.col(f"r_{c}")).alias(c) for c in kept]
    out = g.select(*key, err.alias("error_message"), stage.alias("stage"), raw.alias("raw_text"),
                   retry.alias("retry_count"), *more, *taken)
    return (out.withColumn("status", F.when(F.col("error_message").isNull(), "COMPLETE").otherwise("FAILED"))
               .withColumn("stage", F.when(F.col("status") == "COMPLETE", F.col("stage")))
               .withColumn("error_code", F.when(F.col("status") == "FAILED",
                                                classify_error(F.col("error_message")))))


# X6 -----------------------------------------------------------------------

def repair_prompt(raw: Column) -> Column:
    return F.concat(F.lit(prompts.REPAIR_PREFIX), raw, F.lit(prompts.REPAIR_SUFFIX))


def low_confidence_prompt(file_name: Column, mime: Column,
                          original: str = prompts.EXTRACTION_PROMPT) -> Column:
    return F.concat(F.lit(original), F.lit(prompts.LOW_CONF_HEAD), file_name,
                    F.lit(prompts.LOW_CONF_MIME), mime, F.lit(prompts.LOW_CONF_TAIL))


def followup_requests(attempts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Repair prompts for unparseable first answers; hint prompts (file name +
    MIME) for files whose chosen answer is LOW. One parse and one
    ``groupBy(file key)``; each file emits zero, one or two prompt rows."""
    key = key or FILE_KEY
    a = parse_extractions(attempts.where(F.col("stage").isin("INITIAL", "REPAIR")))
    first, sound = F.col("stage") == "INITIAL", F.col("error_message").isNull()
    usable = F.col("ok") & sound
    rows = a.select(
        *key, F.when(first, F.struct("attempt_no", F.when(sound & ~F.col("ok"), F.col("raw_text")).alias("raw_text"),
                                     "ok", "error_message")).alias("i"),
        # the answer a LOW retry follows is the parseable INITIAL, else the REPAIR
        F.when(usable, F.struct("attempt_no", "file_name", "mime_type",
                                answer_get("answer", "detection.confidence").alias("conf"))).alias("c"))
    g = rows.repartition(*key).groupBy(*key).agg(F.max("i").alias("i"), F.min("c").alias("c"))
    repair = F.when(F.col("i").isNotNull() & F.col("i.error_message").isNull() & ~F.col("i.ok"),
                    F.struct(F.lit("REPAIR").alias("kind"),
                             repair_prompt(F.col("i.raw_text")).alias("prompt")))
    low = F.when(F.col("c.conf") == "LOW",
                 F.struct(F.lit("LOW_CONF_RETRY").alias("kind"),
                          low_confidence_prompt(F.col("c.file_name"), F.col("c.mime_type")).alias("prompt")))
    return (g.select(*key, F.explode(F.array(repair, low)).alias("f"))
             .filter(F.col("f").isNotNull()).select(*key, "f.kind", "f.prompt"))


# X7 -----------------------------------------------------------------------

def classify_failures(df: DataFrame, message: str = "error_message") -> DataFrame:
    return df.filter(F.col(message).isNotNull()).withColumn("error_code", classify_error(message))


# X8 / X9 ------------------------------------------------------------------

def stored_flag(c: Column) -> Column:
    """What a boolean column makes of a flag, given bare or quoted; null where
    it would refuse it."""
    on_off = F.lower(F.trim(c))
    return F.when(on_off == "on", F.lit(True)).when(on_off == "off", F.lit(False)).otherwise(c.try_cast("boolean"))


# Stored column -> path in the answer.
PROMOTED = {
    "document_type": "detection.documentType", "document_name": "detection.documentName",
    "category": "detection.category", "applicable_role": "detection.applicableRole",
    "confidence": "detection.confidence", "detection_reason": "detection.detectionReason",
    "holder_name": "holder.fullName", "date_of_birth": "holder.dateOfBirth", "nationality": "holder.nationality",
    "passport_number": "holder.passportNumber", "sirb_number": "holder.sirbNumber", "rank": "holder.rank",
    "fitness_result": "medicalData.fitnessResult", "drug_test_result": "medicalData.drugTestResult",
    "medical_restrictions": "medicalData.restrictions",
    "issuing_authority": "compliance.issuingAuthority", "regulation_reference": "compliance.regulationReference",
    "summary": "summary",
}
FIELDS_TYPE = "array<struct<key string, label string, value string, importance string, status string>>"
FLAGS_TYPE = "array<struct<severity string, message string>>"
# Sections kept whole, whatever they hold.
WHOLE = {"validity": "validity", "compliance": "compliance", "medical_data": "medicalData"}


# Stored columns that are no plain member of the answer.
MADE = ("is_required", "is_expired", "date_of_issue", "date_of_expiry", "fields", "flags")


def with_members(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``answer`` replaced by ``members``: the stored columns ``names``
    (default: all) as one struct, and ``bad``, whether the store would refuse
    the answer. What is used more than once is a column first, made once a row."""
    got = {"required": ("detection.isRequired", "string"), "expired": ("validity.isExpired", "string"),
           "issued": ("validity.dateOfIssue", "string"), "expires": ("validity.dateOfExpiry", "string")}
    df = df.withColumns({f"_{k}": answer_get("answer", *v) for k, v in got.items()})
    df = df.withColumns({"_is_required": stored_flag(F.col("_required")), "_is_expired": stored_flag(F.col("_expired"))})
    missing = [~answer_has("answer", sec) for sec in ("detection", "holder", "validity", "compliance", "medicalData")]
    bad = (reduce(or_, missing) | F.col("_is_expired").isNull() | (F.col("_required").isNotNull() & F.col("_is_required").isNull())
           | dmy_impossible("_issued") | dmy_impossible("_expires"))
    made = {**{n: answer_get("answer", path) for n, path in PROMOTED.items()},
            "is_required": F.col("_is_required"), "is_expired": F.col("_is_expired"),
            "date_of_issue": parse_dmy("_issued"), "date_of_expiry": parse_dmy("_expires"),
            "fields": answer_get("answer", "fields", FIELDS_TYPE), "flags": answer_get("answer", "flags", FLAGS_TYPE),
            **{n: answer_get("answer", path, "variant") for n, path in WHOLE.items()}}
    members = F.struct(bad.alias("bad"), *[c.alias(n) for n, c in made.items() if names is None or n in names])
    return df.withColumn("members", members).drop("answer", "_is_required", "_is_expired", *[f"_{k}" for k in got])


def promote(resolved: DataFrame) -> DataFrame:
    """Flatten the chosen answer to the promoted row. A COMPLETE answer turns
    FAILED/LLM_ERROR when a section the store dereferences is missing,
    ``isExpired`` is null (NOT NULL column), a flag is no boolean, or a date
    is well-formed but impossible. Sections stay whole as VARIANT; nothing is
    parsed here if ``resolved`` still has its ``answer``, and only the columns
    among its ``members`` are made if it has those."""
    if "members" not in resolved.columns:
        if "answer" not in resolved.columns:
            resolved = parse_extractions(resolved).drop("span", "ok")
        resolved = with_members(resolved)
    failed_now = (F.col("status") == "COMPLETE") & F.col("members.bad")
    ok = (F.col("status") == "COMPLETE") & ~failed_now
    made = [n for n in (*PROMOTED, *MADE, *WHOLE) if n in resolved.schema["members"].dataType.names]
    return resolved.select(
        *[col for col in resolved.columns if col not in ("status", "error_code", "error_message", "members")],
        F.when(failed_now, "FAILED").otherwise(F.col("status")).alias("status"),
        F.when(failed_now, "LLM_ERROR").otherwise(F.col("error_code")).alias("error_code"),
        F.when(failed_now, F.lit(MSG_BAD_ROW)).otherwise(F.col("error_message")).alias("error_message"),
        *[F.when(ok, F.col(f"members.{n}")).alias(n) for n in made])


# X10 / X11 ----------------------------------------------------------------

def explode_fields(ext: DataFrame) -> DataFrame:
    return ext.select("id", "session_id", F.posexplode("fields").alias("pos", "f")).select(
        "id", "session_id", "pos", "f.key", "f.label", "f.value", "f.importance",
        F.col("f.status").alias("field_status"))


def explode_flags(ext: DataFrame) -> DataFrame:
    return ext.select("id", "session_id", F.posexplode("flags").alias("pos", "f")).select(
        "id", "session_id", "pos", "f.severity", "f.message")


def search_fields(fields: DataFrame, needle: str) -> DataFrame:
    """Documents with a field value containing ``needle`` (case-insensitive)."""
    return (fields.filter(F.lower("value").contains(needle.lower()))
            .select("id", "session_id").distinct())


# X12 ----------------------------------------------------------------------

IDENTITY = ["id", "file_name", "mime_type", "created_at"]
META = ["status", "error_code", "error_message", "retry_count", "prompt_version", "raw_text"]


def upsert_extractions(current: DataFrame, batch: DataFrame, content: list[str],
                       key: list[str] | None = None, order: str = "version") -> DataFrame:
    """One current row per (session, hash): identity from the FIRST attempt,
    content from the latest COMPLETE attempt, status / error / raw / retry /
    prompt version from the LATEST attempt. A fold, not a MERGE: one shuffle
    by the key and one aggregation behind it, as a key has a row or two. What
    nothing above reads (say the texts) is not shuffled either.

    ``content_version`` (the order value the content came from) is carried in
    the output, so a stored row that is FAILED but keeps older COMPLETE
    content folds correctly again with the next batch."""
    key = key or ["session_id", "file_hash"]
    cols = key + [order] + IDENTITY + META + content

    def prep(df: DataFrame) -> DataFrame:
        if "content_version" not in df.columns:
            df = df.withColumn("content_version",
                               F.when(F.col("status") == "COMPLETE", F.col(order)))
        return df.select(*cols, "content_version")

    u = prep(current).unionByName(prep(batch)).repartition(*key)
    cv = F.col("content_version")
    # identity: a row that already has an id wins, else the earliest attempt
    first = [F.col("id").isNull(), F.col(order)]
    # a struct compares by its members in turn, so the first members alone
    # choose as all do; apart, the others can be left out
    g = u.groupBy(*key).agg(
        first_by(first, F.struct("id")).alias("first"), first_by(first, F.struct(*IDENTITY)).alias("ident"),
        last_by([cv], F.struct(*content, cv.alias("cv")), cv.isNotNull()).alias("body"),
        last_by([order], F.struct(*META[:4])).alias("last"), last_by([order], F.struct(*META)).alias("meta"),
        F.max(order).alias(order))
    new_id = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key]), 256)
    return g.select(*key, order, F.coalesce(F.col("first.id").cast("string"), new_id).alias("id"),
                    *[F.col(f"ident.{c}").alias(c) for c in IDENTITY[1:]],
                    *[F.col(f"body.{c}").alias(c) for c in content],
                    F.col("body.cv").alias("content_version"),
                    *[F.col(f"last.{c}").alias(c) for c in META[:4]],
                    *[F.col(f"meta.{c}").alias(c) for c in META[4:]])


# X13 ----------------------------------------------------------------------

def exact_median(df: DataFrame, group: list[str], value: str, name: str = "p50") -> DataFrame:
    """Exact (linearly interpolated) median per group without gathering a
    group's values: a value histogram (partial aggregation), cumulative
    counts over the distinct values, then the two middle ranks."""
    h = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group).orderBy(value)
    h = (h.withColumn("hi", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
          .withColumn("lo", F.col("hi") - F.col("c")))
    pos = (F.col("n") - 1) / 2.0
    lo_rank, hi_rank = F.floor(pos), F.ceil(pos)
    pick = h.groupBy(*group).agg(
        F.max(F.when((F.col("lo") <= lo_rank) & (lo_rank < F.col("hi")), F.col(value))).alias("v_lo"),
        F.max(F.when((F.col("lo") <= hi_rank) & (hi_rank < F.col("hi")), F.col(value))).alias("v_hi"),
        F.max("n").alias("n"))
    frac = (F.col("n") - 1) / 2.0 - F.floor((F.col("n") - 1) / 2.0)
    return pick.select(*group, (F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo")))
                       .cast("double").alias(name))


def usage_rollup(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, successes, token sums, mean and median latency per provider /
    model / prompt version."""
    by = by or ["provider", "model", "prompt_version"]
    agg = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error_message").isNull()).alias("successes"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"))
    return agg.join(exact_median(calls, by, "latency_ms", "p50_latency_ms"), by, "left")


# X14 ----------------------------------------------------------------------

Extractor = Callable[[bytes, str, str], str]
ATTEMPT_OUT = "raw_text string, error_message string"


def run_extractor(requests: DataFrame, extractor: Extractor, key: list[str],
                  prompt: str = prompts.EXTRACTION_PROMPT, concurrency: int | None = None) -> DataFrame:
    """Call ``extractor(content, mime_type, prompt) -> text`` for every request
    (Arrow batches via ``mapInPandas``); an exception becomes an attempt row
    with ``error_message``. ``concurrency`` bounds parallel calls (the
    reference runs 3 per worker) by the number of partitions."""
    cols = key + ["content", "mime_type"]
    df = requests.select(*cols)
    if concurrency:
        df = df.repartition(concurrency)
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                           for f in df.schema.fields if f.name in key) + ", " + ATTEMPT_OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for content, mime in zip(pdf["content"], pdf["mime_type"]):
                try:
                    texts.append(extractor(bytes(content) if content is not None else b"", mime, prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the error is the data
                    texts.append(None)
                    errors.append(str(e))
            out = pdf[key].copy()
            out["raw_text"] = texts
            out["error_message"] = errors
            yield out

    return df.mapInPandas(run, out_schema)


def stub_extractor(content: bytes, mime: str, prompt: str) -> str:
    """Deterministic stand-in for a model call (tests, fixtures)."""
    n = len(content)
    if n % 13 == 0:
        raise TimeoutError("LLM request timed out after 90000ms")
    conf = "LOW" if n % 2 else "HIGH"
    return '{"detection":{"documentType":"OTHER","confidence":"' + conf + '"},"size":' + str(n) + "}"
