"""Compliance report (R1-R12), deterministic, for every session at once.

Plan shape: COMPLETE rows are scanned once (status filter and column list
reach the Parquet scan); ``session_facts`` computes every per-session quantity
in ONE ``groupBy(session_id)`` whose aggregates are all partial (map-side
combined), so a session with a third of all rows costs one small state per
map task, not one huge task. The required-certificate matrix is applied as an
array literal inside the plan (no join, nothing broadcast that grows). Only
per-document outputs (R5, R6, R10 expired items) touch the per-document rows
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.functions.expr import days_until, first_by, js_string, last_by, urgency
from berth.operators.sessions import complete, health_flags, health_from_flags, role_flags, role_from_flags

DOC_ORDER = ["created_at", "id"]

# Required-certificate matrix of the reference, in its order.
DECK_CERTS = ["COC", "COP_BT", "COP_PSCRB", "COP_AFF", "COP_MEFA", "ECDIS_GENERIC",
              "SIRB", "PASSPORT", "PEME", "DRUG_TEST", "BRM_SSBT", "FLAG_STATE"]
ENGINE_CERTS = ["COC", "COP_BT", "COP_PSCRB", "COP_AFF", "COP_MECA", "ERM",
                "SIRB", "PASSPORT", "PEME", "DRUG_TEST", "FLAG_STATE"]
# Either ECDIS code satisfies an ECDIS requirement.
ECDIS_ALTERNATIVES = ["ECDIS_GENERIC", "ECDIS_TYPE"]
# Codes whose absence is a CRITICAL gap (others are HIGH).
CRITICAL_CODES = ["COC", "SIRB", "PASSPORT", "PEME", "DRUG_TEST"]
PROFILE_FIELDS = [("holder_name", "full_name"), ("date_of_birth", "date_of_birth"),
                  ("nationality", "nationality"), ("passport_number", "passport_number"),
                  ("sirb_number", "sirb_number"), ("rank", "rank")]

BOTH_CERTS = DECK_CERTS + [c for c in ENGINE_CERTS if c not in DECK_CERTS]
MATRIX_CODES = BOTH_CERTS  # every code any role can require


def _arr(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def required_list(role: str | Column) -> Column:
    """R2 as an expression: DECK, ENGINE, BOTH (ordered distinct union); any
    other role falls back to DECK."""
    r = F.col(role) if isinstance(role, str) else role
    return (F.when(r == "ENGINE", _arr(ENGINE_CERTS))
             .when(r == "BOTH", _arr(BOTH_CERTS))
             .otherwise(_arr(DECK_CERTS)))


def _satisfied(types: Column, code: Column) -> Column:
    alt = code.isin(*ECDIS_ALTERNATIVES)
    any_alt = F.exists(types, lambda t: t.isin(*ECDIS_ALTERNATIVES))
    return F.array_contains(types, code) | (alt & any_alt)


def impact(code: Column) -> Column:
    return F.when(code.isin(*CRITICAL_CODES), "CRITICAL").otherwise("HIGH")


# --------------------------------------------------------------------------
# The shared per-session aggregate
# --------------------------------------------------------------------------

def session_facts(ext: DataFrame, as_of: str) -> DataFrame:
    """Everything R1-R11 need per session, in one partial aggregation."""
    c = complete(ext)
    days = days_until("date_of_expiry", as_of)
    deck, engine = role_flags()
    crit, warn = health_flags(as_of)
    flags = F.coalesce(F.col("flags"), F.array())

    def n_flags(sev: str) -> Column:
        return F.sum(F.size(F.filter(flags, lambda f: f["severity"] == sev)))

    aggs = [F.count(F.lit(1)).alias("total")]
    for src, dst in PROFILE_FIELDS:
        v = F.col(src)
        aggs.append(first_by(DOC_ORDER, v, v.isNotNull() & (v != "")).alias(dst))
    aggs += [
        role_from_flags(deck, engine).alias("detected_role"),
        health_from_flags(crit, warn).alias("overall_health"),
        # bounded by the document-type vocabulary, not by the session size
        F.array_sort(F.collect_set("document_type")).alias("types"),
        F.struct(*[F.count_if(F.col("document_type") == code).alias(code)
                   for code in MATRIX_CODES]).alias("type_counts"),
        F.sum(F.size(flags)).alias("flags_total"),
        n_flags("CRITICAL").alias("flags_critical"),
        n_flags("HIGH").alias("flags_high"),
        n_flags("MEDIUM").alias("flags_medium"),
        n_flags("LOW").alias("flags_low"),
        first_by(DOC_ORDER, F.struct("fitness_result", "date_of_expiry", "is_expired",
                                     "medical_restrictions"),
                 F.col("document_type") == "PEME").alias("peme"),
        first_by(DOC_ORDER, F.struct("drug_test_result"),
                 F.col("document_type") == "DRUG_TEST").alias("drug"),
        F.count_if(F.col("date_of_expiry").isNotNull()).alias("timeline_count"),
        F.count_if(days < 0).alias("expired_count"),
    ]
    return c.groupBy("session_id").agg(*aggs)


# What a validation row tells of its call, where the table has it.
VALIDATION_MORE = ("prompt_version", "llm_provider", "llm_model", "summary", "recommendations")


def latest_validation(validations: DataFrame) -> DataFrame:
    """Top-1 per session by (created_at, id) as a max-struct aggregate
    (partial aggregation, no sort, no window). Prompt version, provider,
    model, summary and recommendations come along if the table has them, with
    the time of validation; no recommendations are an empty list."""
    more = [c for c in VALIDATION_MORE if c in validations.columns]
    cols = ["validation_id", "overall_status", "overall_score",
            *[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "recommendations" else F.col(c) for c in more],
            *([F.col("created_at").alias("validated_at")] if more else [])]
    return validations.groupBy("session_id").agg(
        last_by(["created_at", "validation_id"], F.struct(*cols)).alias("v")).select("session_id", "v.*")


def _derive(facts_joined: DataFrame) -> DataFrame:
    """Narrow derivations on (session row ⟕ facts ⟕ latest validation)."""
    z = F.lit(0).cast("long")
    df = facts_joined
    for name in ["total", "flags_total", "flags_critical", "flags_high", "flags_medium",
                 "flags_low", "timeline_count", "expired_count"]:
        df = df.withColumn(name, F.coalesce(F.col(name), z).cast("long"))
    df = (df.withColumn("detected_role", F.coalesce("detected_role", F.lit("N/A")))
            .withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
            .withColumn("required", required_list("detected_role")))
    types = F.col("types")
    df = (df.withColumn("present", F.filter("required", lambda code: _satisfied(types, code)))
            .withColumn("missing", F.filter("required", lambda code: ~_satisfied(types, code)))
            .withColumn("missing_critical",
                        F.filter("missing", lambda code: code.isin(*CRITICAL_CODES))))
    counts = F.col("type_counts")
    in_required = F.aggregate(
        "required", z,
        lambda acc, code: acc + F.coalesce(
            F.element_at(F.map_from_arrays(_arr(MATRIX_CODES),
                                           F.array(*[counts[m] for m in MATRIX_CODES])), code), z))
    df = df.withColumn("additional_count", F.col("total") - in_required)
    fitness = F.when(F.col("peme").isNull(), F.lit("NOT_SUBMITTED")).otherwise(F.col("peme.fitness_result"))
    drug = F.when(F.col("drug").isNull(), F.lit("NOT_SUBMITTED")).otherwise(F.col("drug.drug_test_result"))
    df = (df.withColumn("fitness_result", fitness)
            .withColumn("drug_test_result", drug)
            .withColumn("peme_expiry", F.col("peme.date_of_expiry"))
            .withColumn("peme_expired", F.col("peme.is_expired")))
    b = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    critical_blockers = (F.size("missing_critical").cast("long") + F.col("expired_count")
                         + b(F.col("fitness_result") == "UNFIT"))
    blockers = (critical_blockers
                + b(F.col("drug_test_result") == "POSITIVE")
                + b(F.col("fitness_result") == "NOT_SUBMITTED")
                + b(F.col("drug_test_result") == "NOT_SUBMITTED")
                + b(F.col("flags_critical") > 0))
    penalty = 10 * F.col("flags_high") + 5 * F.col("flags_medium")
    validated = F.col("validation_id").isNotNull()
    status = (F.when(validated, F.col("overall_status"))
               .when(blockers == 0, "LIKELY_APPROVED")
               .when(critical_blockers > 0, "LIKELY_REJECTED")
               .otherwise("NEEDS_REVIEW"))
    score = (F.when(validated, F.col("overall_score").cast("long"))
              .when(blockers == 0, 100 - penalty)
              .otherwise(F.greatest(F.lit(0).cast("long"), 100 - 20 * critical_blockers - penalty)))
    return (df.withColumn("blocker_count", blockers)
              .withColumn("critical_blocker_count", critical_blockers)
              .withColumn("readiness_status", status)
              .withColumn("readiness_score", score)
              .withColumn("validated", validated))


def report_base(sessions: DataFrame, ext: DataFrame, validations: DataFrame,
                as_of: str) -> DataFrame:
    """Sessions ⟕ facts ⟕ latest validation. Both right sides leave their
    aggregation hash-partitioned by ``session_id``; the joins reuse that."""
    facts = session_facts(ext, as_of)
    latest = latest_validation(validations)
    joined = (sessions.select("session_id").join(facts, "session_id", "left")
              .join(latest, "session_id", "left"))
    return _derive(joined)


# --------------------------------------------------------------------------
# R1-R11 as individual operators
# --------------------------------------------------------------------------

def holder_profile(ext: DataFrame) -> DataFrame:
    """First non-empty value of each identity field in upload order."""
    aggs = []
    for src, dst in PROFILE_FIELDS:
        v = F.col(src)
        aggs.append(first_by(DOC_ORDER, v, v.isNotNull() & (v != "")).alias(dst))
    return complete(ext).groupBy("session_id").agg(*aggs)


def required_certs(roles: DataFrame) -> DataFrame:
    """R2: ``roles(session_id, detected_role)`` -> one row per required code."""
    return roles.select("session_id", F.posexplode(required_list("detected_role"))
                        .alias("ord", "document_type"))


def _satisfied_pairs(ext: DataFrame) -> DataFrame:
    """(session_id, code) pairs a session's COMPLETE documents satisfy."""
    t = complete(ext).select("session_id", "document_type").distinct()
    code = F.when(F.col("document_type").isin(*ECDIS_ALTERNATIVES), _arr(ECDIS_ALTERNATIVES)) \
        .otherwise(F.array("document_type"))
    return t.select("session_id", F.explode(code).alias("document_type")).distinct()


def cert_present(required: DataFrame, ext: DataFrame) -> DataFrame:
    """Required rows whose code (or an ECDIS alternative) is present."""
    return required.join(_satisfied_pairs(ext), ["session_id", "document_type"], "left_semi")


def cert_missing(required: DataFrame, ext: DataFrame) -> DataFrame:
    """Required rows without a satisfying document, with impact."""
    return (required.join(_satisfied_pairs(ext), ["session_id", "document_type"], "left_anti")
            .withColumn("impact", impact(F.col("document_type"))))


def cert_additional(required: DataFrame, ext: DataFrame) -> DataFrame:
    """One row per COMPLETE document whose raw code is not required
    (an ECDIS_TYPE is both satisfying and additional; null type is additional)."""
    req = required.select("session_id", "document_type")
    return (complete(ext).select("id", "session_id", "document_type", "document_name")
            .join(req, ["session_id", "document_type"], "left_anti"))


def expiry_timeline(ext: DataFrame, as_of: str) -> DataFrame:
    """Every COMPLETE document with an expiry, days left and urgency."""
    days = days_until("date_of_expiry", as_of)
    return (complete(ext).filter(F.col("date_of_expiry").isNotNull())
            .select("id", "session_id", "created_at", "document_type", "document_name",
                    "date_of_expiry", days.alias("days_until_expiry"),
                    urgency(days).alias("urgency")))


def flag_summary(ext: DataFrame) -> DataFrame:
    """R7 counts per session (items: see ``answers.explode_flags``)."""
    flags = F.coalesce(F.col("flags"), F.array())

    def n(sev):
        return F.sum(F.size(F.filter(flags, lambda f: f["severity"] == sev))).cast("long")

    return complete(ext).groupBy("session_id").agg(
        F.sum(F.size(flags)).cast("long").alias("total"), n("CRITICAL").alias("critical"),
        n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))


def medical_status(sessions: DataFrame, ext: DataFrame) -> DataFrame:
    """From the first PEME and the first DRUG_TEST; NOT_SUBMITTED only when
    the document is absent."""
    agg = complete(ext).groupBy("session_id").agg(
        first_by(DOC_ORDER, F.struct("fitness_result", "date_of_expiry", "is_expired"),
                 F.col("document_type") == "PEME").alias("peme"),
        first_by(DOC_ORDER, F.struct("drug_test_result"),
                 F.col("document_type") == "DRUG_TEST").alias("drug"))
    return (sessions.select("session_id").join(agg, "session_id", "left").select(
        "session_id",
        F.when(F.col("peme").isNull(), "NOT_SUBMITTED").otherwise(F.col("peme.fitness_result"))
        .alias("fitness_result"),
        F.when(F.col("drug").isNull(), "NOT_SUBMITTED").otherwise(F.col("drug.drug_test_result"))
        .alias("drug_test_result"),
        F.col("peme.date_of_expiry").alias("peme_expiry"),
        F.col("peme.is_expired").alias("peme_expired")))


# Blocker texts of the reference.
MSG_MISSING = "Missing required document: "
MSG_UNFIT = "Seafarer declared medically UNFIT"
MSG_POSITIVE = "Positive drug test result"
MSG_PEME_MISSING = "PEME not submitted"
MSG_DRUG_MISSING = "Drug test not submitted"
MSG_CRIT_FLAGS = " CRITICAL flag(s) on uploaded documents"


def _is_critical_text(t: Column) -> Column:
    return (t.startswith("Missing") | t.startswith("Expired")
            | t.contains("UNFIT") | t.contains("POSITIVE"))


def blockers(base: DataFrame, ext: DataFrame, as_of: str) -> DataFrame:
    """R10 as flat rows ``(session_id, ord, sort_key, doc_id, text, is_critical)``.

    ``base`` is ``report_base``. Order within a session is
    ``(ord, sort_key, created_at, doc_id)``; expired items are per-document
    rows and never gathered per session."""
    per_session = base.select(
        "session_id",
        F.posexplode_outer(F.array(
            *[F.when(F.col(cond_col) == val, F.struct(F.lit(o).alias("ord"), F.lit(msg).alias("text")))
              for o, cond_col, val, msg in [
                  (3, "fitness_result", "UNFIT", MSG_UNFIT),
                  (4, "drug_test_result", "POSITIVE", MSG_POSITIVE),
                  (5, "fitness_result", "NOT_SUBMITTED", MSG_PEME_MISSING),
                  (6, "drug_test_result", "NOT_SUBMITTED", MSG_DRUG_MISSING)]],
            F.when(F.col("flags_critical") > 0, F.struct(
                F.lit(7).alias("ord"),
                F.concat(F.col("flags_critical").cast("string"), F.lit(MSG_CRIT_FLAGS)).alias("text")))))
        .alias("p", "b")).filter(F.col("b").isNotNull()).select(
        "session_id", F.col("b.ord").alias("ord"), F.lit(0).alias("sort_key"),
        F.lit(None).cast(ext.schema["id"].dataType).alias("doc_id"), F.col("b.text").alias("text"))
    missing = base.select("session_id", F.posexplode("missing_critical").alias("pos", "code")).select(
        "session_id", F.lit(1).alias("ord"), F.col("pos").cast("int").alias("sort_key"),
        F.lit(None).cast(ext.schema["id"].dataType).alias("doc_id"),
        F.concat(F.lit(MSG_MISSING), F.col("code")).alias("text"))
    expired = expiry_timeline(ext, as_of).filter(F.col("urgency") == "EXPIRED").select(
        "session_id", F.lit(2).alias("ord"), F.col("days_until_expiry").alias("sort_key"),
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Expired: "), js_string("document_type"), F.lit(" ("),
                 js_string("document_name"), F.lit(")")).alias("text"))
    out = missing.unionByName(expired).unionByName(per_session)
    return out.withColumn("is_critical", _is_critical_text(F.col("text")))


def readiness(base: DataFrame) -> DataFrame:
    """R11 per session."""
    return base.select("session_id", "readiness_status", "readiness_score",
                       "blocker_count", "critical_blocker_count", "validated")


REPORT_SCALARS = [
    "session_id", "total", "full_name", "date_of_birth", "nationality", "passport_number",
    "sirb_number", "rank", "detected_role", "present_count", "missing_count",
    "missing_critical_count", "additional_count", "timeline_count", "expired_count",
    "flags_total", "flags_critical", "flags_high", "flags_medium", "flags_low",
    "fitness_result", "drug_test_result", "peme_expiry", "peme_expired",
    "latest_validation_id", "readiness_status", "readiness_score", "blocker_count", "validated",
]


def compliance_report(sessions: DataFrame, ext: DataFrame, validations: DataFrame,
                      as_of: str) -> DataFrame:
    """R12, scalar projection (one row per session, every session)."""
    base = report_base(sessions, ext, validations, as_of)
    return (base.withColumn("present_count", F.size("present").cast("long"))
                .withColumn("missing_count", F.size("missing").cast("long"))
                .withColumn("missing_critical_count", F.size("missing_critical").cast("long"))
                .withColumn("latest_validation_id", F.col("validation_id"))
                .select(*REPORT_SCALARS))


def compliance_report_nested(sessions: DataFrame, ext: DataFrame, validations: DataFrame,
                             as_of: str) -> DataFrame:
    """R12 in the reference's nested shape (one folder per row): inventory,
    timeline, flag items and blockers as arrays. Nested arrays are built last
    from long-form rows, keyed and sorted per session."""
    base = report_base(sessions, ext, validations, as_of)
    timeline = (expiry_timeline(ext, as_of).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("days_until_expiry", "created_at", "id",
                                             "document_type", "document_name",
                                             "date_of_expiry", "urgency"))).alias("expiry_timeline")))
    docs = complete(ext)
    flags = (docs.select("session_id", "created_at", "id",
                         F.posexplode(F.coalesce("flags", F.array())).alias("pos", "f"))
             .groupBy("session_id").agg(F.sort_array(F.collect_list(
                 F.struct("created_at", "id", "pos", "f.severity", "f.message"))).alias("flag_items")))
    req = base.select("session_id", F.posexplode("required").alias("ord", "document_type"))
    additional = (cert_additional(req, ext).join(docs.select("id", "created_at"), "id")
                  .groupBy("session_id").agg(F.sort_array(F.collect_list(
                      F.struct("created_at", "id", "document_type", "document_name")))
                      .alias("additional")))
    blk = (blockers(base, ext, as_of).join(
        docs.select(F.col("id").alias("doc_id"), "created_at"), "doc_id", "left")
        .groupBy("session_id").agg(F.sort_array(F.collect_list(
            F.struct("ord", "sort_key", "created_at", "doc_id", "text"))).alias("b"))
        .select("session_id", F.transform("b", lambda x: x["text"]).alias("blockers")))
    return (base.join(timeline, "session_id", "left").join(flags, "session_id", "left")
            .join(additional, "session_id", "left").join(blk, "session_id", "left")
            .select(
                "session_id",
                F.struct(*[F.col(dst) for _, dst in PROFILE_FIELDS]).alias("seafarer"),
                "detected_role",
                F.struct(F.col("total"), F.col("present"),
                         F.transform("missing", lambda m: F.struct(
                             m.alias("documentType"), impact(m).alias("impact"))).alias("missing"),
                         F.coalesce("additional", F.array()).alias("additional"))
                .alias("document_inventory"),
                F.coalesce("expiry_timeline", F.array()).alias("expiry_timeline"),
                F.struct("flags_total", "flags_critical", "flags_high", "flags_medium",
                         "flags_low", F.coalesce("flag_items", F.array()).alias("items"))
                .alias("flag_summary"),
                F.struct("fitness_result", "drug_test_result", "peme_expiry", "peme_expired")
                .alias("medical_status"),
                F.struct("readiness_status", "readiness_score",
                         F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"),
                         "validated").alias("compliance_readiness")))
