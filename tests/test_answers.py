"""LLM answer processing on hand-made rows (the reference's unit cases)."""

import json
import re

import pytest
from pyspark.sql import functions as F

from berth.functions import prompts
from berth.functions.expr import dmy_impossible, json_object_ok, parse_dmy, with_json_span
from berth.operators import answers as X

# (text, expected span) — the reference's extractor cases
SPAN_CASES = [
    ('{"a":1}', '{"a":1}'),
    ('```json\n{"a":1}\n```', '{"a":1}'),
    ('```\n{"a":1}\n```', '{"a":1}'),
    ('Here is the result:\n{"a":1}', '{"a":1}'),
    ('{"a":1}\nHope this helps', '{"a":1}'),
    ('Sure! ```json\n{"a":1}\n``` Anything else?', '{"a":1}'),
    ('{"a":{"b":{"c":2}}}', '{"a":{"b":{"c":2}}}'),
    ('```json\n{"a":1}\n```\nNote: dates are DD/MM/YYYY', '{"a":1}'),
    ("I cannot read this document.", None),
    ("", None),
    ("{ broken", None),
    ("} before {", None),
    ('   \n  {"a":1}  \n ', '{"a":1}'),
    ('{\n  "a": 1,\n  "b": [1, 2]\n}', '{\n  "a": 1,\n  "b": [1, 2]\n}'),
    ('```json\n{"a":1}\n```\nThe document is a COC.', '{"a":1}'),
    ('{"msg":"use {braces} here"}', '{"msg":"use {braces} here"}'),
    ('````\n{"a":1}\n```', '{"a":1}'),
    ('```json{"a":1}```', '{"a":1}'),
    ('``` only one fence {"a":1}', '{"a":1}'),
]


def test_json_span_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPAN_CASES)], "i int, t string")
    got = {r.i: r.span for r in with_json_span(df, "t", "span").collect()}
    for i, (text, want) in enumerate(SPAN_CASES):
        assert got[i] == want, f"case {i}: {text!r} -> {got[i]!r}, want {want!r}"


@pytest.mark.parametrize("span,ok", [
    ('{"a":1}', True), ("{'a':1}", False), ('{"a":1,}', False), ('{"a":NaN}', False),
    ('{"a":01}', False), ('{"a":1},{"b":2}', False), ('{"a":"}"}', True), (None, False),
    ('{"detection":{"confidence":"LOW"}}', True),
])
def test_strict_json(spark, span, ok):
    df = spark.createDataFrame([(span,)], "s string")
    assert df.select(json_object_ok("s")).first()[0] is ok


def test_parse_dmy(spark):
    rows = [("31/02/2024", None, True), ("01/12/2023", "2023-12-01", False),
            ("Lifetime", None, False), (None, None, False), ("1/2/2023", None, False),
            ("01/12/2023\n", None, False), ("29/02/2024", "2024-02-29", False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    out = df.select(parse_dmy("v").cast("string").alias("d"), dmy_impossible("v").alias("bad")).collect()
    for (v, d, bad), r in zip(rows, out):
        assert (r.d, r.bad) == (d, bad), v


def _answer(conf="HIGH", detection=True, holder=True, expiry='"01/01/2030"', is_expired="false"):
    obj = {}
    if detection:
        obj["detection"] = {"documentType": "COC", "confidence": conf}
    if holder:
        obj["holder"] = {"fullName": "A B"}
    obj["validity"] = {"dateOfExpiry": "__EXP__", "isExpired": "__ISEXP__"}
    obj["compliance"] = {"issuingAuthority": "X"}
    obj["medicalData"] = {"fitnessResult": "N/A"}
    obj["flags"] = []
    return json.dumps(obj).replace('"__EXP__"', expiry).replace('"__ISEXP__"', is_expired)


ATT = "session_id long, fid long, attempt_no int, stage string, raw_text string, error_message string"


def _resolve(spark, rows):
    df = spark.createDataFrame(rows, ATT)
    res = X.resolve_attempts(df)
    return {r.fid: r for r in X.promote(res).collect()}


def test_resolve_paths(spark):
    bad = '{"broken: json}'
    rows = [
        (1, 1, 1, "INITIAL", _answer(), None),                       # plain
        (1, 2, 1, "INITIAL", bad, None),                             # repair ok
        (1, 2, 2, "REPAIR", _answer(), None),
        (1, 3, 1, "INITIAL", bad, None),                             # repair unparseable
        (1, 3, 2, "REPAIR", "still not json", None),
        (1, 4, 1, "INITIAL", _answer("LOW"), None),                  # LOW -> HIGH adopted
        (1, 4, 3, "LOW_CONF_RETRY", _answer("HIGH"), None),
        (1, 5, 1, "INITIAL", _answer("LOW"), None),                  # LOW -> LOW kept
        (1, 5, 3, "LOW_CONF_RETRY", _answer("LOW"), None),
        (1, 6, 1, "INITIAL", _answer("LOW"), None),                  # LOW -> garbage kept
        (1, 6, 3, "LOW_CONF_RETRY", "nope", None),
        (1, 7, 1, "INITIAL", _answer("LOW"), None),                  # retry call errors: FAILED
        (1, 7, 3, "LOW_CONF_RETRY", None, "LLM API error 503"),
        (1, 8, 1, "INITIAL", None, "LLM request timed out after 90000ms"),
        (1, 9, 1, "INITIAL", _answer(holder=False), None),           # missing holder: FAILED
        (1, 10, 1, "INITIAL", _answer(expiry='"31/02/2024"'), None),  # impossible date
        (1, 11, 1, "INITIAL", _answer(is_expired="null"), None),     # NOT NULL column
        (1, 12, 1, "INITIAL", _answer(detection=False), None),       # no detection
        (1, 13, 1, "INITIAL", _answer(conf=None), None),             # null confidence is not LOW
    ]
    r = _resolve(spark, rows)
    assert (r[1].status, r[1].stage, r[1].retry_count) == ("COMPLETE", "INITIAL", 0)
    assert (r[2].status, r[2].stage, r[2].retry_count) == ("COMPLETE", "REPAIR", 1)
    assert (r[3].status, r[3].error_code, r[3].retry_count) == ("FAILED", "LLM_ERROR", 1)
    assert (r[4].status, r[4].stage, r[4].confidence, r[4].retry_count) == ("COMPLETE", "LOW_CONF_RETRY", "HIGH", 1)
    assert (r[5].status, r[5].stage, r[5].confidence) == ("COMPLETE", "INITIAL", "LOW")
    assert (r[6].status, r[6].stage) == ("COMPLETE", "INITIAL")
    assert (r[7].status, r[7].error_message, r[7].retry_count) == ("FAILED", "LLM API error 503", 1)
    assert (r[8].status, r[8].error_code, r[8].raw_text) == ("FAILED", "LLM_TIMEOUT", None)
    assert r[9].status == "FAILED" and r[10].status == "FAILED" and r[11].status == "FAILED"
    assert (r[12].status, r[12].error_message) == ("FAILED", X.MSG_NO_DETECTION)
    assert (r[13].status, r[13].retry_count) == ("COMPLETE", 0)
    assert str(r[1].date_of_expiry) == "2030-01-01"


def test_upsert_failed_after_complete_keeps_content(spark):
    cols = ("session_id long, file_hash string, version int, id string, file_name string, "
            "mime_type string, created_at timestamp, status string, error_code string, "
            "error_message string, retry_count int, prompt_version string, raw_text string, "
            "document_type string")
    cur = spark.createDataFrame([(1, "h", 1, "e1", "a.pdf", "application/pdf", None, "COMPLETE",
                                  None, None, 0, "1.0.0", "{}", "COC")], cols)
    b1 = spark.createDataFrame([(1, "h", 2, None, "b.pdf", "image/png", None, "FAILED",
                                 "LLM_ERROR", "boom", 2, "1.0.0", None, None)], cols)
    once = X.upsert_extractions(cur, b1, ["document_type"])
    r = once.first()
    assert (r.id, r.file_name, r.status, r.document_type, r.retry_count) == ("e1", "a.pdf", "FAILED", "COC", 2)
    # folding the stored row again with an unrelated batch keeps the content
    b2 = spark.createDataFrame([(2, "g", 3, None, "c.pdf", "image/png", None, "COMPLETE",
                                 None, None, 0, "1.0.0", "{}", "SIRB")], cols)
    twice = {x.session_id: x for x in X.upsert_extractions(once, b2, ["document_type"]).collect()}
    assert twice[1].document_type == "COC" and twice[1].status == "FAILED"
    assert twice[2].id is not None and len(twice[2].id) == 64


def test_followup_prompts(spark):
    rows = [(1, 1, 1, "INITIAL", "no json here", None),
            (1, 2, 1, "INITIAL", _answer("LOW"), None)]
    df = (spark.createDataFrame(rows, ATT).withColumn("file_name", F.lit("cert.jpg"))
          .withColumn("mime_type", F.lit("image/jpeg")))
    out = {r.kind: r.prompt for r in X.followup_requests(df).collect()}
    assert out["REPAIR"] == prompts.REPAIR_PREFIX + "no json here" + prompts.REPAIR_SUFFIX
    assert out["LOW_CONF_RETRY"].startswith(prompts.EXTRACTION_PROMPT)
    assert "- File name: cert.jpg\n- File type: image/jpeg" in out["LOW_CONF_RETRY"]


def test_decode_envelopes(spark):
    rows = [("anthropic", '{"content":[{"type":"text","text":"hi"}],"usage":{"input_tokens":3}}'),
            ("openai", '{"choices":[{"message":{"content":"yo"}}],"usage":{"prompt_tokens":1,'
                       '"completion_tokens":2,"total_tokens":9}}'),
            ("gemini", '{"candidates":[]}')]
    out = X.decode_envelopes(spark.createDataFrame(rows, "provider string, envelope string")).collect()
    assert (out[0].text, out[0].prompt_tokens, out[0].completion_tokens, out[0].total_tokens) == ("hi", 3, None, 3)
    assert (out[1].text, out[1].total_tokens) == ("yo", 9)
    assert (out[2].text, out[2].prompt_tokens, out[2].total_tokens) == ("", None, None)


def test_run_extractor_errors_become_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"x" * 13), "image/png"), (2, bytearray(b"xy"), "image/png")],
                               "upload_id long, content binary, mime_type string")
    out = {r.upload_id: r for r in X.run_extractor(df, X.stub_extractor, ["upload_id"]).collect()}
    assert out[1].raw_text is None and "timed out" in out[1].error_message
    assert '"HIGH"' in out[2].raw_text and out[2].error_message is None


def test_request_rows_shapes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), "image/png")], "content binary, mime_type string")
    for provider, probe in [("anthropic", '"source":{"type":"base64","media_type":"image/png","data":"YWJj"}'),
                            ("openai", '"url":"data:image/png;base64,YWJj"'),
                            ("gemini", '"inline_data":{"mime_type":"image/png","data":"YWJj"}')]:
        body = X.request_rows(df, provider, "m", "P").first().body
        assert probe in body
        parsed = json.loads(body)
        assert parsed is not None


def test_stored_flags_take_quoted_booleans(spark):
    df = spark.createDataFrame([("true",), (" False ",), ("on",), ("1",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(X.stored_flag(df["v"])).collect()] == [True, False, True, True, None, None]


def test_one_parse_per_answer(spark):
    """X4, X8's filter and X5 to X9 each hold a single parse in their plan."""
    df = spark.createDataFrame([(1, 1, 1, "INITIAL", _answer(), None)], ATT)
    p = X.parse_extractions(df)
    plans = [p, p.filter("ok").select("fid", "answer"), X.promote(X.resolve_attempts(df))]
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("parseJson") + text.count("parse_json") == 1, text


def test_second_value_after_the_first_is_no_answer(spark):
    texts = ['{"a":1},{"b":2}', '{"a":1},null,{"b":2}', '{"a":1}', '{"a":1} x', '[{"a":1}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    assert [r.ok for r in X.parse_extractions(df).orderBy("i").collect()] == [False, False, True, True, True]


def test_sections_stay_whole_and_times_are_summed(spark):
    odd = json.dumps({"detection": {"confidence": "HIGH", "detectionReason": "seal"}, "holder": {}, "validity": {"isExpired": "off", "extra": [1, None]},
                      "compliance": {"issuingAuthority": 7}, "medicalData": {"restrictions": None}, "flags": None})
    df = spark.createDataFrame([(1, 1, 1, "INITIAL", "{ broken", None, 1500), (1, 1, 2, "REPAIR", odd, None, 700)], ATT + ", latency_ms int")
    r = X.promote(X.resolve_attempts(df)).select(
        "status", "stage", "is_expired", "detection_reason", "issuing_authority", "processing_time_ms", "flags",
        F.to_json("validity").alias("validity"), F.to_json("medical_data").alias("medical")).first()
    assert (r.status, r.stage, r.is_expired, r.detection_reason) == ("COMPLETE", "REPAIR", False, "seal")
    assert (r.issuing_authority, r.processing_time_ms, r.flags) == ("7", 2200, None)
    assert json.loads(r.validity) == {"isExpired": "off", "extra": [1, None]} and json.loads(r.medical) == {"restrictions": None}


def test_text_bodies_are_json_stringify(spark):
    nasty = 'a "q" \\ \n\t\x0b ünï'
    df = spark.createDataFrame([(p, nasty) for p in ("Anthropic", "openai", "GROQ", "gemini")], "provider string, prompt string")
    got = {r.provider: r.body for r in X.text_request_rows(df, F.col("provider"), "m").collect()}
    chat = {"model": "m", "max_tokens": 4096, "messages": [{"role": "user", "content": nasty}]}
    want = {p: json.dumps(chat, ensure_ascii=False, separators=(",", ":")) for p in ("anthropic", "openai", "groq")}
    want["gemini"] = json.dumps({"contents": [{"parts": [{"text": nasty}]}]}, ensure_ascii=False, separators=(",", ":"))
    assert got == want


def test_validation_keeps_the_whole_result_and_the_first_call(spark):
    from berth.operators import validation as V
    rows = [(1, 7, 1, "INITIAL", "{ broken", "gemini", 10), (1, 7, 2, "REPAIR", '{"overallStatus":"REJECTED","overallScore":12,"x":[null]}', "openai", 99),
            (2, 7, 1, "INITIAL", '{"summary":"s","recommendations":["a","b"]} bye', "groq", 5), (3, 8, 1, "INITIAL", None, None, None)]
    df = spark.createDataFrame(rows, "validation_id long, session_id long, attempt_no int, stage string, raw_text string, llm_provider string, total_tokens int")
    got = {r.validation_id: r for r in V.parse_validations(df).withColumn("result", F.to_json("result")).collect()}
    assert (got[1].ok, got[1].used_repair, got[1].overall_score, got[1].llm_provider, got[1].total_tokens) == (True, True, 12, "gemini", 10)
    assert json.loads(got[1].result) == {"overallStatus": "REJECTED", "overallScore": 12, "x": [None]} and got[1].recommendations is None
    assert (got[2].summary, got[2].recommendations, got[2].used_repair) == ("s", ["a", "b"], False)
    assert (got[3].ok, got[3].result, got[3].prompt_version) == (False, None, prompts.VALIDATION_PROMPT_VERSION)


def _shuffled(df):
    """Names of the columns that go through the shuffles of a plan, one set a
    shuffle."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text, re.DOTALL)
    return [set(re.findall(r"(\w+)#\d+", x)) for x in found]


BASIC = [(1, 1, 1, "INITIAL", _answer("LOW"), None), (1, 1, 3, "LOW_CONF_RETRY", _answer(), None),
         (1, 2, 1, "INITIAL", "{ broken", None), (1, 2, 2, "REPAIR", _answer(holder=False), None),
         (1, 3, 1, "INITIAL", "{ broken", None), (1, 4, 1, "INITIAL", None, "LLM request timed out"), (None, None, 1, "INITIAL", _answer(), None)]


def test_upsert_shuffles_neither_texts_nor_answers(spark):
    """X12 over X5 and X9: rows are dealt once by their key, uncombined and
    without texts, if nothing above reads them."""
    df = spark.createDataFrame(BASIC, ATT).withColumn("file_hash", F.concat(F.lit("h"), F.col("fid")))
    names = ["document_type", "is_expired"]
    none = {c: F.lit(None).cast("string") for c in ("id", "file_name", "mime_type", "prompt_version")}
    batch = (X.promote(X.resolve_attempts(df, carry=("file_hash",), members=names))
             .withColumns({**none, "created_at": F.lit(None).cast("timestamp"), "version": F.lit(2)}))
    up = X.upsert_extractions(batch.withColumn("version", F.lit(1)), batch, names)
    narrow = up.select("session_id", "file_hash", "id", "status", "error_message", *names)
    shuffles = _shuffled(narrow)
    assert shuffles and not any({"raw_text", "answer", "span", "mime_type"} & s for s in shuffles)
    assert {"attempt_no", "members"} <= set.union(*shuffles)  # rows, not buffers
    whole = {(r.session_id, r.file_hash): r for r in up.collect()}
    assert whole[1, "h3"].raw_text == "{ broken" and whole[1, "h1"].raw_text == _answer() and len(whole) == 5
    for r in narrow.collect():
        w = whole[r.session_id, r.file_hash]
        assert tuple(r) == tuple(w[c] for c in narrow.columns)


def test_promoted_members_equal_those_of_the_whole_answer(spark):
    """X9 with members taken before the shuffle of X5: the same values, and no
    text or answer in the shuffle."""
    df = spark.createDataFrame(BASIC, ATT)
    every = [*X.PROMOTED, *X.MADE, *X.WHOLE]
    early, late = (X.promote(r) for r in (X.resolve_attempts(df, members=every), X.resolve_attempts(df)))
    assert early.columns == late.columns
    cols = [F.to_json(c).alias(c) if c in X.WHOLE else c for c in early.columns]
    assert sorted(map(str, early.select(cols).collect())) == sorted(map(str, late.select(cols).collect()))
    few = X.promote(X.resolve_attempts(df, members=["holder_name"]))
    assert "rank" not in few.columns and {r.holder_name for r in few.collect()} == {"A B", None}
    shuffle, = _shuffled(early.drop("raw_text"))
    assert "members" in shuffle and not {"raw_text", "answer", "span"} & shuffle


def test_resolved_text_may_be_a_digest(spark):
    """X5 with what the caller makes of a text: only that is shuffled."""
    df = spark.createDataFrame(BASIC, ATT)
    digest = X.resolve_attempts(df, keep_answer=False, text=F.unhex(F.sha2("raw_text", 256)))
    shuffle, = _shuffled(digest)
    assert not {"answer", "span"} & shuffle
    sent = digest.sparkSession._jvm.PythonSQLUtils.explainString(digest._jdf.queryExecution(), "formatted")
    assert "unhex(sha2" in sent[sent.index("Scan"):sent.index(") Exchange")]  # below the shuffle
    got = sorted(map(str, digest.select("fid", "status", F.lower(F.hex("raw_text"))).collect()))
    whole = X.resolve_attempts(df).select("fid", "status", F.sha2("raw_text", 256).alias("lower(hex(raw_text))"))
    assert got == sorted(map(str, whole.collect()))


def test_followups_shuffle_only_texts_to_be_repaired(spark):
    """Sound first answers and low-confidence retries leave their texts behind."""
    df = spark.createDataFrame(BASIC, ATT).withColumns({"file_name": F.lit("a.pdf"), "mime_type": F.lit("application/pdf")})
    got = X.followup_requests(df)
    shuffle, = _shuffled(got)
    assert shuffle == {"session_id", "fid", "i", "c"}
    rows = {(r.fid, r.kind): r.prompt for r in got.collect()}
    assert set(rows) == {(1, "LOW_CONF_RETRY"), (2, "REPAIR"), (3, "REPAIR")} and "{ broken" in rows[3, "REPAIR"]


def test_text_without_specials_is_not_searched_for_each(spark):
    """V2 and X1 write many short strings; one look tells that nothing is escaped."""
    from berth.functions.json_text import quoted
    texts = ["", "plain ä 漢", 'a"b', "a\\b", "a\nb\u0001", "\u007f", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", quoted(F.col("t")).alias("q"))
    assert [r.q for r in out.orderBy("i").collect()] == [None if t is None else json.dumps(t, ensure_ascii=False) for t in texts]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("RLIKE") < plan.index("replace(")
