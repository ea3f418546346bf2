"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables through the adapter views and runs the
operator over the whole tables. Checked outputs are flat (scalar) projections
with the same column names as the oracle SQL in ``berth.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.operators import report as R
from berth.operators import sessions as Q
from berth.session import drop_dir, partitions_of, release, shared_dir
from berth.sources import fixtures as fx

AS_OF = fx.AS_OF

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ---------------------------------------------------------------- sessions

@query("q1_document_listing")
def q1(spark, sf):
    return Q.document_listing(fx.extractions(spark, sf)).select(
        "id", "session_id", "file_name", "document_type", "document_name", "applicable_role",
        "category", "holder_name", "confidence", "is_expired",
        _long("flag_count").alias("flag_count"),
        _long("critical_flag_count").alias("critical_flag_count"))


@query("q2_pending_jobs")
def q2(spark, sf):
    return Q.pending_jobs(fx.jobs(spark, sf)).select(
        "job_id", "session_id", "file_name", "status",
        F.unix_millis("queued_at").alias("queued_ms"),
        F.unix_millis("started_at").alias("started_ms"))


@query("q3_detected_role")
def q3(spark, sf):
    return Q.detected_role(fx.extractions(spark, sf))


@query("q4_overall_health")
def q4(spark, sf):
    return Q.overall_health(fx.extractions(spark, sf), AS_OF)


@query("q5_session_summary")
def q5(spark, sf):
    return Q.session_summary(fx.sessions(spark, sf), fx.extractions(spark, sf),
                             fx.jobs(spark, sf), AS_OF).select(
        "session_id", _long("document_count").alias("document_count"), "detected_role",
        "overall_health", _long("pending_job_count").alias("pending_job_count"))


@query("q6_expiring_documents")
def q6(spark, sf):
    return Q.expiring_documents(fx.extractions(spark, sf), AS_OF, 90).select(
        "id", "session_id", "file_name", "document_type", "document_name", "date_of_expiry",
        "is_expired", _long("days_until_expiry").alias("days_until_expiry"), "urgency")


@query("q7_sessions_with_expired")
def q7(spark, sf):
    return Q.sessions_with_expired(fx.extractions(spark, sf), "MARPOL")


@query("q8_cascade_delete")
def q8(spark, sf):
    ext = fx.extractions(spark, sf)
    out = Q.cascade_delete(
        fx.sessions(spark, sf), ext, fx.jobs(spark, sf), fx.validations(spark, sf),
        session_ids=Q.sessions_with_expired(ext, "MARPOL"),
        extraction_ids=ext.filter(F.col("status") == "FAILED").select("id"))
    return (out["extractions"].select(F.lit("extractions").alias("tbl"), F.col("id").alias("row_id"),
                                      "session_id", F.lit(None).cast("string").alias("ref_id"))
            .unionByName(out["jobs"].select(F.lit("jobs").alias("tbl"), F.col("job_id").cast("string").alias("row_id"),
                                            "session_id", F.col("extraction_id").alias("ref_id")))
            .unionByName(out["validations"].select(
                F.lit("validations").alias("tbl"), F.col("validation_id").cast("string").alias("row_id"),
                "session_id", F.lit(None).cast("string").alias("ref_id")))
            .unionByName(out["sessions"].select(
                F.lit("sessions").alias("tbl"), F.col("session_id").cast("string").alias("row_id"),
                "session_id", F.lit(None).cast("string").alias("ref_id"))))


# ------------------------------------------------------------------ report

@query("r1_holder_profile")
def r1(spark, sf):
    return R.holder_profile(fx.extractions(spark, sf))


def _roles(spark, sf):
    """Detected role of every session (N/A when no COMPLETE document)."""
    roles = Q.detected_role(fx.extractions(spark, sf))
    return (fx.sessions(spark, sf).select("session_id").join(roles, "session_id", "left")
            .select("session_id", F.coalesce("detected_role", F.lit("N/A")).alias("detected_role")))


@query("r2_required_certs")
def r2(spark, sf):
    return R.required_certs(_roles(spark, sf)).select(
        "session_id", _long("ord").alias("ord"), "document_type")


@query("r3_cert_present")
def r3(spark, sf):
    req = R.required_certs(_roles(spark, sf))
    return R.cert_present(req, fx.extractions(spark, sf)).select(
        "session_id", _long("ord").alias("ord"), "document_type")


@query("r4_cert_missing")
def r4(spark, sf):
    req = R.required_certs(_roles(spark, sf))
    return R.cert_missing(req, fx.extractions(spark, sf)).select(
        "session_id", _long("ord").alias("ord"), "document_type", "impact")


@query("r5_cert_additional")
def r5(spark, sf):
    req = R.required_certs(_roles(spark, sf))
    return R.cert_additional(req, fx.extractions(spark, sf))


@query("r6_expiry_timeline")
def r6(spark, sf):
    return R.expiry_timeline(fx.extractions(spark, sf), AS_OF).select(
        "id", "session_id", "document_type", "document_name", "date_of_expiry",
        _long("days_until_expiry").alias("days_until_expiry"), "urgency")


@query("r7_flag_summary")
def r7(spark, sf):
    return R.flag_summary(fx.extractions(spark, sf))


@query("r8_medical_status")
def r8(spark, sf):
    return R.medical_status(fx.sessions(spark, sf), fx.extractions(spark, sf))


@query("r9_latest_validation")
def r9(spark, sf):
    return R.latest_validation(fx.validations(spark, sf))


def _base(spark, sf):
    return R.report_base(fx.sessions(spark, sf), fx.extractions(spark, sf),
                         fx.validations(spark, sf), AS_OF)


@query("r10_blockers")
def r10(spark, sf):
    return R.blockers(_base(spark, sf), fx.extractions(spark, sf), AS_OF).select(
        "session_id", _long("ord").alias("ord"), _long("sort_key").alias("sort_key"),
        "doc_id", "text", "is_critical")


@query("r11_readiness")
def r11(spark, sf):
    return R.readiness(_base(spark, sf))


@query("r12_compliance_report")
def r12(spark, sf):
    return R.compliance_report(fx.sessions(spark, sf), fx.extractions(spark, sf),
                               fx.validations(spark, sf), AS_OF)


# -------------------------------------------------------------- validation

from berth.operators import jobs as J  # noqa: E402
from berth.operators import validation as V  # noqa: E402

AS_OF_TS = f"{AS_OF} 00:00:00"
WEBHOOK_SECRET = "whsec_test"


@query("v1_validation_eligibility")
def v1(spark, sf):
    return V.validation_eligibility(fx.sessions(spark, sf), fx.extractions(spark, sf))


@query("v2_validation_requests")
def v2(spark, sf):
    r = V.validation_requests(fx.extractions(spark, sf), AS_OF)
    return r.select("session_id", "n_docs", "first_id", "last_id",
                    F.length("prompt").cast("long").alias("prompt_len"), F.sha2("prompt", 256).alias("prompt_sha"))


@query("v3_parse_validations")
def v3(spark, sf):
    return _parsed_validations(spark, sf).select(
        "validation_id", "session_id", "ok", "used_repair", "overall_status", "overall_score", "summary",
        F.size("recommendations").cast("long").alias("n_recommendations"), "prompt_version", "llm_provider", "llm_model",
        "prompt_tokens", F.to_json("result").alias("result_json"))


def _parsed_validations(spark, sf):
    i = F.col("validation_id")
    return V.parse_validations(fx.view(spark, sf, "fx_validation_answers").withColumns({
        "llm_provider": _provider(i), "llm_model": F.concat(F.lit("model-"), F.col("attempt_no").cast("string")),
        "prompt_tokens": F.length("raw_text").cast("long")}))


@query("r9_latest_validation_full")
def r9_full(spark, sf):
    """R9 over stored validations with their parsed results."""
    # a merge join: the planner takes the results for small and would broadcast them all
    more = _parsed_validations(spark, sf).select("validation_id", *R.VALIDATION_MORE).hint("merge")
    return R.latest_validation(fx.validations(spark, sf).join(more, "validation_id", "left")).select(
        "session_id", "validation_id", "overall_status", "overall_score", "prompt_version", "llm_provider", "llm_model", "summary",
        F.size("recommendations").cast("long").alias("n_recommendations"), F.unix_micros("validated_at").alias("validated_us"))


@query("v4_consistency_checks")
def v4(spark, sf):
    return V.consistency_checks(fx.extractions(spark, sf)).select(
        "session_id", "field", "status", "n_values",
        F.array_join("values", "|").alias("values_joined"))


@query("v5_rule_missing")
def v5(spark, sf):
    return V.rule_missing(fx.sessions(spark, sf), fx.extractions(spark, sf)).select(
        "session_id", _long("ord").alias("ord"), "document_type", "is_required", "impact")


@query("v6_rule_expiring")
def v6(spark, sf):
    return V.rule_expiring(fx.extractions(spark, sf), AS_OF).select(
        "id", "session_id", "document_type", "date_of_expiry",
        _long("days_until_expiry").alias("days_until_expiry"), "urgency")


@query("v7_medical_flags")
def v7(spark, sf):
    return V.medical_flags(fx.sessions(spark, sf), fx.extractions(spark, sf), AS_OF)


@query("v8_rule_score")
def v8(spark, sf):
    return V.rule_score(fx.sessions(spark, sf), fx.extractions(spark, sf), AS_OF)


# -------------------------------------------------------------------- jobs

@query("j1_job_status")
def j1(spark, sf):
    return J.job_status(fx.jobs(spark, sf), fx.extractions(spark, sf), AS_OF_TS)


@query("j2_queue_positions")
def j2(spark, sf):
    return J.queue_positions(fx.jobs(spark, sf))


@query("j3_retry_eligibility")
def j3(spark, sf):
    return J.retry_eligibility(fx.view(spark, sf, "fx_retry_requests"), fx.jobs(spark, sf))


@query("j4_requeue")
def j4(spark, sf):
    jobs = fx.jobs(spark, sf)
    ok = J.retry_eligibility(fx.view(spark, sf, "fx_retry_requests"), jobs) \
        .filter(F.col("code") == "OK")
    return J.requeue(jobs, ok, AS_OF_TS).select(
        "job_id", "status", "extraction_id", "error_code", _long("retry_count").alias("retry_count"),
        F.unix_millis("queued_at").alias("queued_ms"), "retryable")


@query("j5_job_state")
def j5(spark, sf):
    return J.job_state(fx.view(spark, sf, "fx_job_events"))


@query("j6_retry_schedule")
def j6(spark, sf):
    ev = fx.view(spark, sf, "fx_job_events").filter(
        F.col("kind").isin("attempt_failed", "final_failed"))
    return J.retry_schedule(ev)


@query("j7_notifications")
def j7(spark, sf):
    return J.notifications(fx.jobs(spark, sf), WEBHOOK_SECRET).select(
        "job_id", "event", "body", "signature")


@query("j8_delivery_ledger")
def j8(spark, sf):
    return J.delivery_ledger(fx.jobs(spark, sf), fx.deliveries(spark, sf))


@query("j9_undelivered")
def j9(spark, sf):
    return J.undelivered(J.delivery_ledger(fx.jobs(spark, sf), fx.deliveries(spark, sf)))


@query("j10_retain")
def j10(spark, sf):
    return J.retain(fx.jobs(spark, sf)).select("job_id", "status")


# ------------------------------------------------------------ intake / T1

from berth.operators import answers as X  # noqa: E402
from berth.operators import intake as P  # noqa: E402
from berth.operators import ratelimit as T  # noqa: E402
from berth.sources import tables as S  # noqa: E402


@query("t1_rate_limit")
def t1(spark, sf):
    return T.rate_limit(fx.requests(spark, sf))


@query("t1_rate_limit_split")
def t1_split(spark, sf):
    """T1 over so many ranges that clients and windows are cut."""
    return T.rate_limit(fx.requests(spark, sf), partitions=64)


@query("p1_triage_uploads")
def p1(spark, sf):
    verdicts = T.rate_limit(fx.requests(spark, sf))
    return P.triage_uploads(fx.files(spark, sf), verdicts)


@query("p2_resolve_sessions")
def p2(spark, sf):
    return P.resolve_sessions(fx.files(spark, sf).select("upload_id", "session_id"),
                              fx.sessions(spark, sf))


@query("p3_find_duplicates")
def p3(spark, sf):
    return P.find_duplicates(fx.view(spark, sf, "fx_upload_rows"), fx.extractions(spark, sf)) \
        .select("session_id", "seq", "existing_extraction_id")


@query("p4_new_work")
def p4(spark, sf):
    return P.new_work(fx.view(spark, sf, "fx_upload_rows"), fx.extractions(spark, sf)) \
        .select("session_id", "seq", "fid", "file_hash")


@query("p5_unknown_ids")
def p5(spark, sf):
    return P.unknown_ids(fx.files(spark, sf), fx.sessions(spark, sf), "session_id")


# ----------------------------------------------------------------- sources

@query("s1_read_table")
def s1(spark, sf):
    return S.read_table(spark, "orders", f"{sf}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _intake_cols(df, *more):
    return df.select("upload_id", "size_bytes", "file_hash",
                     F.length("content_b64").cast("long").alias("b64_len"), *more)


@query("s2_intake_files")
def s2(spark, sf):
    return _intake_cols(S.intake_files(fx.files(spark, sf)), "file_name", "mime_type")


@query("s2_binary_files")
def s2_binary(spark, sf):
    """Every document as a landed file: names with known suffixes in both
    cases, an unknown one and none; one in twenty is empty."""
    path = shared_dir(spark, "landing/files")
    i = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".png", ".Pdf", "", ".txt"))), (i % 6 + 1).cast("int"))
    docs = S.read_table(spark, "documents", f"{sf}/documents.parquet").select(
        F.concat(F.lit("doc "), i.cast("string"), suffix).alias("file_name"),
        F.when(i % 20 == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    S.land_files(docs, path)
    return S.read_binary_files(spark, path, "doc *").select(
        "file_name", "mime_type", "size_bytes", "file_hash", F.length("content_b64").cast("long").alias("b64_len"))


@query("s3_intake_stream")
def s3(spark, sf):
    from berth.streaming import streams as ST
    # one file or a folder of them: a stream takes either by a pattern only
    docs = ST.intake_stream(spark, f"{sf}/documents.parque[t]", S.SCHEMAS["documents"], max_files_per_trigger=16)
    rows = S.intake_files(docs.select(F.col("doc_id").alias("upload_id"),
                                      F.encode("text", "UTF-8").alias("content")))
    base = ST.drain(_intake_cols(rows), "s3_intake")
    return spark.read.parquet(f"{base}/data")


RESCORED = "2024-01-10"  # the date of s4_validation_snapshot that is written again


@query("s4_write_snapshot")
def s4(spark, sf):
    ext = Q.complete(fx.extractions(spark, sf)).select(
        "id", "session_id", "status", "is_expired", "document_type")
    path = S.snapshot_path(spark, "extractions")
    S.write_snapshot(ext, path, ["document_type"])
    return spark.read.parquet(path).select("id", "session_id", "document_type", "status", "is_expired")


@query("s4_validation_snapshot")
def s4_validations(spark, sf):
    """Validations by date; then one date is written again with scores raised
    by one, and only its partition changes."""
    rows = fx.validations(spark, sf).withColumn("date", F.to_date("created_at"))
    path = S.snapshot_path(spark, "validations")
    S.write_snapshot(rows, path, ["date"], ["session_id"])
    again = rows.where(F.col("date") == F.lit(RESCORED).cast("date")).withColumn("overall_score", F.col("overall_score") + 1)
    S.write_snapshot(again, path, ["date"], ["session_id"])
    return spark.read.parquet(path).select("validation_id", "session_id", "overall_score", "overall_status", F.col("date").cast("string").alias("date"))


# ----------------------------------------------------------------- answers

from berth.functions.expr import answer_get  # noqa: E402


def _provider(c):
    return F.when(c % 3 == 0, "anthropic").when(c % 3 == 1, "openai").otherwise("gemini")


@query("x1_request_rows")
def x1(spark, sf):
    work = fx.files(spark, sf).filter(F.col("content").isNotNull()
                                      & F.col("mime_type").isin(*P.ALLOWED_MIME_TYPES))
    r = X.request_rows(work, _provider(F.col("upload_id")), "model-x")
    return r.select("upload_id", "provider", F.length("body").cast("long").alias("body_len"),
                    F.sha2("body", 256).alias("body_sha"))


@query("x1_text_requests")
def x1_text(spark, sf):
    """Bodies of the repair prompts of X6 and of the validation prompts of V2."""
    from berth.operators import validation as V
    repair = X.followup_requests(llm(spark, sf)).where("kind = 'REPAIR'").select(
        F.concat_ws("-", F.col("session_id").cast("string"), F.col("fid").cast("string")).alias("key"), "kind", "session_id", "prompt")
    check = V.validation_requests(fx.extractions(spark, sf), AS_OF).select(
        F.col("session_id").cast("string").alias("key"), F.lit("VALIDATION").alias("kind"), "session_id", "prompt")
    r = X.text_request_rows(repair.unionByName(check), _provider(F.col("session_id")), "model-x")
    return r.select("key", "kind", "provider", F.length("body").cast("long").alias("body_len"), F.sha2("body", 256).alias("body_sha"))


@query("x2_decode_envelopes")
def x2(spark, sf):
    return X.decode_envelopes(fx.view(spark, sf, "fx_envelopes")).select(
        "session_id", "fid", "attempt_no", "provider", "text", "prompt_tokens",
        "completion_tokens", "total_tokens")


@query("x3_json_span")
def x3(spark, sf):
    from berth.functions.expr import with_json_span
    return with_json_span(llm(spark, sf), "raw_text", "span").select("session_id", "fid", "attempt_no", "span")


def llm(spark, sf):
    return fx.llm_attempts(spark, sf)


@query("x4_parse_extractions")
def x4(spark, sf):
    return X.parse_extractions(llm(spark, sf)).select(
        "session_id", "fid", "attempt_no", "ok",
        answer_get("answer", "detection.documentType").alias("document_type"),
        answer_get("answer", "detection.confidence").alias("confidence"))


@query("x5_resolve_attempts")
def x5(spark, sf):
    return X.resolve_attempts(llm(spark, sf), keep_answer=False, text=F.unhex(F.sha2("raw_text", 256))).select(
        "session_id", "fid", "status", "stage", _long("retry_count").alias("retry_count"),
        "error_code", "error_message", F.lower(F.hex("raw_text")).alias("raw_sha"))


@query("x6_followup_requests")
def x6(spark, sf):
    return X.followup_requests(llm(spark, sf)).select(
        "session_id", "fid", "kind", F.length("prompt").cast("long").alias("prompt_len"),
        F.sha2("prompt", 256).alias("prompt_sha"))


@query("x7_classify_failures")
def x7(spark, sf):
    return X.classify_failures(llm(spark, sf)).select("session_id", "fid", "attempt_no", "error_code")


@query("x8_parse_dmy")
def x8(spark, sf):
    from berth.functions.expr import dmy_impossible, parse_dmy
    p = X.parse_extractions(llm(spark, sf)).filter("ok").select(
        "session_id", "fid", "attempt_no", answer_get("answer", "validity.dateOfExpiry").alias("raw_expiry"),
        answer_get("answer", "validity.dateOfIssue").alias("raw_issue"))
    return p.select("session_id", "fid", "attempt_no", "raw_expiry",
                    parse_dmy("raw_expiry").alias("expiry_date"), dmy_impossible("raw_expiry").alias("expiry_impossible"),
                    parse_dmy("raw_issue").alias("issue_date"))


def _promoted(spark, sf, members, carry=()):
    return X.promote(X.resolve_attempts(llm(spark, sf), carry=carry, members=members))


X9_MEMBERS = ["document_type", "holder_name", "date_of_expiry", "is_expired", "detection_reason", "medical_restrictions",
              *X.WHOLE, "flags", "fields"]


@query("x9_promote")
def x9(spark, sf):
    ok = F.col("status") == "COMPLETE"
    return _promoted(spark, sf, X9_MEMBERS).select(
        "session_id", "fid", "status", "error_code", "document_type", "holder_name",
        "date_of_expiry", "is_expired", "detection_reason", "medical_restrictions",
        *[F.to_json(c).alias(f"{c}_json") for c in X.WHOLE],
        F.when(ok, F.size("flags")).cast("long").alias("n_flags"),
        F.when(ok, F.size("fields")).cast("long").alias("n_fields"))


@query("x10_explode_fields")
def x10a(spark, sf):
    return X.explode_fields(fx.extractions(spark, sf)).withColumn("pos", _long("pos"))


@query("x10_explode_flags")
def x10b(spark, sf):
    return X.explode_flags(fx.extractions(spark, sf)).withColumn("pos", _long("pos"))


@query("x11_search_fields")
def x11(spark, sf):
    return X.search_fields(X.explode_fields(fx.extractions(spark, sf)), "PEME")


X12_CONTENT = ["document_type", "confidence", "holder_name", "date_of_expiry", "is_expired"]


def _x12_inputs(spark, sf):
    cur = (fx.extractions(spark, sf).withColumn("version", F.lit(1))
           .withColumn("raw_text", F.lit(None).cast("string")))
    batch = (_promoted(spark, sf, X12_CONTENT, ("file_hash", "file_name", "mime_type"))
             .withColumn("version", F.lit(2)).withColumn("id", F.lit(None).cast("string"))
             .withColumn("created_at", F.lit(None).cast("timestamp"))
             .withColumn("prompt_version", F.lit("1.0.0")))
    return cur, batch


@query("x12_upsert_extractions")
def x12(spark, sf):
    cur, batch = _x12_inputs(spark, sf)
    return X.upsert_extractions(cur, batch, X12_CONTENT).select(
        "session_id", "file_hash", "id", "status", "error_code",
        _long("retry_count").alias("retry_count"), *X12_CONTENT)


def _calls(spark, sf):
    return (X.decode_envelopes(fx.view(spark, sf, "fx_envelopes"))
            .withColumn("model", F.concat(F.lit("model-"), F.col("provider")))
            .withColumn("prompt_version", F.lit("1.0.0")))


@query("x13_usage_rollup")
def x13(spark, sf):
    return X.usage_rollup(_calls(spark, sf)).select(
        "provider", "model", "prompt_version", _long("calls").alias("calls"),
        _long("successes").alias("successes"), "prompt_tokens", "completion_tokens", "total_tokens",
        "avg_latency_ms", "p50_latency_ms")


@query("x14_run_extractor")
def x14(spark, sf):
    req = fx.files(spark, sf).filter(F.col("content").isNotNull())
    return X.run_extractor(req, X.stub_extractor, ["upload_id"], concurrency=8)


# --------------------------------------------------------------- streaming

from berth.streaming import streams as ST  # noqa: E402


def _land(df, name, order_col, slices=3, by=None):
    """Land ``df`` as time-ordered file slices (each key's rows of a slice in
    one file) for a file-source stream."""
    spark = df.sparkSession
    path = shared_dir(spark, f"landing/{name}")
    # stage the input once so the slices do not recompute its whole plan
    stage = shared_dir(spark, f"staging/{name}")
    (df.repartition(*[F.col(c) for c in by]) if by else df).write.option("compression", "zstd").parquet(stage)
    release(spark)
    ST.land_in_order(spark.read.schema(df.schema).parquet(stage), path, order_col, slices)
    drop_dir(spark, stage)
    return path, df.schema


@query("t2_rate_limit_stream")
def t2(spark, sf):
    path, schema = _land(fx.requests(spark, sf), "requests", "ms", by=["client"])
    stream = ST.intake_stream(spark, path, schema, max_files_per_trigger=16)
    base = ST.drain(ST.rate_limit_stream(stream), "t2_rate_limit")
    return spark.read.parquet(f"{base}/data")


@query("t3_dedup_stream")
def t3(spark, sf):
    rows = fx.view(spark, sf, "fx_upload_rows")
    path, schema = _land(rows, "uploads", "seq", by=["session_id"])
    stream = ST.intake_stream(spark, path, schema, max_files_per_trigger=16)
    ST.use_rocksdb(spark)
    first = ST.first_wins_stream(stream, ["session_id", "file_hash"], ["seq"])
    table = ST.RunTable(spark, shared_dir(spark, "tables/uploads_first"), first.schema, ["session_id", "file_hash"])
    ST.drain(first, "t3_dedup", output_mode="update", foreach_batch=table.sink)
    return table.read().select("session_id", "file_hash", "seq", "file_name")


@query("t4_job_state_stream")
def t4(spark, sf):
    ev = fx.view(spark, sf, "fx_job_events")
    path, schema = _land(ev, "job_events", "seq", by=["job_id"])
    stream = ST.intake_stream(spark, path, schema, max_files_per_trigger=16)
    ST.use_rocksdb(spark)
    states = ST.job_state_stream(stream)
    table = ST.RunTable(spark, shared_dir(spark, "tables/job_state"), states.schema, ["job_id"])
    ST.drain(states, "t4_job_state", output_mode="update", foreach_batch=table.sink)
    return table.read()


T5_BUCKET_ROWS = 100_000  # with their texts some 100 MB: a bucket is sorted in one task


@query("t5_upsert_stream")
def t5(spark, sf):
    """Files with fid % 5 = 4 are not stored yet: their first rows (without an
    id) come in the stream, before the second rows of every file."""
    cur, batch = _x12_inputs(spark, sf)
    cols = ["session_id", "file_hash", "version", *X.IDENTITY, *X.META, *X12_CONTENT]
    new = F.col("fid") % 5 == 4
    base = cur.filter(~new).select(*cols)
    first = cur.filter(new).withColumn("id", F.lit(None).cast("string")).select(*cols)
    batch = batch.select(*cols)
    second = shared_dir(spark, "staging/promoted")  # apart from the landing, so that the texts are in one shuffle at a time
    batch.write.option("compression", "zstd").parquet(second)
    release(spark)
    path, schema = _land(first.unionByName(spark.read.schema(batch.schema).parquet(second)), "attempts", "version", slices=2, by=["session_id"])
    drop_dir(spark, second)
    table = ST.extraction_table(spark, shared_dir(spark, "tables/extractions_live"), base.schema, base,
                                buckets=partitions_of(cur, T5_BUCKET_ROWS))
    stream = ST.intake_stream(spark, path, schema, max_files_per_trigger=16)
    ST.drain(stream, "t5_upsert", foreach_batch=ST.upsert_stream(table, X12_CONTENT))
    return table.read().select(
        "session_id", "file_hash", "id", "status", "error_code",
        _long("retry_count").alias("retry_count"), *X12_CONTENT)
