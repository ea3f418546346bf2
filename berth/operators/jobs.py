"""Job state, ranking and outbox (J1-J10), over the whole jobs table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from berth.functions.expr import hmac_sha256_hex, last_by
from berth.session import cut

# Fixed values (reference settings).
ESTIMATED_TOTAL_MS = 15000
RETRY_ATTEMPTS = 3
RETRY_BASE_DELAY_MS = 5000
KEEP_COMPLETED = 1000
KEEP_FAILED = 5000
TERMINAL = ("COMPLETE", "FAILED")


def classify_error(message) -> F.Column:
    """X7 / worker rule: 'timed out' in the message -> LLM_TIMEOUT, else LLM_ERROR."""
    m = F.col(message) if isinstance(message, str) else message
    return F.when(m.contains("timed out"), "LLM_TIMEOUT").otherwise("LLM_ERROR")


# J2 -----------------------------------------------------------------------

def _laid_by_time(jobs: DataFrame) -> DataFrame:
    """QUEUED jobs counted per distinct ``queued_at``, cut into ranges of like
    numbers of timestamps that come from the data; ``part`` is the range."""
    per_ts = (jobs.filter(F.col("status") == "QUEUED").groupBy("queued_at").agg(F.count(F.lit(1)).alias("n")))
    return cut(per_ts.repartitionByRange("queued_at").withColumn("part", F.spark_partition_id()))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Position = number of QUEUED jobs with ``queued_at <=`` own (ties share
    the larger number), without one global window over all jobs:

    1. count QUEUED jobs per distinct ``queued_at`` (partial aggregation, so a
       timestamp shared by a third of all jobs is one row per map task);
    2. range-partition those counts: a range holds its share of the
       timestamps, also where all of them fall on one day or in one second;
    3. sum each range (one row a partition, so the prefix over them is one
       small task and a broadcast of proven size) and count on inside it;
    4. join back on ``queued_at`` (AQE splits a hot tie on the jobs side and
       broadcasts the position table when its runtime size allows)."""
    laid = _laid_by_time(jobs)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("part").agg(F.sum("n").alias("pn")).select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("queued_at").rowsBetween(Window.unboundedPreceding, 0)
    pos = (laid.withColumn("run", F.sum("n").over(inside)).join(F.broadcast(offsets), "part")
           .select("queued_at", (F.col("before") + F.col("run")).cast("long").alias("queue_position")))
    q = jobs.filter(F.col("status") == "QUEUED").select("job_id", "queued_at")
    return q.join(pos, "queued_at").select("job_id", "queue_position")


# J1 -----------------------------------------------------------------------

def job_status(jobs: DataFrame, ext: DataFrame, as_of_ts: str) -> DataFrame:
    """The poll view of every job: QUEUED + position, PROCESSING + estimate,
    COMPLETE + extraction, otherwise FAILED (a COMPLETE job without an
    extraction id is reported FAILED, as the reference's fall-through does)."""
    pos = queue_positions(jobs)
    now_ms = F.unix_millis(F.lit(as_of_ts).cast("timestamp"))
    view = (F.when(F.col("status") == "QUEUED", "QUEUED")
             .when(F.col("status") == "PROCESSING", "PROCESSING")
             .when((F.col("status") == "COMPLETE") & F.col("extraction_id").isNotNull(), "COMPLETE")
             .otherwise("FAILED"))
    j = jobs.withColumn("view_status", view)
    # only COMPLETE views look up the extraction; NULL ids never enter the join
    linked = (j.filter(F.col("view_status") == "COMPLETE")
               .join(ext.select(F.col("id").alias("extraction_id"),
                                F.col("document_type").alias("result_document_type")),
                     "extraction_id", "left"))
    rest = j.filter(F.col("view_status") != "COMPLETE").withColumn(
        "result_document_type", F.lit(None).cast("string"))
    j = linked.unionByName(rest).join(pos, "job_id", "left")
    est = F.greatest(F.lit(0).cast("long"),
                     F.lit(ESTIMATED_TOTAL_MS) - (now_ms - F.unix_millis("started_at")))
    failed = F.col("view_status") == "FAILED"
    return j.select(
        "job_id", "session_id", "view_status",
        F.when(F.col("view_status") == "QUEUED", F.col("queue_position")).alias("queue_position"),
        F.when(F.col("view_status") == "PROCESSING", est).alias("estimated_complete_ms"),
        F.when(F.col("view_status") == "COMPLETE", F.col("extraction_id")).alias("extraction_id"),
        "result_document_type",
        F.when(failed, F.col("error_code")).alias("error_code"),
        F.when(failed, F.col("retryable")).alias("retryable"))


# J3 / J4 ------------------------------------------------------------------

def retry_eligibility(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``requests(request_job_id)`` -> first failing check, or OK."""
    j = jobs.select(F.col("job_id").alias("request_job_id"), "status", "retryable",
                    F.col("file_data").isNotNull().alias("has_data"), F.lit(True).alias("found"))
    r = requests.join(j, "request_job_id", "left")
    code = (F.when(F.col("found").isNull(), "JOB_NOT_FOUND")
             .when(F.col("status") != "FAILED", "JOB_NOT_FAILED")
             .when(~F.col("retryable"), "JOB_NOT_RETRYABLE")
             .when(~F.col("has_data"), "JOB_DATA_UNAVAILABLE")
             .otherwise("OK"))
    return r.select("request_job_id", code.alias("code"))


def requeue(jobs: DataFrame, eligible: DataFrame, as_of_ts: str) -> DataFrame:
    """Apply accepted retries: QUEUED, cleared extraction / errors / times,
    new ``queued_at``, ``retry_count`` 0; ``retryable`` untouched."""
    e = eligible.select(F.col("request_job_id").alias("job_id")).distinct() \
        .withColumn("_requeue", F.lit(True))
    j = jobs.join(e, "job_id", "left")
    hit = F.coalesce(F.col("_requeue"), F.lit(False))

    def reset(c, value):
        return F.when(hit, value).otherwise(F.col(c)).alias(c)

    out = []
    for c in jobs.columns:
        if c == "status":
            out.append(reset(c, F.lit("QUEUED")))
        elif c in ("extraction_id", "error_code", "error_message", "started_at", "completed_at"):
            out.append(reset(c, F.lit(None).cast(jobs.schema[c].dataType)))
        elif c == "queued_at":
            out.append(reset(c, F.lit(as_of_ts).cast("timestamp")))
        elif c == "retry_count":
            out.append(reset(c, F.lit(0).cast(jobs.schema[c].dataType)))
        else:
            out.append(F.col(c))
    return j.select(*out)


# J5 -----------------------------------------------------------------------

def job_state(events: DataFrame) -> DataFrame:
    """Fold ``events(job_id, seq, kind, at_ms, extraction_id, error_message,
    attempt)`` to the job row. Kinds: queued, started, attempt_failed,
    completed, final_failed, requeued. One partial aggregation per job; each
    quantity is the latest event of its kind, valid only after the latest
    (re)queue."""
    k = F.col("kind")
    order = ["seq"]
    g = events.groupBy("job_id").agg(
        last_by(order, F.struct("seq", "kind")).alias("last"),
        last_by(order, F.col("seq"), k.isin("queued", "requeued")).alias("reset_seq"),
        last_by(order, F.struct("seq", "at_ms"), k == "started").alias("st"),
        last_by(order, F.struct("seq", "kind", "at_ms", "extraction_id", "error_message", "attempt"),
                k.isin("completed", "final_failed")).alias("t"),
        F.coalesce(F.bool_or(k == "final_failed"), F.lit(False)).alias("retryable"))
    after = lambda s: F.coalesce(s > F.coalesce(F.col("reset_seq"), F.lit(-1)), F.lit(False))
    t_ok = after(F.col("t.seq"))
    failed = t_ok & (F.col("t.kind") == "final_failed")
    status = (F.when(F.col("last.kind").isin("queued", "requeued"), "QUEUED")
               .when(F.col("last.kind").isin("started", "attempt_failed"), "PROCESSING")
               .when(F.col("last.kind") == "completed", "COMPLETE")
               .when(F.col("last.kind") == "final_failed", "FAILED"))
    return g.select(
        "job_id", status.alias("status"),
        F.when(after(F.col("st.seq")), F.col("st.at_ms")).alias("started_ms"),
        F.when(t_ok, F.col("t.at_ms")).alias("completed_ms"),
        F.when(t_ok, F.col("t.extraction_id")).alias("extraction_id"),
        F.when(failed, classify_error(F.col("t.error_message"))).alias("error_code"),
        F.when(failed, F.col("t.error_message")).alias("error_message"),
        "retryable",
        F.when(failed, F.col("t.attempt")).otherwise(F.lit(0)).cast("long").alias("retry_count"),
        (~(t_ok & (F.col("t.kind") == "completed"))).alias("has_file_data"))


# J6 -----------------------------------------------------------------------

def retry_schedule(failures: DataFrame) -> DataFrame:
    """Delay before the next attempt after failed attempt ``attempt``
    (exponential from 5 s; none after the last of 3)."""
    a = F.col("attempt")
    delay = F.when(a < RETRY_ATTEMPTS,
                   (F.lit(RETRY_BASE_DELAY_MS) * F.pow(F.lit(2), a - 1)).cast("long"))
    return failures.select("job_id", "attempt", delay.alias("next_delay_ms"))


# J7 -----------------------------------------------------------------------

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def notifications(jobs: DataFrame, secret: str | None) -> DataFrame:
    """One outbox row per terminal job that has a webhook URL: JSON payload and signature header
    (``sha256=<hex>`` HMAC of the body; empty without a secret)."""
    t = jobs.filter(F.col("status").isin(*TERMINAL) & F.col("webhook_url").isNotNull())
    opts = {"ignoreNullFields": "false"}
    common = [F.col("job_id").cast("string").alias("jobId"),
              F.col("session_id").cast("string").alias("sessionId"),
              F.col("extraction_id").cast("string").alias("extractionId")]
    ts = F.date_format("completed_at", ISO_MS).alias("timestamp")
    done = F.to_json(F.struct(F.lit("JOB_COMPLETED").alias("event"), *common,
                              F.lit("COMPLETE").alias("status"), ts), opts)
    fail = F.to_json(F.struct(F.lit("JOB_FAILED").alias("event"), *common,
                              F.lit("FAILED").alias("status"),
                              F.struct(F.col("error_code").alias("code"),
                                       F.col("error_message").alias("message")).alias("error"), ts), opts)
    body = F.when(F.col("status") == "COMPLETE", done).otherwise(fail)
    out = t.select("job_id", "webhook_url",
                   F.when(F.col("status") == "COMPLETE", "JOB_COMPLETED").otherwise("JOB_FAILED")
                   .alias("event"), body.alias("body"))
    sig = F.concat(F.lit("sha256="), hmac_sha256_hex("body", secret)) if secret else F.lit("")
    return out.withColumn("signature", sig)


# J8 / J9 ------------------------------------------------------------------

def delivery_ledger(jobs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Attempts, last error (cleared by a success) and delivery time per job
    with a webhook URL."""
    d = deliveries.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("webhook_attempts"),
        last_by(["attempt_no"], F.col("error")).alias("webhook_last_error"),
        last_by(["attempt_no"], F.col("at_ms"), F.col("ok")).alias("delivered_at_ms"))
    j = jobs.filter(F.col("webhook_url").isNotNull()).select("job_id", "status", "webhook_url")
    return (j.join(d, "job_id", "left")
            .select("job_id", "status",
                    F.coalesce("webhook_attempts", F.lit(0)).cast("long").alias("webhook_attempts"),
                    "webhook_last_error", "delivered_at_ms"))


def undelivered(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin(*TERMINAL) & F.col("delivered_at_ms").isNull()) \
        .select("job_id", "status", "webhook_attempts")


# J10 ----------------------------------------------------------------------

def retain(jobs: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """Newest N terminal job records per status (top-k per status: a bounded
    per-partition heap, no global window)."""
    keep = keep or {"COMPLETE": KEEP_COMPLETED, "FAILED": KEEP_FAILED}
    parts = [jobs.filter(F.col("status") == s)
                 .orderBy(F.col("completed_at").desc(), F.col("job_id").desc()).limit(n)
             for s, n in keep.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
