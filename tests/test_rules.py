"""Hand-made edge cases for the report, sessions, jobs and the limiter."""

import bisect
import datetime as dt

from pyspark.sql import functions as F

from berth.operators import jobs as J
from berth.operators import ratelimit as T
from berth.operators import report as R
from berth.operators import sessions as Q

AS_OF = "2024-06-30"
EXT = ("id long, session_id long, created_at timestamp, status string, document_type string, "
       "document_name string, applicable_role string, is_required boolean, is_expired boolean, "
       "date_of_expiry date, fitness_result string, drug_test_result string, holder_name string, "
       "date_of_birth string, nationality string, passport_number string, sirb_number string, "
       "rank string, medical_restrictions string, flags array<struct<severity:string,message:string>>, "
       "file_name string")


def _doc(i, sid, typ, role="DECK", expiry=None, fitness="N/A", drug="N/A", flags=None,
         status="COMPLETE", expired=False, required=True):
    d = dt.date(2024, 6, 30) + dt.timedelta(days=expiry) if expiry is not None else None
    return (i, sid, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), status, typ, f"Doc {typ}",
            role, required, expired, d, fitness, drug, "A B", None, None, None, None, None, None, flags,
            f"f{i}.pdf")


def _report(spark, docs, sessions, vals=None):
    ext = spark.createDataFrame(docs, EXT)
    ses = spark.createDataFrame([(s,) for s in sessions], "session_id long")
    val = spark.createDataFrame(vals or [], "session_id long, created_at timestamp, validation_id long, "
                                            "overall_status string, overall_score long")
    return {r.session_id: r for r in R.compliance_report_nested(ses, ext, val, AS_OF).collect()}


def test_empty_session_report(spark):
    r = _report(spark, [], [7])[7]
    b = r.compliance_readiness
    assert r.detected_role == "N/A"
    assert [m.documentType for m in r.document_inventory.missing] == R.DECK_CERTS
    assert b.blockers == [f"Missing required document: {c}" for c in ["COC", "SIRB", "PASSPORT", "PEME", "DRUG_TEST"]] \
        + ["PEME not submitted", "Drug test not submitted"]
    assert (b.readiness_status, b.readiness_score) == ("LIKELY_REJECTED", 0)


def test_ecdis_type_only_is_present_and_additional(spark):
    r = _report(spark, [_doc(1, 1, "ECDIS_TYPE")], [1])[1]
    assert "ECDIS_GENERIC" in r.document_inventory.present
    assert [a.document_type for a in r.document_inventory.additional] == ["ECDIS_TYPE"]


def test_positive_drug_test_alone_needs_review(spark):
    docs = [_doc(i + 1, 1, t, drug="POSITIVE" if t == "DRUG_TEST" else "N/A",
                 fitness="FIT" if t == "PEME" else "N/A")
            for i, t in enumerate(R.DECK_CERTS)]
    r = _report(spark, docs, [1])[1].compliance_readiness
    assert r.blockers == ["Positive drug test result"]
    assert (r.readiness_status, r.readiness_score) == ("NEEDS_REVIEW", 100)


def test_unfit_alone_rejects(spark):
    docs = [_doc(i + 1, 1, t, fitness="UNFIT" if t == "PEME" else "N/A",
                 drug="NEGATIVE" if t == "DRUG_TEST" else "N/A") for i, t in enumerate(R.DECK_CERTS)]
    r = _report(spark, docs, [1])[1].compliance_readiness
    assert r.blockers == ["Seafarer declared medically UNFIT"]
    assert (r.readiness_status, r.readiness_score) == ("LIKELY_REJECTED", 80)


def test_peme_with_null_result_stays_null(spark):
    r = _report(spark, [_doc(1, 1, "PEME", fitness=None)], [1])[1]
    assert r.medical_status.fitness_result is None
    assert "PEME not submitted" not in r.compliance_readiness.blockers


def test_no_blockers_score_not_clamped(spark):
    many_high = [{"severity": "HIGH", "message": "x"}] * 12
    docs = [_doc(i + 1, 1, t, fitness="FIT" if t == "PEME" else "N/A",
                 drug="NEGATIVE" if t == "DRUG_TEST" else "N/A",
                 flags=many_high if i == 0 else []) for i, t in enumerate(R.DECK_CERTS)]
    r = _report(spark, docs, [1])[1].compliance_readiness
    assert (r.readiness_status, r.readiness_score) == ("LIKELY_APPROVED", -20)


def test_latest_validation_wins(spark):
    vals = [(1, dt.datetime(2024, 1, 1), 10, "APPROVED", 90), (1, dt.datetime(2024, 2, 1), 11, "REJECTED", 20)]
    r = _report(spark, [_doc(1, 1, "COC")], [1], vals)[1].compliance_readiness
    assert (r.readiness_status, r.readiness_score, r.validated) == ("REJECTED", 20, True)


def test_expiry_urgency_boundaries(spark):
    offs = [-1, 0, 30, 31, 90, 91]
    ext = spark.createDataFrame([_doc(i + 1, 1, "COC", expiry=o) for i, o in enumerate(offs)], EXT)
    got = {r.days_until_expiry: r.urgency for r in Q.expiring_documents(ext, AS_OF, 3650).collect()}
    assert got == {-1: "EXPIRED", 0: "CRITICAL", 30: "CRITICAL", 31: "WARNING", 90: "WARNING", 91: "OK"}
    within90 = {r.days_until_expiry for r in Q.expiring_documents(ext, AS_OF, 90).collect()}
    assert within90 == {-1, 0, 30, 31, 90}


def test_health_expiry_today_does_not_warn(spark):
    ext = spark.createDataFrame([_doc(1, 1, "COC", expiry=0), _doc(2, 2, "COC", expiry=90),
                                 _doc(3, 3, "COC", expired=True)], EXT)
    got = {r.session_id: r.overall_health for r in Q.overall_health(ext, AS_OF).collect()}
    assert got == {1: "OK", 2: "WARN", 3: "CRITICAL"}


def test_failed_rows_do_not_count(spark):
    ext = spark.createDataFrame([_doc(1, 1, "COC", role="ENGINE", status="FAILED"),
                                 _doc(2, 1, "PEME", role="DECK")], EXT)
    assert Q.detected_role(ext).first().detected_role == "DECK"


def test_limiter_window_edges(spark):
    # 11 requests inside the first window, then one exactly 60 000 ms after the anchor
    rows = [(1, i, i * 10) for i in range(11)] + [(1, 99, 60000)]
    out = {r.request_id: r for r in T.rate_limit(spark.createDataFrame(rows, "client long, request_id long, ms long")).collect()}
    assert all(out[i].allowed for i in range(10))
    assert not out[10].allowed and out[10].retry_after_ms == 60000 - 100 and out[10].retry_after_sec == 60
    assert out[99].allowed and out[99].retry_after_ms is None


def test_limiter_rejections_do_not_move_window(spark):
    rows = [(7, i, 0) for i in range(10)] + [(7, 100 + i, 59999) for i in range(3)] + [(7, 200, 60000)]
    out = {r.request_id: r.allowed for r in T.rate_limit(spark.createDataFrame(rows, "client long, request_id long, ms long")).collect()}
    assert not any(out[100 + i] for i in range(3)) and out[200]


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)],
                               "xff string, peer string")
    assert [r[0] for r in df.select(T.client_key("xff", "peer")).collect()] == ["1.2.3.4", "9.9.9.9", "unknown"]


def test_queue_position_ties_share_larger(spark):
    ts = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 2)]
    jobs = spark.createDataFrame([(i, "QUEUED", t) for i, t in enumerate(ts)] + [(9, "FAILED", ts[0])],
                                 "job_id long, status string, queued_at timestamp")
    got = {r.job_id: r.queue_position for r in J.queue_positions(jobs).collect()}
    assert got == {0: 2, 1: 2, 3: 3, 2: 4}


def test_queue_positions_on_one_day_are_spread(spark):
    """All jobs queued within one second of one day, a third of them at one
    instant: no range holds more than its share of the timestamps."""
    n, hot = 30_000, 10_000
    jobs = spark.range(n).select(
        F.col("id").alias("job_id"), F.when(F.col("id") % 7 == 0, "COMPLETE").otherwise("QUEUED").alias("status"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(F.col("id") < hot, 500_000).otherwise(F.col("id") * 31 % 999_983)).alias("queued_at"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        laid = J._laid_by_time(jobs)
        sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / len(sizes)
        assert laid.where("n > 1").count() >= 1
        got = {r.job_id: r.queue_position for r in J.queue_positions(jobs).collect()}
    finally:
        spark.conf.set(key, old)
    at = {r.job_id: r.us for r in jobs.where("status = 'QUEUED'").select("job_id", F.unix_micros("queued_at").alias("us")).collect()}
    order = sorted(at.values())
    assert got == {j: bisect.bisect_right(order, us) for j, us in at.items()}


def test_job_state_fold_and_requeue(spark):
    ev = [(1, 1, "queued", 10, None, None, None), (1, 2, "started", 20, None, None, None),
          (1, 3, "attempt_failed", 30, None, "timed out", 1), (1, 4, "started", 40, None, None, None),
          (1, 5, "final_failed", 50, 77, "LLM request timed out after 90000ms", 2),
          (2, 1, "queued", 10, None, None, None), (2, 2, "started", 20, None, None, None),
          (3, 1, "queued", 1, None, None, None), (3, 2, "started", 2, None, None, None),
          (3, 3, "final_failed", 3, 5, "boom", 3), (3, 4, "requeued", 4, None, None, None)]
    df = spark.createDataFrame(ev, "job_id long, seq int, kind string, at_ms long, extraction_id long, "
                                   "error_message string, attempt long")
    got = {r.job_id: r for r in J.job_state(df).collect()}
    assert (got[1].status, got[1].error_code, got[1].retryable, got[1].retry_count) == ("FAILED", "LLM_TIMEOUT", True, 2)
    assert (got[2].status, got[2].started_ms) == ("PROCESSING", 20)
    assert (got[3].status, got[3].error_code, got[3].retryable, got[3].retry_count) == ("QUEUED", None, True, 0)


def test_retry_schedule(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "job_id long, attempt long")
    assert [r.next_delay_ms for r in J.retry_schedule(df).orderBy("attempt").collect()] == [5000, 10000, None]


def test_notifications_signature_and_unsigned(spark):
    import hashlib
    import hmac
    jobs = spark.createDataFrame(
        [(1, 2, 3, "COMPLETE", None, None, dt.datetime(2024, 1, 1, 0, 0, 5), "https://x"),
         (4, 5, None, "FAILED", "LLM_ERROR", 'bad "quote"', dt.datetime(2024, 1, 1), "https://y"),
         (6, 5, None, "FAILED", "LLM_ERROR", "no URL", dt.datetime(2024, 1, 1), None)],
        "job_id long, session_id long, extraction_id long, status string, error_code string, "
        "error_message string, completed_at timestamp, webhook_url string")
    out = {r.job_id: r for r in J.notifications(jobs, "s3cret").collect()}
    assert set(out) == {1, 4}  # a job without a webhook URL gets no message
    assert out[1].body == ('{"event":"JOB_COMPLETED","jobId":"1","sessionId":"2","extractionId":"3",'
                           '"status":"COMPLETE","timestamp":"2024-01-01T00:00:05.000Z"}')
    assert out[4].body.endswith('"error":{"code":"LLM_ERROR","message":"bad \\"quote\\""},'
                                '"timestamp":"2024-01-01T00:00:00.000Z"}')
    want = "sha256=" + hmac.new(b"s3cret", out[1].body.encode(), hashlib.sha256).hexdigest()
    assert out[1].signature == want
    assert J.notifications(jobs, None).first().signature == ""


def test_cascade_delete_nulls_job_links(spark):
    ext = spark.createDataFrame([_doc(1, 1, "COC"), _doc(2, 2, "COC")], EXT)
    ses = spark.createDataFrame([(1,), (2,)], "session_id long")
    jobs = spark.createDataFrame([(10, 1, 1), (20, 2, 2), (30, 2, None)],
                                 "job_id long, session_id long, extraction_id long")
    val = spark.createDataFrame([(5, 1)], "validation_id long, session_id long")
    out = Q.cascade_delete(ses, ext, jobs, val, spark.createDataFrame([(1,)], "session_id long"),
                           spark.createDataFrame([(2,)], "id long"))
    assert [r.session_id for r in out["sessions"].collect()] == [2]
    assert {(r.job_id, r.extraction_id) for r in out["jobs"].collect()} == {(20, None), (30, None)}
    assert out["validations"].count() == 0 and out["extractions"].count() == 0


def _verdicts(rows, limit=10, window=60_000):
    """One request after the other, as the limiter in the process does."""
    state, out = {}, set()
    for c, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        anchor, used = state.get(c, (None, 0))
        if anchor is None or t - anchor >= window:
            anchor, used = t, 0
        left = None if used < limit else window - (t - anchor)
        state[c] = anchor, min(limit, used + 1)
        out.add((c, i, t, left is None, left, None if left is None else -(-left // 1000)))
    return out


def test_limiter_over_cut_clients(spark):
    import random
    rng = random.Random(3)
    rows = []
    for c in range(5):
        t = 0
        for i in range(300):
            t += rng.choice([0, 0, 1, 7, 400, 5000, 20000, 59999, 60000, 61000])
            rows.append((f"10.0.0.{c}", c * 1000 + i, t))
    df = spark.createDataFrame(rows, "client string, request_id long, ms long")
    want = _verdicts(rows)
    for parts in (None, 2, 7, 40, 300):
        got = [tuple(r) for r in T.rate_limit(df, partitions=parts).collect()]
        assert len(got) == len(rows) and set(got) == want, parts


def test_limiter_burst_of_one_client(spark):
    # a third of all rows: one client inside two windows, cut into many ranges
    rows = [("hot", i, (i * 37) % 100_000) for i in range(2000)]
    rows += [(f"c{i % 400}", 10_000 + i, i * 53) for i in range(4000)]
    df = spark.createDataFrame(rows, "client string, request_id long, ms long")
    out = T.rate_limit(df, partitions=24)
    assert {tuple(r) for r in out.collect()} == _verdicts(rows)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 1500
    none = T.rate_limit(df.limit(0))
    assert none.count() == 0 and none.schema["client"].dataType.simpleString() == "string"
