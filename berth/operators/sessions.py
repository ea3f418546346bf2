"""Session queries (Q1-Q8), computed for every session at once.

Inputs follow the reference tables: ``ext`` = current extractions (one row per
``(session_id, file_hash)``, ``flags`` an ``array<struct<severity,message>>``,
``created_at`` the upload order), ``jobs``, ``sessions``, ``validations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.functions.expr import days_until, urgency

COMPLETE = "COMPLETE"
DOC_ORDER = ["created_at", "id"]


def complete(ext: DataFrame) -> DataFrame:
    return ext.filter(F.col("status") == COMPLETE)


def _flag_count(severities: list[str] | None = None):
    flags = F.col("flags")
    if severities is None:
        return F.coalesce(F.size(flags), F.lit(0))
    return F.coalesce(F.size(F.filter(flags, lambda f: f["severity"].isin(*severities))), F.lit(0))


# Q1 -----------------------------------------------------------------------

def document_listing(ext: DataFrame) -> DataFrame:
    """COMPLETE documents with flag counts (null flag array counts 0)."""
    return complete(ext).select(
        "id", "session_id", "file_name", "document_type", "document_name",
        "applicable_role", "category", "holder_name", "confidence", "is_expired",
        _flag_count().alias("flag_count"),
        _flag_count(["CRITICAL"]).alias("critical_flag_count"),
        "created_at",
    )


# Q2 -----------------------------------------------------------------------

def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("QUEUED", "PROCESSING")).select(
        "job_id", "session_id", "file_name", "status", "queued_at", "started_at")


# Q3 / Q4 as aggregate expressions so one groupBy can carry them -----------

def role_flags():
    """(has_deck, has_engine) aggregates over COMPLETE rows."""
    r = F.col("applicable_role")
    return (F.coalesce(F.bool_or(r.isin("DECK", "BOTH")), F.lit(False)),
            F.coalesce(F.bool_or(r.isin("ENGINE", "BOTH")), F.lit(False)))


def role_from_flags(deck, engine):
    return (F.when(deck & engine, "BOTH").when(deck, "DECK")
             .when(engine, "ENGINE").otherwise("N/A"))


def health_flags(as_of: str):
    """(has_critical, has_warn) aggregates over COMPLETE rows."""
    flags = F.coalesce(F.col("flags"), F.array())
    crit_row = (F.exists(flags, lambda f: f["severity"] == "CRITICAL")
                | F.coalesce(F.col("is_expired") & F.col("is_required"), F.lit(False)))
    exp = F.col("date_of_expiry")
    as_of_d = F.lit(as_of).cast("date")
    warn_row = (F.exists(flags, lambda f: f["severity"].isin("HIGH", "MEDIUM"))
                | F.coalesce((exp > as_of_d) & (exp <= F.date_add(as_of_d, 90)), F.lit(False)))
    return (F.coalesce(F.bool_or(crit_row), F.lit(False)),
            F.coalesce(F.bool_or(warn_row), F.lit(False)))


def health_from_flags(crit, warn):
    return F.when(crit, "CRITICAL").when(warn, "WARN").otherwise("OK")


def detected_role(ext: DataFrame) -> DataFrame:
    """Q3: per session with COMPLETE documents."""
    deck, engine = role_flags()
    return (complete(ext).groupBy("session_id")
            .agg(role_from_flags(deck, engine).alias("detected_role")))


def overall_health(ext: DataFrame, as_of: str) -> DataFrame:
    """Q4: CRITICAL / WARN / OK per session with COMPLETE documents."""
    crit, warn = health_flags(as_of)
    return (complete(ext).groupBy("session_id")
            .agg(health_from_flags(crit, warn).alias("overall_health")))


# Q5 -----------------------------------------------------------------------

def _session_scalars(ext: DataFrame, jobs: DataFrame, as_of: str):
    deck, engine = role_flags()
    crit, warn = health_flags(as_of)
    docs = (complete(ext).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        role_from_flags(deck, engine).alias("detected_role"),
        health_from_flags(crit, warn).alias("overall_health")))
    pend = (pending_jobs(jobs).groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("pending_job_count")))
    return docs, pend


def session_summary(sessions: DataFrame, ext: DataFrame, jobs: DataFrame,
                    as_of: str) -> DataFrame:
    """Q5, scalar form: one row per session; empty sessions give 0 / N/A / OK.

    Both aggregates come out hash-partitioned by ``session_id``, so the two
    left joins need no further exchange of the aggregated sides."""
    docs, pend = _session_scalars(ext, jobs, as_of)
    return (sessions.select("session_id")
            .join(docs, "session_id", "left")
            .join(pend, "session_id", "left")
            .select("session_id",
                    F.coalesce("document_count", F.lit(0)).alias("document_count"),
                    F.coalesce("detected_role", F.lit("N/A")).alias("detected_role"),
                    F.coalesce("overall_health", F.lit("OK")).alias("overall_health"),
                    F.coalesce("pending_job_count", F.lit(0)).alias("pending_job_count")))


def session_summary_nested(sessions: DataFrame, ext: DataFrame, jobs: DataFrame,
                           as_of: str) -> DataFrame:
    """Q5 as the reference returns it: nested documents and pending jobs.

    The nested arrays hold one folder's documents (tens per person); use the
    scalar form plus Q1/Q2 for bulk work."""
    listing = document_listing(ext)
    docs = listing.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(
        "created_at", "id", "file_name", "document_type", "document_name",
        "applicable_role", "category", "holder_name", "confidence", "is_expired",
        "flag_count", "critical_flag_count"))).alias("documents"))
    pend = pending_jobs(jobs).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(
        "queued_at", "job_id", "file_name", "status", "started_at"))).alias("pending_jobs"))
    return (session_summary(sessions, ext, jobs, as_of)
            .join(docs, "session_id", "left").join(pend, "session_id", "left")
            .withColumn("documents", F.coalesce("documents", F.array()))
            .withColumn("pending_jobs", F.coalesce("pending_jobs", F.array())))


# Q6 -----------------------------------------------------------------------

def expiring_documents(ext: DataFrame, as_of: str, within_days: int = 90) -> DataFrame:
    """Expired or expiring within ``within_days`` (no lower bound).

    The date predicate compares the bare column with a literal, so it reaches
    the Parquet scan as a pushed filter."""
    if not (0 < within_days <= 3650):
        raise ValueError("INVALID_WITHIN_DAYS: withinDays must be a number between 1 and 3650")
    limit = F.date_add(F.lit(as_of).cast("date"), within_days)
    days = days_until("date_of_expiry", as_of)
    return (complete(ext)
            .filter(F.col("date_of_expiry").isNotNull() & (F.col("date_of_expiry") <= limit))
            .select("id", "session_id", "file_name", "document_type", "document_name",
                    "date_of_expiry", "is_expired",
                    days.alias("days_until_expiry"), urgency(days).alias("urgency")))


# Q7 -----------------------------------------------------------------------

def sessions_with_expired(ext: DataFrame, document_type: str) -> DataFrame:
    return (ext.filter((F.col("document_type") == document_type) & F.col("is_expired"))
            .select("session_id").distinct())


# Q8 -----------------------------------------------------------------------

def cascade_delete(sessions: DataFrame, ext: DataFrame, jobs: DataFrame,
                   validations: DataFrame, session_ids: DataFrame,
                   extraction_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Delete sessions (cascade to extractions, jobs, validations) and
    extractions (jobs pointing at them get ``extraction_id`` = NULL).

    ``session_ids`` has a ``session_id`` column, ``extraction_ids`` an ``id``
    column. Returns the remaining tables."""
    sid = session_ids.select("session_id").distinct()
    s2 = sessions.join(sid, "session_id", "left_anti")
    e2 = ext.join(sid, "session_id", "left_anti")
    j2 = jobs.join(sid, "session_id", "left_anti")
    v2 = validations.join(sid, "session_id", "left_anti")
    gone = ext.join(sid, "session_id", "left_semi").select("id")
    if extraction_ids is not None:
        eid = extraction_ids.select("id").distinct()
        e2 = e2.join(eid, "id", "left_anti")
        gone = gone.unionByName(eid)
    gone = gone.distinct().withColumn("_gone", F.lit(True))
    # Jobs without an extraction skip the join: NULL keys would all hash to
    # one shuffle partition.
    cols = j2.columns
    linked = (j2.filter(F.col("extraction_id").isNotNull())
                .join(gone.withColumnRenamed("id", "extraction_id"), "extraction_id", "left")
                .withColumn("extraction_id",
                            F.when(F.col("_gone").isNull(), F.col("extraction_id")))
                .select(*cols))
    j2 = linked.unionByName(j2.filter(F.col("extraction_id").isNull()))
    return {"sessions": s2, "extractions": e2, "jobs": j2, "validations": v2}
