"""Adapter views: the reference's table shapes, derived from the driver tables.

The view SQL is written once and rendered for two dialects (Spark SQL and
DuckDB) so the engine and the oracle read *identical* input rows. The
operators themselves (``berth.operators``) are DataFrame code and never see
this SQL; the oracle side (``berth.plans.oracle``) prepends the same views as
CTEs to an independent SQL formulation of each operator.

Only two expressions differ between the dialects: adding days to a date and
formatting a date as ``DD/MM/YYYY``; SHA-256 has a different function name.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berth.session import release, shared_dir

AS_OF = "2024-06-30"

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Dialect:
    """Tiny expression renderer for the two engines."""

    def __init__(self, name: str):
        assert name in ("spark", "duckdb")
        self.name = name

    def date_plus(self, date_sql: str, days_sql: str) -> str:
        if self.name == "spark":
            return f"date_add({date_sql}, {days_sql})"
        return f"({date_sql} + ({days_sql}))"

    def dmy(self, date_sql: str) -> str:
        if self.name == "spark":
            return f"date_format({date_sql}, 'dd/MM/yyyy')"
        return f"strftime({date_sql}, '%d/%m/%Y')"

    def sha256(self, sql: str) -> str:
        if self.name == "spark":
            return f"sha2({sql}, 256)"
        return f"sha256({sql})"

    def epoch_us(self, ts_sql: str) -> str:
        if self.name == "spark":
            return f"unix_micros(CAST({ts_sql} AS TIMESTAMP))"
        return f"epoch_us({ts_sql})"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")

# --------------------------------------------------------------------------
# Adapter views exactly as stated in FIXTURES.md (section B).
# --------------------------------------------------------------------------

FX_DOC_TYPES = """
SELECT * FROM (VALUES
 (0,'COC',true),(1,'COP_BT',true),(2,'COP_PSCRB',true),(3,'COP_AFF',true),(4,'COP_MEFA',true),
 (5,'COP_MECA',true),(6,'COP_SSO',false),(7,'COP_SDSD',false),(8,'ECDIS_GENERIC',true),(9,'ECDIS_TYPE',true),
 (10,'SIRB',true),(11,'PASSPORT',true),(12,'PEME',true),(13,'DRUG_TEST',true),(14,'YELLOW_FEVER',false),
 (15,'ERM',true),(16,'MARPOL',false),(17,'SULPHUR_CAP',false),(18,'BALLAST_WATER',false),(19,'HATCH_COVER',false),
 (20,'BRM_SSBT',true),(21,'TRAIN_TRAINER',false),(22,'HAZMAT',false),(23,'FLAG_STATE',true),(24,'OTHER',false)
) AS t(type_idx, document_type, is_required)
"""

FX_SESSIONS = """
SELECT c_custkey AS session_id, c_name AS holder_name, c_nationkey AS nation FROM customer
UNION ALL SELECT 1000000000 + s_suppkey, s_name, s_nationkey FROM supplier
"""

FX_UPLOADS = """
SELECT o_custkey AS session_id, l_partkey % 97 AS fid, CAST(l_quantity AS BIGINT) AS qty,
  (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 200 AS v,
  ROW_NUMBER() OVER (PARTITION BY o_custkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

FX_EXTRACTIONS = """
SELECT u.session_id, u.seq, CAST(u.session_id AS VARCHAR(20)) || '-' || CAST(u.seq AS VARCHAR(20)) AS extraction_id, u.fid, t.document_type,
  CONCAT('Doc ', t.document_type) AS document_name, t.is_required,
  CASE WHEN u.session_id % 11 = 0 OR u.fid % 25 IN (10, 11, 12, 13) THEN 'N/A'
       WHEN u.session_id % 3 = 0 THEN 'DECK' WHEN u.session_id % 3 = 1 THEN 'ENGINE' ELSE 'BOTH' END AS applicable_role,
  CASE WHEN u.v % 10 = 0 THEN 'LOW' WHEN u.v % 10 < 4 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  CASE WHEN u.v % 7 = 0 THEN NULL WHEN u.v = 9 THEN '' WHEN u.v = 11 THEN CONCAT(s.holder_name, ' Jr') ELSE s.holder_name END AS holder_name,
  CASE WHEN u.v % 3 = 0 THEN NULL WHEN u.v = 13 THEN CONCAT('P', CAST(u.session_id + 1 AS VARCHAR(20))) ELSE CONCAT('P', CAST(u.session_id AS VARCHAR(20))) END AS passport_number,
  CASE WHEN u.fid % 5 = 0 THEN NULL ELSE CAST((u.fid * 37 + u.qty) % 1500 - 30 AS INT) END AS expiry_offset_days,
  CASE WHEN u.fid % 5 = 0 THEN FALSE ELSE (u.fid * 37 + u.qty) % 1500 < 30 END AS is_expired,
  CASE WHEN u.fid % 25 = 12 THEN CASE WHEN u.v % 20 = 1 THEN 'UNFIT' WHEN u.v % 20 = 2 THEN NULL ELSE 'FIT' END ELSE 'N/A' END AS fitness_result,
  CASE WHEN u.fid % 25 = 13 THEN CASE WHEN u.v % 20 = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END ELSE 'N/A' END AS drug_test_result,
  CASE WHEN u.v < 36 THEN u.v ELSE -1 END AS flag_code,
  CASE WHEN u.v % 25 = 24 THEN 'FAILED' ELSE 'COMPLETE' END AS status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, fid ORDER BY seq) AS rn FROM fx_uploads) u
JOIN fx_doc_types t ON t.type_idx = u.fid % 25
JOIN fx_sessions s ON s.session_id = u.session_id
WHERE u.rn = 1
"""

FX_JOBS = """
SELECT o_orderkey AS job_id, o_custkey AS session_id,
  CASE WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderstatus = 'F' THEN 'COMPLETE'
       WHEN o_orderkey % 2 = 0 THEN 'PROCESSING' ELSE 'FAILED' END AS status,
  o_orderdate AS queued_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 <> 0 THEN CAST(o_custkey AS VARCHAR(20)) || '-1' END AS extraction_id,
  o_orderkey % 4 <> 1 AS retryable, o_orderkey % 10 <> 3 AS has_file_data,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://example.com/hook' END AS webhook_url
FROM orders
"""

FX_VALIDATIONS = """
SELECT event_id AS validation_id, user_id * 7 AS session_id, ts AS created_at,
  CAST(FLOOR(value) AS BIGINT) % 101 AS overall_score,
  CASE WHEN CAST(FLOOR(value) AS BIGINT) % 101 >= 75 THEN 'APPROVED'
       WHEN CAST(FLOOR(value) AS BIGINT) % 101 >= 45 THEN 'CONDITIONAL' ELSE 'REJECTED' END AS overall_status
FROM events
"""


def fx_requests_sql(d: Dialect) -> str:
    # Fixed: a month squeezed x10 000 (FIXTURES.md, fx_requests).
    return f"""
SELECT CASE WHEN user_id % 3 = 0 THEN ' 10.0.0.' || CAST(user_id AS VARCHAR(20)) || ' , 172.16.0.1' END AS forwarded_for,
  CASE WHEN user_id % 10 <> 1 THEN '192.168.0.' || CAST(user_id AS VARCHAR(20)) END AS peer,
  event_id AS request_id,
  CAST(FLOOR(({d.epoch_us('ts')} - 1704067200000000) / 10000000) AS BIGINT) AS ms
FROM events
"""


# --------------------------------------------------------------------------
# Derived canonical tables (ours). Everything below is plain SQL valid in both
# dialects apart from the Dialect hooks.
# --------------------------------------------------------------------------

def fx_ext_sql(d: Dialect) -> str:
    """Scalar columns of the current-extractions table (one row per file)."""
    as_of = f"DATE '{AS_OF}'"
    return f"""
SELECT e.extraction_id AS id, e.session_id, e.seq, e.fid,
  'file-' || CAST(e.fid AS VARCHAR(20)) || '.pdf' AS file_name,
  {d.sha256("'file-' || CAST(e.fid AS VARCHAR(20))")} AS file_hash,
  'application/pdf' AS mime_type,
  e.document_type, e.document_name,
  CASE WHEN e.document_type IN ('PASSPORT', 'SIRB') THEN 'IDENTITY'
       WHEN e.document_type IN ('PEME', 'DRUG_TEST', 'YELLOW_FEVER') THEN 'MEDICAL'
       WHEN e.document_type = 'COC' THEN 'CERTIFICATION'
       WHEN e.document_type LIKE 'COP%' THEN 'STCW_ENDORSEMENT'
       WHEN e.document_type = 'FLAG_STATE' THEN 'FLAG_STATE'
       WHEN e.document_type = 'OTHER' THEN 'OTHER' ELSE 'TRAINING' END AS category,
  e.applicable_role, e.is_required, e.confidence,
  e.holder_name,
  CASE WHEN e.seq % 9 = 0 THEN NULL WHEN e.fid = 17 THEN '01/01/1990'
       ELSE LPAD(CAST(e.session_id % 28 + 1 AS VARCHAR(20)), 2, '0') || '/06/1985' END AS date_of_birth,
  CASE WHEN e.seq % 8 = 0 THEN NULL ELSE 'N' || CAST(e.session_id % 25 AS VARCHAR(20)) END AS nationality,
  e.passport_number,
  CASE WHEN e.seq % 5 = 0 THEN NULL WHEN e.fid = 41 THEN 'S0'
       ELSE 'S' || CAST(e.session_id AS VARCHAR(20)) END AS sirb_number,
  CASE WHEN e.seq % 6 = 0 THEN NULL WHEN e.seq % 6 = 1 THEN ''
       WHEN e.applicable_role = 'ENGINE' THEN 'Chief Engineer' ELSE 'Master' END AS rank,
  {d.date_plus(as_of, 'e.expiry_offset_days - 1825')} AS date_of_issue,
  {d.date_plus(as_of, 'e.expiry_offset_days')} AS date_of_expiry,
  e.is_expired, e.fitness_result, e.drug_test_result,
  CASE WHEN e.document_type = 'PEME' AND e.seq % 4 = 1 THEN 'Corrective lenses required'
       WHEN e.document_type = 'PEME' AND e.seq % 4 = 2 THEN '' END AS medical_restrictions,
  'MARINA' AS issuing_authority,
  CASE WHEN e.document_type LIKE 'COP%' THEN 'STCW Reg VI/1' END AS regulation_reference,
  e.flag_code,
  CASE WHEN e.flag_code = 0 THEN 0 WHEN e.flag_code BETWEEN 1 AND 5 THEN 1
       WHEN e.flag_code BETWEEN 6 AND 15 THEN 6 WHEN e.flag_code BETWEEN 16 AND 35 THEN 16
       WHEN e.seq % 2 = 0 THEN -2 ELSE -1 END AS flag_class,
  'Summary of ' || e.document_type AS summary,
  CAST(e.seq * 1000 + e.fid AS INT) AS processing_time_ms,
  e.status,
  CASE WHEN e.status = 'FAILED' THEN 'LLM_ERROR' END AS error_code,
  CASE WHEN e.status = 'FAILED' THEN 'LLM API error 500: upstream' END AS error_message,
  CASE WHEN e.confidence = 'LOW' THEN 1 ELSE 0 END AS retry_count,
  '1.0.0' AS prompt_version
FROM fx_extractions e
"""


# Flag list per flag class (FIXTURES.md fx_extractions: 0 ->
# CRITICAL+HIGH, 1-5 -> HIGH, 6-15 -> MEDIUM, 16-35 -> LOW, other -> none).
# Class -2 stands for a NULL flags array, -1 for an empty one.
FLAG_CLASSES = """
SELECT * FROM (VALUES
 (0, 0, 'CRITICAL'), (0, 1, 'HIGH'), (1, 0, 'HIGH'), (6, 0, 'MEDIUM'), (16, 0, 'LOW')
) AS t(flag_class, pos, severity)
"""

FX_EXT_FLAGS = """
SELECT x.id, x.session_id, x.seq, x.status, c.pos, c.severity,
  c.severity || ' issue on ' || x.document_type AS message
FROM fx_ext x JOIN fx_flag_classes c ON c.flag_class = x.flag_class
"""

# Two extracted fields per document (position 0 and 1).
FX_EXT_FIELDS = """
SELECT x.id, x.session_id, x.seq, x.status, 0 AS pos, 'document_number' AS key, 'Document Number' AS label,
  x.document_type || '-' || CAST(x.fid AS VARCHAR(20)) AS value, 'CRITICAL' AS importance,
  CASE WHEN x.is_expired THEN 'EXPIRED' ELSE 'OK' END AS field_status
FROM fx_ext x
UNION ALL
SELECT x.id, x.session_id, x.seq, x.status, 1 AS pos, 'holder_name' AS key, 'Holder Name' AS label,
  COALESCE(x.holder_name, '') AS value, 'HIGH' AS importance,
  CASE WHEN x.holder_name IS NULL OR x.holder_name = '' THEN 'MISSING' ELSE 'OK' END AS field_status
FROM fx_ext x
"""


def fx_jobs_full_sql(d: Dialect) -> str:
    return """
SELECT j.job_id, j.session_id, j.status, j.queued_at, j.extraction_id, j.retryable,
  j.has_file_data, j.webhook_url,
  'file-' || CAST(j.job_id % 97 AS VARCHAR(20)) || '.pdf' AS file_name,
  CASE WHEN j.status = 'FAILED' THEN
    CASE WHEN j.job_id % 3 = 0 THEN 'LLM_TIMEOUT' ELSE 'LLM_ERROR' END END AS error_code,
  CASE WHEN j.status = 'FAILED' THEN
    CASE WHEN j.job_id % 3 = 0 THEN 'LLM request timed out after 90000ms'
         ELSE 'LLM API error 500: upstream' END END AS error_message,
  CASE WHEN j.status = 'FAILED' THEN 3 ELSE 0 END AS retry_count
FROM fx_jobs j
"""


# Webhook delivery log: 1 + job_id % 3 attempts for terminal jobs with a URL;
# the last attempt succeeds unless job_id % 4 = 2.
FX_DELIVERIES = """
SELECT j.job_id, a.k AS attempt_no,
  (a.k = 1 + j.job_id % 3 AND j.job_id % 4 <> 2) AS ok,
  CASE WHEN a.k = 1 + j.job_id % 3 AND j.job_id % 4 <> 2 THEN NULL
       ELSE 'Webhook HTTP 503: busy ' || CAST(a.k AS VARCHAR(20)) END AS error,
  CAST(j.job_id * 10 + a.k AS BIGINT) AS at_ms
FROM fx_jobs j JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(k)) a ON a.k <= 1 + j.job_id % 3
WHERE j.webhook_url IS NOT NULL AND j.status IN ('COMPLETE', 'FAILED')
"""


def _json_str(col: str) -> str:
    return f"COALESCE('\"' || {col} || '\"', 'null')"


def _extraction_json(d: Dialect, conf_sql: str) -> str:
    """One ExtractionResult answer as JSON text, built by concatenation."""
    expiry = (f"CASE WHEN x.date_of_expiry IS NULL THEN '\"Lifetime\"' "
              f"WHEN x.fid = 46 THEN '\"31/02/2024\"' "
              f"ELSE '\"' || {d.dmy('x.date_of_expiry')} || '\"' END")
    issue = (f"CASE WHEN x.date_of_issue IS NULL THEN 'null' "
             f"ELSE '\"' || {d.dmy('x.date_of_issue')} || '\"' END")
    # fid % 89 = 88: the holder section is missing (row must fail, X9)
    holder = (
        "CASE WHEN x.fid % 89 = 88 THEN '' ELSE ',\"holder\":{\"fullName\":' || "
        f"{_json_str('x.holder_name')} || ',\"dateOfBirth\":' || {_json_str('x.date_of_birth')} || "
        f"',\"nationality\":' || {_json_str('x.nationality')} || ',\"passportNumber\":' || "
        f"{_json_str('x.passport_number')} || ',\"sirbNumber\":' || {_json_str('x.sirb_number')} || "
        f"',\"rank\":' || {_json_str('x.rank')} || ',\"photo\":\"PRESENT\"}}' END")
    return (
        "'{\"detection\":{\"documentType\":\"' || x.document_type || '\",\"documentName\":\"' || "
        "x.document_name || '\",\"category\":\"' || x.category || '\",\"applicableRole\":\"' || "
        "x.applicable_role || '\",\"isRequired\":' || CASE WHEN x.is_required THEN 'true' ELSE 'false' END || "
        f"',\"confidence\":\"' || {conf_sql} || '\",\"detectionReason\":\"Header reads {{' || x.document_type || '}}\"}}' || "
        f"{holder} || "
        "',\"fields\":[{\"key\":\"document_number\",\"label\":\"Document Number\",\"value\":\"' || "
        "x.document_type || '-' || CAST(x.fid AS VARCHAR(20)) || "
        "'\",\"importance\":\"CRITICAL\",\"status\":\"OK\"}],\"validity\":{\"dateOfIssue\":' || "
        f"{issue} || ',\"dateOfExpiry\":' || {expiry} || ',\"isExpired\":' || "
        # fid % 19 = 7: the flag comes quoted
        "CASE WHEN x.fid % 83 = 82 THEN 'null' WHEN x.fid % 19 = 7 THEN CASE WHEN x.is_expired THEN '\"true\"' ELSE '\"false\"' END WHEN x.is_expired THEN 'true' ELSE 'false' END || "
        "',\"daysUntilExpiry\":null,\"revalidationRequired\":null},\"compliance\":{\"issuingAuthority\":\"MARINA\","
        "\"regulationReference\":' || " + _json_str("x.regulation_reference") + " || "
        "',\"imoModelCourse\":null,\"recognizedAuthority\":true,\"limitations\":null},\"medicalData\":{\"fitnessResult\":' || "
        + _json_str("x.fitness_result") + " || ',\"drugTestResult\":' || " + _json_str("x.drug_test_result") +
        " || ',\"restrictions\":' || " + _json_str("x.medical_restrictions") + " || "
        "',\"specialNotes\":null,\"expiryDate\":null},\"flags\":[],\"summary\":\"' || x.summary || '\"}'"
    )


def fx_llm_attempts_sql(d: Dialect, source: str = "fx_ext x JOIN (SELECT id, {j} AS js FROM fx_ext x) j ON j.id = x.id",
                        js: str = "j.js") -> str:
    """LLM answers per file: INITIAL (wrapped by seq % 6), REPAIR, LOW_CONF_RETRY.

    FIXTURES.md fx_llm_attempts: class 5 is cut off before the last brace and
    gets a REPAIR answer (a failed call when fid % 13 = 12, else unparseable
    when fid % 4 = 0); LOW rows get a
    LOW_CONF_RETRY answer (LOW when fid % 3 = 0, unparseable when fid % 7 = 0).
    Calls that error carry ``error_message`` and no text.
    """
    j = _extraction_json(d, "x.confidence")
    j_hi = _extraction_json(d, "CASE WHEN x.fid % 3 = 0 THEN 'LOW' ELSE 'HIGH' END")
    nl = "chr(10)"
    initial = (
        f"CASE x.seq % 6 WHEN 0 THEN {js} WHEN 1 THEN '```json' || {nl} || {js} || {nl} || '```' "
        f"WHEN 2 THEN '```' || {nl} || {js} || {nl} || '```' "
        f"WHEN 3 THEN 'Here is the extraction:' || {nl} || {js} "
        f"WHEN 4 THEN {js} || {nl} || 'Let me know if anything is unclear.' "
        f"ELSE substr({js}, 1, length({js}) - 1) END")
    return f"""
SELECT x.session_id, x.fid, x.seq, x.file_name, x.file_hash, x.mime_type,
  1 AS attempt_no, 'INITIAL' AS stage,
  CASE WHEN x.seq % 29 = 28 THEN NULL ELSE {initial} END AS raw_text,
  CASE WHEN x.seq % 29 = 28 THEN 'LLM request timed out after 90000ms' END AS error_message
FROM {source.format(j=j)}
UNION ALL
SELECT x.session_id, x.fid, x.seq, x.file_name, x.file_hash, x.mime_type,
  2 AS attempt_no, 'REPAIR' AS stage,
  CASE WHEN x.fid % 13 = 12 THEN NULL WHEN x.fid % 4 = 0 THEN '{{"broken: json}}' ELSE {j} END AS raw_text,
  CASE WHEN x.fid % 13 = 12 THEN 'LLM API error 500: upstream' END AS error_message
FROM fx_ext x WHERE x.seq % 6 = 5 AND x.seq % 29 <> 28
UNION ALL
SELECT x.session_id, x.fid, x.seq, x.file_name, x.file_hash, x.mime_type,
  3 AS attempt_no, 'LOW_CONF_RETRY' AS stage,
  CASE WHEN x.fid % 11 = 10 THEN NULL
       WHEN x.fid % 7 = 0 THEN 'Sorry, I cannot read this document.' ELSE {j_hi} END AS raw_text,
  CASE WHEN x.fid % 11 = 10 THEN 'LLM API error 503: overloaded' END AS error_message
FROM fx_ext x WHERE x.confidence = 'LOW' AND x.seq % 29 <> 28 AND (x.seq % 6 <> 5 OR (x.fid % 4 <> 0 AND x.fid % 13 <> 12))
"""


def fx_files_sql(d: Dialect) -> str:
    """Uploads derived from ``documents`` (FIXTURES.md fx_files) plus request
    fields, and one request without a file per supplier."""
    return """
SELECT doc_id AS upload_id, doc_id AS request_id, doc_id % 150 AS client,
  CASE WHEN doc_id % 4 = 0 THEN 'image/jpeg' WHEN doc_id % 4 = 1 THEN 'image/png'
       WHEN doc_id % 4 = 2 THEN 'application/pdf' ELSE 'text/plain' END AS mime_type,
  'doc' || CAST(doc_id AS VARCHAR(20)) AS file_name,
  n_chars * 1000 AS size_bytes,
  text,
  CASE WHEN doc_id % 5 = 0 THEN 'SYNC' WHEN doc_id % 5 = 1 THEN 'sync' WHEN doc_id % 5 = 2 THEN 'Async' END AS mode,
  CASE WHEN doc_id % 7 = 0 THEN 'https://hooks.example.com/done' WHEN doc_id % 7 = 1 THEN 'ftp://files.example.com/x'
       WHEN doc_id % 7 = 2 THEN 'not a url' WHEN doc_id % 7 = 3 THEN 'http://10.0.0.5:8080/cb' END AS webhook_url,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 150 * 7 WHEN doc_id % 3 = 1 THEN 900000 + doc_id END AS session_id
FROM documents
UNION ALL
SELECT -s_suppkey, -s_suppkey, s_suppkey % 150, 'image/png', 'none' || CAST(s_suppkey AS VARCHAR(20)), 0, NULL,
  'sync', NULL, NULL
FROM supplier
"""


# Job event log: the worker's state transitions per final job status.
FX_JOB_EVENT_KINDS = """
SELECT * FROM (VALUES
 ('QUEUED', 1, 'queued'), ('PROCESSING', 1, 'queued'), ('PROCESSING', 2, 'started'),
 ('COMPLETE', 1, 'queued'), ('COMPLETE', 2, 'started'), ('COMPLETE', 3, 'completed'),
 ('FAILED', 1, 'queued'), ('FAILED', 2, 'started'), ('FAILED', 3, 'attempt_failed'),
 ('FAILED', 4, 'started'), ('FAILED', 5, 'attempt_failed'), ('FAILED', 6, 'started'),
 ('FAILED', 7, 'final_failed')
) AS t(status, seq, kind)
"""

FX_JOB_EVENTS = """
SELECT j.job_id, k.seq, k.kind, j.job_id * 100 + k.seq AS at_ms,
  CASE WHEN k.kind = 'completed' THEN j.extraction_id
       WHEN k.kind = 'final_failed' THEN CAST(j.session_id AS VARCHAR(20)) || '-2' END AS extraction_id,
  CASE WHEN k.kind IN ('attempt_failed', 'final_failed') THEN j.error_message END AS error_message,
  CASE WHEN k.kind IN ('attempt_failed', 'final_failed') THEN CAST((k.seq - 1) / 2 AS BIGINT) END AS attempt
FROM fx_jobs_full j JOIN fx_job_event_kinds k ON k.status = j.status
"""

# Retry requests: every job once, plus unknown ids for the failed ones.
FX_RETRY_REQUESTS = """
SELECT job_id AS request_job_id FROM fx_jobs
UNION ALL SELECT -job_id FROM fx_jobs WHERE status = 'FAILED'
"""


def fx_upload_rows_sql(d: Dialect) -> str:
    return f"""
SELECT u.session_id, u.seq, u.fid, {d.sha256("'file-' || CAST(u.fid AS VARCHAR(20))")} AS file_hash,
  'file-' || CAST(u.fid AS VARCHAR(20)) || '.pdf' AS file_name
FROM fx_uploads u
"""


# Validation answers: INITIAL wrapped by validation_id % 4 (3 = broken, then a
# REPAIR answer, itself broken when validation_id % 8 = 7).
_VALIDATION_JSON = ("'{\"overallStatus\":\"' || overall_status || '\",\"overallScore\":' ||\n"
                    "    CAST(overall_score AS VARCHAR(20)) || ',\"summary\":\"Folder reviewed\",\"recommendations\":[]}'")


def fx_validation_answers_sql(source: str = """fx_validations v JOIN (
  SELECT validation_id, {js} AS js
  FROM fx_validations) a ON a.validation_id = v.validation_id""", js: str = "a.js") -> str:
    return f"""
SELECT v.validation_id, v.session_id, 1 AS attempt_no, 'INITIAL' AS stage,
  CASE v.validation_id % 4
    WHEN 0 THEN {js}
    WHEN 1 THEN '```json' || chr(10) || {js} || chr(10) || '```'
    WHEN 2 THEN 'Review complete.' || chr(10) || {js}
    ELSE '{{"overallStatus": "' || v.overall_status || '", "overallScore": }}' END AS raw_text
FROM {source.format(js=_VALIDATION_JSON)}
UNION ALL
SELECT v.validation_id, v.session_id, 2, 'REPAIR',
  CASE WHEN v.validation_id % 8 = 7 THEN 'I could not produce JSON.'
       ELSE '{{"overallStatus":"' || v.overall_status || '","overallScore":' ||
            CAST(v.overall_score AS VARCHAR(20)) || '}}' END
FROM fx_validations v WHERE v.validation_id % 4 = 3
"""


# Provider envelopes around each attempt's text (provider by (seq + attempt) % 3;
# no usage object when seq % 5 = 0; openai's total is given as in + out + 1).
_ESC = ("'\"' || replace(replace(replace(a.raw_text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), "
        "chr(10), chr(92) || 'n') || '\"'")
FX_ENVELOPES = f"""
SELECT a.session_id, a.fid, a.seq, a.attempt_no, a.stage, a.error_message,
  CASE (a.seq + a.attempt_no) % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END AS provider,
  CASE (a.seq + a.attempt_no) % 3
    WHEN 0 THEN CASE WHEN a.raw_text IS NULL THEN '{{"content":[]'
                     ELSE '{{"content":[{{"type":"text","text":' || {_ESC} || '}}]' END
         || CASE WHEN a.seq % 5 <> 0 THEN ',"usage":{{"input_tokens":' || CAST(1000 + a.fid AS VARCHAR(20))
                 || ',"output_tokens":' || CAST(COALESCE(length(a.raw_text), 0) AS VARCHAR(20)) || '}}' ELSE '' END || '}}'
    WHEN 1 THEN CASE WHEN a.raw_text IS NULL THEN '{{"choices":[]'
                     ELSE '{{"choices":[{{"message":{{"role":"assistant","content":' || {_ESC} || '}}}}]' END
         || CASE WHEN a.seq % 5 <> 0 THEN ',"usage":{{"prompt_tokens":' || CAST(1000 + a.fid AS VARCHAR(20))
                 || ',"completion_tokens":' || CAST(COALESCE(length(a.raw_text), 0) AS VARCHAR(20))
                 || ',"total_tokens":' || CAST(1001 + a.fid + COALESCE(length(a.raw_text), 0) AS VARCHAR(20)) || '}}'
                 ELSE '' END || '}}'
    ELSE '{{"candidates":' || CASE WHEN a.raw_text IS NULL THEN '[]'
                     ELSE '[{{"content":{{"parts":[{{"text":' || {_ESC} || '}}]}}}}]' END
         || CASE WHEN a.seq % 5 <> 0 THEN ',"usageMetadata":{{"promptTokenCount":' || CAST(1000 + a.fid AS VARCHAR(20))
                 || ',"candidatesTokenCount":' || CAST(COALESCE(length(a.raw_text), 0) AS VARCHAR(20))
                 || ',"totalTokenCount":' || CAST(1000 + a.fid + COALESCE(length(a.raw_text), 0) AS VARCHAR(20)) || '}}'
                 ELSE '' END || '}}'
  END AS envelope,
  CAST((a.fid * 37 + a.seq * 11 + a.attempt_no * 101) % 5000 + 500 AS BIGINT) AS latency_ms
FROM fx_llm_attempts a
"""


# name -> (sql for a dialect, dependencies); ordered so dependencies come first.
VIEWS: dict[str, tuple[Callable[[Dialect], str], tuple[str, ...]]] = {
    "fx_doc_types": (lambda d: FX_DOC_TYPES, ()),
    "fx_sessions": (lambda d: FX_SESSIONS, ()),
    "fx_uploads": (lambda d: FX_UPLOADS, ()),
    "fx_extractions": (lambda d: FX_EXTRACTIONS, ("fx_uploads", "fx_doc_types", "fx_sessions")),
    "fx_ext": (fx_ext_sql, ("fx_extractions",)),
    "fx_flag_classes": (lambda d: FLAG_CLASSES, ()),
    "fx_ext_flags": (lambda d: FX_EXT_FLAGS, ("fx_ext", "fx_flag_classes")),
    "fx_ext_fields": (lambda d: FX_EXT_FIELDS, ("fx_ext",)),
    "fx_jobs": (lambda d: FX_JOBS, ()),
    "fx_jobs_full": (fx_jobs_full_sql, ("fx_jobs",)),
    "fx_deliveries": (lambda d: FX_DELIVERIES, ("fx_jobs",)),
    "fx_validations": (lambda d: FX_VALIDATIONS, ()),
    "fx_requests": (fx_requests_sql, ()),
    "fx_llm_attempts": (fx_llm_attempts_sql, ("fx_ext",)),
    "fx_files": (fx_files_sql, ()),
    "fx_job_event_kinds": (lambda d: FX_JOB_EVENT_KINDS, ()),
    "fx_job_events": (lambda d: FX_JOB_EVENTS, ("fx_jobs_full", "fx_job_event_kinds")),
    "fx_retry_requests": (lambda d: FX_RETRY_REQUESTS, ("fx_jobs",)),
    "fx_upload_rows": (fx_upload_rows_sql, ("fx_uploads",)),
    "fx_validation_answers": (lambda d: fx_validation_answers_sql(), ("fx_validations",)),
    "fx_envelopes": (lambda d: FX_ENVELOPES, ("fx_llm_attempts",)),
}


def _closure(names: tuple[str, ...] | list[str]) -> list[str]:
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        need.add(n)

    for n in names:
        visit(n)
    return [n for n in VIEWS if n in need]


def cte_prelude(names: list[str] | tuple[str, ...], d: Dialect = DUCKDB) -> str:
    """``WITH a AS (...), b AS (...)`` for the views an oracle query needs."""
    parts = [f"{n} AS ({VIEWS[n][0](d).strip()})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------------
# Engine-side loaders
# --------------------------------------------------------------------------

def _register_base(spark: SparkSession, sf_dir: str) -> None:
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_LOCK = threading.RLock()
_STORED: dict[tuple[str, str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    return (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)


def _store(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialize a derived table once per application as Parquet below the
    shared checkpoint folder (the stored table the reference's queries read),
    then always read it back from there. What its plan shuffled goes from the
    disks before the next step begins."""
    with _LOCK:
        k = _key(spark, sf_dir, name)
        if k not in _STORED:
            path = shared_dir(spark, f"tables/{name}")
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            _STORED[k] = path
            release(spark)
        return spark.read.parquet(_STORED[k])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over ``sf_dir``, stored once and read back.

    Dependencies are stored first and bound as temp views, so each view's SQL
    runs once over stored inputs."""
    with _LOCK:
        return _store(spark, sf_dir, name, lambda: _built(spark, sf_dir, name))


def _built(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over its stored dependencies, itself not stored."""
    with _LOCK:
        if name in PAIRED:
            return _paired(spark, sf_dir, name)
        for dep in VIEWS[name][1]:
            rows = view(spark, sf_dir, dep)
            if (name, dep) == ("fx_extractions", "fx_uploads"):
                # files are told apart where their session's uploads are, so a
                # session's rows lie together and aggregates combine map-side
                rows = rows.repartition("session_id")
            rows.createOrReplaceTempView(dep)
        _register_base(spark, sf_dir)
        return spark.sql(VIEWS[name][0](SPARK))


# Views that join each row of a table with the text made of the rows of its
# key: name -> (table, key, the same SQL with the text made beside the row).
PAIRED: dict[str, tuple[str, str, Callable[[], str]]] = {
    "fx_llm_attempts": ("fx_ext", "id", lambda: fx_llm_attempts_sql(
        SPARK, "(SELECT x.*, {j} AS js FROM fx_ext x WHERE x.id IS NOT NULL) x", "x.js")),
    "fx_validation_answers": ("fx_validations", "validation_id", lambda: fx_validation_answers_sql(
        "(SELECT v.*, {js} AS js FROM fx_validations v WHERE v.validation_id IS NOT NULL) v", "v.js")),
}


def _paired(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``PAIRED``. Where a key occurs once, its row meets its own
    text alone, so that is made beside it and no text is sent anywhere; only
    rows of repeated keys are joined, by a merge join: the planner guesses a
    text at 20 bytes and would broadcast them all through the driver."""
    table, key, beside = PAIRED[name]
    rows = view(spark, sf_dir, table)
    repeated = _store(spark, sf_dir, f"{table}_repeated", lambda: (
        rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)))
    rows.join(repeated, key, "left_semi").hint("merge").createOrReplaceTempView(table)
    joined = spark.sql(VIEWS[name][0](SPARK))
    rows.join(repeated, key, "left_anti").createOrReplaceTempView(table)
    return spark.sql(beside()).unionByName(joined)


def view_inline(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as one plan over the base tables (no storage); for checks."""
    _register_base(spark, sf_dir)
    return spark.sql(cte_prelude([name], SPARK) + f"SELECT * FROM {name}")


_FLAG_T = T.ArrayType(T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
]))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current extraction rows with real nested sections (flags, fields). The
    scalar rows are widened on the way, not stored first; they lie in runs by
    session, as the numbering of the uploads leaves them, so the wide rows are
    not sorted again (such a sort spilled them several times over)."""
    return _store(spark, sf_dir, "extractions", lambda: _extractions(_built(spark, sf_dir, "fx_ext")))


def _extractions(x: DataFrame) -> DataFrame:

    def flag(sev: str):
        return F.struct(F.lit(sev).alias("severity"),
                        F.concat(F.lit(f"{sev} issue on "), F.col("document_type")).alias("message"))

    flags = (
        F.when(F.col("flag_class") == 0, F.array(flag("CRITICAL"), flag("HIGH")))
        .when(F.col("flag_class") == 1, F.array(flag("HIGH")))
        .when(F.col("flag_class") == 6, F.array(flag("MEDIUM")))
        .when(F.col("flag_class") == 16, F.array(flag("LOW")))
        .when(F.col("flag_class") == -1, F.array().cast(_FLAG_T))
    )
    field = lambda key, label, value, imp, st: F.struct(
        F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"),
        F.lit(imp).alias("importance"), st.alias("status"))
    fields = F.array(
        field("document_number", "Document Number",
              F.concat_ws("-", "document_type", F.col("fid").cast("string")), "CRITICAL",
              F.when(F.col("is_expired"), "EXPIRED").otherwise("OK")),
        field("holder_name", "Holder Name", F.coalesce("holder_name", F.lit("")), "HIGH",
              F.when(F.col("holder_name").isNull() | (F.col("holder_name") == ""), "MISSING")
              .otherwise("OK")),
    )
    lit, null = F.lit, F.lit(None)
    sections = {  # whole, as the answers hold them
        "validity": F.struct(
            F.date_format("date_of_issue", "dd/MM/yyyy").alias("dateOfIssue"),
            F.coalesce(F.date_format("date_of_expiry", "dd/MM/yyyy"), lit("Lifetime")).alias("dateOfExpiry"),
            F.col("is_expired").alias("isExpired"), null.cast("long").alias("daysUntilExpiry"),
            null.cast("boolean").alias("revalidationRequired")),
        "compliance": F.struct(
            F.col("issuing_authority").alias("issuingAuthority"), F.col("regulation_reference").alias("regulationReference"),
            null.cast("string").alias("imoModelCourse"), lit(True).alias("recognizedAuthority"), null.cast("string").alias("limitations")),
        "medical_data": F.struct(
            F.col("fitness_result").alias("fitnessResult"), F.col("drug_test_result").alias("drugTestResult"),
            F.col("medical_restrictions").alias("restrictions"), null.cast("string").alias("specialNotes"),
            null.cast("string").alias("expiryDate")),
        "detection_reason": F.concat(lit("Header reads {"), F.col("document_type"), lit("}"))}
    return (x.withColumn("flags", flags)
             .withColumn("fields", fields)
             .withColumns(sections)
             .withColumn("created_at",
                         F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60))
             .drop("flag_code", "flag_class"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "jobs", lambda: _jobs(view(spark, sf_dir, "fx_jobs_full")))


def _jobs(j: DataFrame) -> DataFrame:
    queued = F.unix_seconds(F.col("queued_at").cast("timestamp"))
    started = queued + F.col("job_id") % 50
    return (j.withColumn("queued_at", F.col("queued_at").cast("timestamp"))
             .withColumn("started_at", F.when(F.col("status") != "QUEUED",
                                              F.timestamp_seconds(started)))
             .withColumn("completed_at", F.when(F.col("status").isin("COMPLETE", "FAILED"),
                                                F.timestamp_seconds(started + 12)))
             .withColumn("file_data", F.when(F.col("has_file_data"),
                                             F.encode(F.col("file_name"), "UTF-8")))
             .drop("has_file_data"))


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_validations")
    return v.withColumn("created_at", F.col("created_at").cast("timestamp"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_sessions")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under their client key: header, peer or ``unknown``."""
    from berth.operators.ratelimit import client_key
    return view(spark, sf_dir, "fx_requests").select(
        client_key("forwarded_for", "peer").alias("client"), "request_id", "ms")


def llm_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_llm_attempts")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_deliveries")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with their bytes (``content``) instead of text."""
    f = view(spark, sf_dir, "fx_files")
    return f.withColumn("content", F.encode(F.col("text"), "UTF-8")).drop("text")
