"""Oracle SQL (DuckDB) for each registered query.

Each entry is an independent SQL formulation of the operator over the same
adapter views (prepended as CTEs), written in the plainest relational form:
EXISTS / NOT EXISTS, ROW_NUMBER, arg_min, FILTER aggregates.
"""

from __future__ import annotations

from berth.functions import prompts
from berth.operators import report as R
from berth.sources import fixtures as fx

AS_OF = f"DATE '{fx.AS_OF}'"

ORACLE: dict[str, str] = {}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


# Reusable CTE fragments: name -> (sql, needed views, needed fragments)
FRAG: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {}


def frag(name: str, sql: str, views: tuple[str, ...] = (), deps: tuple[str, ...] = ()):
    FRAG[name] = (sql, views, deps)


def register(name: str, body: str, views: tuple[str, ...] = (), deps: tuple[str, ...] = ()):
    order: list[str] = []
    all_views: set[str] = set(views)

    def visit(f: str):
        if f in order:
            return
        for d in FRAG[f][2]:
            visit(d)
        all_views.update(FRAG[f][1])
        order.append(f)

    for d in deps:
        visit(d)
    prelude = fx.cte_prelude(sorted(all_views), fx.DUCKDB) if all_views else ""
    extra = ",\n".join(f"{f} AS ({FRAG[f][0].strip()})" for f in order)
    if all_views and extra:
        sql = prelude.rstrip("\n") + ",\n" + extra + "\n" + body
    elif extra:
        sql = "WITH " + extra + "\n" + body
    else:
        sql = prelude + body
    ORACLE[name] = sql


def urgency_sql(days: str) -> str:
    return (f"CASE WHEN {days} < 0 THEN 'EXPIRED' WHEN {days} <= 30 THEN 'CRITICAL' "
            f"WHEN {days} <= 90 THEN 'WARNING' ELSE 'OK' END")


DAYS = f"date_diff('day', {AS_OF}, x.date_of_expiry)"

# ---------------------------------------------------------------- fragments

frag("cx", "SELECT * FROM fx_ext WHERE status = 'COMPLETE'", ("fx_ext",))
frag("role_q", """
SELECT session_id, CASE WHEN d AND e THEN 'BOTH' WHEN d THEN 'DECK' WHEN e THEN 'ENGINE' ELSE 'N/A' END AS detected_role,
  n AS document_count
FROM (SELECT session_id, COALESCE(bool_or(applicable_role IN ('DECK', 'BOTH')), false) AS d,
        COALESCE(bool_or(applicable_role IN ('ENGINE', 'BOTH')), false) AS e, COUNT(*) AS n
      FROM cx GROUP BY session_id) a
""", (), ("cx",))
frag("flag_id", """
SELECT id, bool_or(severity = 'CRITICAL') AS c, bool_or(severity IN ('HIGH', 'MEDIUM')) AS w
FROM fx_ext_flags GROUP BY id
""", ("fx_ext_flags",))
frag("health_q", f"""
SELECT x.session_id,
  CASE WHEN bool_or(COALESCE(fl.c, false) OR COALESCE(x.is_expired AND x.is_required, false)) THEN 'CRITICAL'
       WHEN bool_or(COALESCE(fl.w, false) OR COALESCE(x.date_of_expiry > {AS_OF}
                    AND x.date_of_expiry <= {AS_OF} + 90, false)) THEN 'WARN'
       ELSE 'OK' END AS overall_health
FROM cx x LEFT JOIN flag_id fl ON fl.id = x.id GROUP BY x.session_id
""", (), ("cx", "flag_id"))
frag("roles", """
SELECT s.session_id, COALESCE(r.detected_role, 'N/A') AS detected_role
FROM fx_sessions s LEFT JOIN role_q r ON r.session_id = s.session_id
""", ("fx_sessions",), ("role_q",))
_matrix = ([("DECK", i, c) for i, c in enumerate(R.DECK_CERTS)]
           + [("ENGINE", i, c) for i, c in enumerate(R.ENGINE_CERTS)]
           + [("BOTH", i, c) for i, c in enumerate(R.BOTH_CERTS)])
frag("matrix", _values(_matrix, "role, ord, document_type"))
frag("req", """
SELECT r.session_id, m.ord, m.document_type FROM roles r
JOIN matrix m ON m.role = CASE WHEN r.detected_role IN ('ENGINE', 'BOTH') THEN r.detected_role ELSE 'DECK' END
""", (), ("roles", "matrix"))
_ECDIS = "('ECDIS_GENERIC', 'ECDIS_TYPE')"
_SAT = (f"EXISTS (SELECT 1 FROM cx x WHERE x.session_id = q.session_id AND (x.document_type = q.document_type "
        f"OR (q.document_type IN {_ECDIS} AND x.document_type IN {_ECDIS})))")
frag("present", f"SELECT q.* FROM req q WHERE {_SAT}", (), ("req", "cx"))
frag("missing", f"""
SELECT q.*, CASE WHEN q.document_type IN ('COC', 'SIRB', 'PASSPORT', 'PEME', 'DRUG_TEST') THEN 'CRITICAL'
  ELSE 'HIGH' END AS impact FROM req q WHERE NOT {_SAT}""", (), ("req", "cx"))
frag("additional", """
SELECT x.id, x.session_id, x.document_type, x.document_name FROM cx x
WHERE NOT EXISTS (SELECT 1 FROM req q WHERE q.session_id = x.session_id AND q.document_type = x.document_type)
""", (), ("req", "cx"))
frag("timeline", f"""
SELECT x.id, x.session_id, x.seq, x.document_type, x.document_name, x.date_of_expiry,
  {DAYS} AS days_until_expiry, {urgency_sql(DAYS)} AS urgency
FROM cx x WHERE x.date_of_expiry IS NOT NULL""", (), ("cx",))
frag("flagsum", """
SELECT x.session_id, COUNT(f.pos) AS total, COUNT(*) FILTER (WHERE f.severity = 'CRITICAL') AS critical,
  COUNT(*) FILTER (WHERE f.severity = 'HIGH') AS high, COUNT(*) FILTER (WHERE f.severity = 'MEDIUM') AS medium,
  COUNT(*) FILTER (WHERE f.severity = 'LOW') AS low
FROM cx x LEFT JOIN fx_ext_flags f ON f.id = x.id GROUP BY x.session_id""", ("fx_ext_flags",), ("cx",))
frag("first_peme", """
SELECT * FROM (SELECT x.*, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seq) AS rn
               FROM cx x WHERE document_type = 'PEME') WHERE rn = 1""", (), ("cx",))
frag("first_drug", """
SELECT * FROM (SELECT x.*, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seq) AS rn
               FROM cx x WHERE document_type = 'DRUG_TEST') WHERE rn = 1""", (), ("cx",))
frag("medical", """
SELECT s.session_id,
  CASE WHEN p.session_id IS NULL THEN 'NOT_SUBMITTED' ELSE p.fitness_result END AS fitness_result,
  CASE WHEN d.session_id IS NULL THEN 'NOT_SUBMITTED' ELSE d.drug_test_result END AS drug_test_result,
  p.date_of_expiry AS peme_expiry, p.is_expired AS peme_expired
FROM fx_sessions s LEFT JOIN first_peme p ON p.session_id = s.session_id
LEFT JOIN first_drug d ON d.session_id = s.session_id""", ("fx_sessions",), ("first_peme", "first_drug"))
frag("latest_val", """
SELECT session_id, validation_id, overall_status, overall_score FROM (
  SELECT v.*, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY created_at DESC, validation_id DESC) AS rn
  FROM fx_validations v) WHERE rn = 1""", ("fx_validations",))
frag("blk", """
SELECT session_id, 1 AS ord, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS sort_key,
  CAST(NULL AS VARCHAR) AS doc_id, 'Missing required document: ' || document_type AS text
FROM missing WHERE impact = 'CRITICAL'
UNION ALL
SELECT session_id, 2, days_until_expiry, id,
  'Expired: ' || COALESCE(document_type, 'null') || ' (' || COALESCE(document_name, 'null') || ')'
FROM timeline WHERE urgency = 'EXPIRED'
UNION ALL SELECT session_id, 3, 0, NULL, 'Seafarer declared medically UNFIT' FROM medical WHERE fitness_result = 'UNFIT'
UNION ALL SELECT session_id, 4, 0, NULL, 'Positive drug test result' FROM medical WHERE drug_test_result = 'POSITIVE'
UNION ALL SELECT session_id, 5, 0, NULL, 'PEME not submitted' FROM medical WHERE fitness_result = 'NOT_SUBMITTED'
UNION ALL SELECT session_id, 6, 0, NULL, 'Drug test not submitted' FROM medical WHERE drug_test_result = 'NOT_SUBMITTED'
UNION ALL SELECT session_id, 7, 0, NULL, CAST(critical AS VARCHAR) || ' CRITICAL flag(s) on uploaded documents'
FROM flagsum WHERE critical > 0""", (), ("missing", "timeline", "medical", "flagsum"))
frag("blk_c", """
SELECT *, (text LIKE 'Missing%' OR text LIKE 'Expired%' OR contains(text, 'UNFIT')
           OR contains(text, 'POSITIVE')) AS is_critical FROM blk""", (), ("blk",))
frag("ready", """
SELECT s.session_id,
  CASE WHEN v.validation_id IS NOT NULL THEN v.overall_status WHEN COALESCE(b.n, 0) = 0 THEN 'LIKELY_APPROVED'
       WHEN COALESCE(b.c, 0) > 0 THEN 'LIKELY_REJECTED' ELSE 'NEEDS_REVIEW' END AS readiness_status,
  CASE WHEN v.validation_id IS NOT NULL THEN v.overall_score
       WHEN COALESCE(b.n, 0) = 0 THEN 100 - 10 * COALESCE(f.high, 0) - 5 * COALESCE(f.medium, 0)
       ELSE greatest(0, 100 - 20 * COALESCE(b.c, 0) - 10 * COALESCE(f.high, 0) - 5 * COALESCE(f.medium, 0))
  END AS readiness_score,
  COALESCE(b.n, 0) AS blocker_count, COALESCE(b.c, 0) AS critical_blocker_count,
  v.validation_id IS NOT NULL AS validated
FROM fx_sessions s
LEFT JOIN (SELECT session_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_critical) AS c FROM blk_c GROUP BY session_id) b
  ON b.session_id = s.session_id
LEFT JOIN flagsum f ON f.session_id = s.session_id
LEFT JOIN latest_val v ON v.session_id = s.session_id""", ("fx_sessions",), ("blk_c", "flagsum", "latest_val"))
frag("profile", """
SELECT session_id,
  arg_min(holder_name, seq) FILTER (WHERE holder_name <> '') AS full_name,
  arg_min(date_of_birth, seq) FILTER (WHERE date_of_birth <> '') AS date_of_birth,
  arg_min(nationality, seq) FILTER (WHERE nationality <> '') AS nationality,
  arg_min(passport_number, seq) FILTER (WHERE passport_number <> '') AS passport_number,
  arg_min(sirb_number, seq) FILTER (WHERE sirb_number <> '') AS sirb_number,
  arg_min(rank, seq) FILTER (WHERE rank <> '') AS rank
FROM cx GROUP BY session_id""", (), ("cx",))

# ---------------------------------------------------------------- sessions

# flag counts straight from the flag class, without the join of the flag rows
register("q1_document_listing", """
SELECT x.id, x.session_id, x.file_name, x.document_type, x.document_name, x.applicable_role, x.category,
  x.holder_name, x.confidence, x.is_expired,
  CAST(CASE WHEN x.flag_class = 0 THEN 2 WHEN x.flag_class > 0 THEN 1 ELSE 0 END AS BIGINT) AS flag_count,
  CAST(CASE WHEN x.flag_class = 0 THEN 1 ELSE 0 END AS BIGINT) AS critical_flag_count
FROM cx x""", (), ("cx",))

register("q2_pending_jobs", """
SELECT job_id, session_id, file_name, status, epoch_ms(queued_at) AS queued_ms,
  CASE WHEN status <> 'QUEUED' THEN epoch_ms(queued_at) + (job_id % 50) * 1000 END AS started_ms
FROM fx_jobs_full WHERE status IN ('QUEUED', 'PROCESSING')""", ("fx_jobs_full",))

register("q3_detected_role", "SELECT session_id, detected_role FROM role_q", (), ("role_q",))
register("q4_overall_health", "SELECT session_id, overall_health FROM health_q", (), ("health_q",))
register("q5_session_summary", """
SELECT s.session_id, COALESCE(r.document_count, 0) AS document_count,
  COALESCE(r.detected_role, 'N/A') AS detected_role, COALESCE(h.overall_health, 'OK') AS overall_health,
  COALESCE(p.n, 0) AS pending_job_count
FROM fx_sessions s LEFT JOIN role_q r ON r.session_id = s.session_id
LEFT JOIN health_q h ON h.session_id = s.session_id
LEFT JOIN (SELECT session_id, COUNT(*) AS n FROM fx_jobs WHERE status IN ('QUEUED', 'PROCESSING')
           GROUP BY session_id) p ON p.session_id = s.session_id""",
         ("fx_sessions", "fx_jobs"), ("role_q", "health_q"))
register("q6_expiring_documents", f"""
SELECT x.id, x.session_id, x.file_name, x.document_type, x.document_name, x.date_of_expiry, x.is_expired,
  {DAYS} AS days_until_expiry, {urgency_sql(DAYS)} AS urgency
FROM cx x WHERE x.date_of_expiry IS NOT NULL AND x.date_of_expiry <= {AS_OF} + 90""", (), ("cx",))
register("q7_sessions_with_expired", """
SELECT DISTINCT session_id FROM fx_ext WHERE document_type = 'MARPOL' AND is_expired""", ("fx_ext",))
frag("del_s", "SELECT DISTINCT session_id FROM fx_ext WHERE document_type = 'MARPOL' AND is_expired", ("fx_ext",))
frag("gone_e", """
SELECT id FROM fx_ext WHERE session_id IN (SELECT session_id FROM del_s)
UNION SELECT id FROM fx_ext WHERE status = 'FAILED'""", ("fx_ext",), ("del_s",))
register("q8_cascade_delete", """
SELECT 'extractions' AS tbl, id AS row_id, session_id, CAST(NULL AS VARCHAR) AS ref_id FROM fx_ext
WHERE session_id NOT IN (SELECT session_id FROM del_s) AND status <> 'FAILED'
UNION ALL
SELECT 'jobs', CAST(job_id AS VARCHAR), session_id, CASE WHEN extraction_id IN (SELECT id FROM gone_e) THEN NULL ELSE extraction_id END
FROM fx_jobs WHERE session_id NOT IN (SELECT session_id FROM del_s)
UNION ALL
SELECT 'validations', CAST(validation_id AS VARCHAR), session_id, NULL FROM fx_validations
WHERE session_id NOT IN (SELECT session_id FROM del_s)
UNION ALL
SELECT 'sessions', CAST(session_id AS VARCHAR), session_id, NULL FROM fx_sessions WHERE session_id NOT IN (SELECT session_id FROM del_s)
""", ("fx_ext", "fx_jobs", "fx_validations", "fx_sessions"), ("del_s", "gone_e"))

# ------------------------------------------------------------------ report

register("r1_holder_profile", "SELECT * FROM profile", (), ("profile",))
register("r2_required_certs", "SELECT session_id, ord, document_type FROM req", (), ("req",))
register("r3_cert_present", "SELECT session_id, ord, document_type FROM present", (), ("present",))
register("r4_cert_missing", "SELECT session_id, ord, document_type, impact FROM missing", (), ("missing",))
register("r5_cert_additional", "SELECT * FROM additional", (), ("additional",))
register("r6_expiry_timeline", """
SELECT id, session_id, document_type, document_name, date_of_expiry, days_until_expiry, urgency
FROM timeline""", (), ("timeline",))
register("r7_flag_summary", "SELECT * FROM flagsum", (), ("flagsum",))
register("r8_medical_status", "SELECT * FROM medical", (), ("medical",))
register("r9_latest_validation", "SELECT * FROM latest_val", (), ("latest_val",))
register("r10_blockers", "SELECT session_id, ord, sort_key, doc_id, text, is_critical FROM blk_c", (), ("blk_c",))
register("r11_readiness", "SELECT * FROM ready", (), ("ready",))
register("r12_compliance_report", """
SELECT s.session_id, COALESCE(r.document_count, 0) AS total, p.full_name, p.date_of_birth, p.nationality,
  p.passport_number, p.sirb_number, p.rank, COALESCE(r.detected_role, 'N/A') AS detected_role,
  (SELECT COUNT(*) FROM present q WHERE q.session_id = s.session_id) AS present_count,
  (SELECT COUNT(*) FROM missing q WHERE q.session_id = s.session_id) AS missing_count,
  (SELECT COUNT(*) FROM missing q WHERE q.session_id = s.session_id AND q.impact = 'CRITICAL') AS missing_critical_count,
  (SELECT COUNT(*) FROM additional q WHERE q.session_id = s.session_id) AS additional_count,
  (SELECT COUNT(*) FROM timeline q WHERE q.session_id = s.session_id) AS timeline_count,
  (SELECT COUNT(*) FROM timeline q WHERE q.session_id = s.session_id AND q.days_until_expiry < 0) AS expired_count,
  COALESCE(f.total, 0) AS flags_total, COALESCE(f.critical, 0) AS flags_critical, COALESCE(f.high, 0) AS flags_high,
  COALESCE(f.medium, 0) AS flags_medium, COALESCE(f.low, 0) AS flags_low,
  m.fitness_result, m.drug_test_result, m.peme_expiry, m.peme_expired,
  v.validation_id AS latest_validation_id, rd.readiness_status, rd.readiness_score, rd.blocker_count, rd.validated
FROM fx_sessions s
LEFT JOIN role_q r ON r.session_id = s.session_id
LEFT JOIN profile p ON p.session_id = s.session_id
LEFT JOIN flagsum f ON f.session_id = s.session_id
LEFT JOIN medical m ON m.session_id = s.session_id
LEFT JOIN latest_val v ON v.session_id = s.session_id
LEFT JOIN ready rd ON rd.session_id = s.session_id""", ("fx_sessions",),
         ("role_q", "profile", "present", "missing", "additional", "timeline", "flagsum", "medical",
          "latest_val", "ready"))


# ------------------------------------------------------------------- helpers

FENCE = r"```(?:json)?\s*([\s\S]*?)```"


def span_sql(t: str) -> str:
    """DuckDB twin of functions.expr.json_span."""
    body = f"(CASE WHEN regexp_matches({t}, '{FENCE}') THEN regexp_extract({t}, '{FENCE}', 1) ELSE {t} END)"
    first = f"strpos({body}, '{{')"
    rev = f"strpos(reverse({body}), '}}')"
    last = f"(length({body}) - {rev} + 1)"
    return (f"(CASE WHEN {first} > 0 AND {rev} > 0 AND {last} > {first} "
            f"THEN substr({body}, {first}, {last} - {first} + 1) END)")


def ok_sql(s: str) -> str:
    w = f"('[' || {s} || ']')"
    return (f"COALESCE(CASE WHEN {s} IS NOT NULL AND json_valid({w}) "
            f"THEN json_array_length({w}) = 1 ELSE false END, false)")


# -------------------------------------------------------------- validation

register("v1_validation_eligibility", """
SELECT s.session_id, COALESCE(r.document_count, 0) AS n_complete,
  CASE WHEN COALESCE(r.document_count, 0) >= 2 THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_DOCUMENTS' END AS eligibility
FROM fx_sessions s LEFT JOIN role_q r ON r.session_id = s.session_id""", ("fx_sessions",), ("role_q",))


def _obj(pairs: list[tuple[str, str]], pad: int) -> str:
    """SQL for one JSON object's text; values are SQL for their text."""
    inner = " || ',' || chr(10) || ".join(f"'{' ' * (pad + 2)}\"{k}\": ' || {v}" for k, v in pairs)
    return f"('{{' || chr(10) || {inner} || chr(10) || '{' ' * pad}}}')"


def _str(c: str) -> str:
    return f"COALESCE('\"' || replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"', 'null')"


def _v2_sql() -> str:
    """Every member written out; inside the stored sections keys go by length,
    then by bytes."""
    flag = lambda sev: _obj([("message", _str(f"'{sev} issue on ' || x.document_type")), ("severity", _str(f"'{sev}'"))], 6)
    arr = lambda *items: "'[' || chr(10) || " + " || ',' || chr(10) || ".join(f"'      ' || {i}" for i in items) + " || chr(10) || '    ]'"
    field = lambda key, label, value, imp, st: _obj(
        [("key", _str(f"'{key}'")), ("label", _str(f"'{label}'")), ("value", _str(value)), ("status", _str(st)), ("importance", _str(f"'{imp}'"))], 6)
    fields = arr(
        field("document_number", "Document Number", "x.document_type || '-' || CAST(x.fid AS VARCHAR)", "CRITICAL", "CASE WHEN x.is_expired THEN 'EXPIRED' ELSE 'OK' END"),
        field("holder_name", "Holder Name", "COALESCE(x.holder_name, '')", "HIGH", "CASE WHEN COALESCE(x.holder_name, '') = '' THEN 'MISSING' ELSE 'OK' END"))
    flags = (f"CASE x.flag_class WHEN 0 THEN {arr(flag('CRITICAL'), flag('HIGH'))} WHEN 1 THEN {arr(flag('HIGH'))} "
             f"WHEN 6 THEN {arr(flag('MEDIUM'))} WHEN 16 THEN {arr(flag('LOW'))} WHEN -1 THEN '[]' ELSE 'null' END")
    expired = "CASE WHEN x.is_expired THEN 'true' ELSE 'false' END"
    doc = _obj([
        ("id", _str("x.id")), ("sessionId", "CAST(x.session_id AS VARCHAR)"), ("fileName", _str("x.file_name")),
        ("documentType", _str("x.document_type")), ("documentName", _str("x.document_name")), ("applicableRole", _str("x.applicable_role")),
        ("category", _str("x.category")), ("confidence", _str("x.confidence")), ("holderName", _str("x.holder_name")),
        ("dateOfBirth", _str("x.date_of_birth")), ("sirbNumber", _str("x.sirb_number")), ("passportNumber", _str("x.passport_number")),
        ("fields", fields),
        ("validity", _obj([("isExpired", expired), ("dateOfIssue", _str("strftime(x.date_of_issue, '%d/%m/%Y')")),
                           ("dateOfExpiry", _str("COALESCE(strftime(x.date_of_expiry, '%d/%m/%Y'), 'Lifetime')")),
                           ("daysUntilExpiry", "'null'"), ("revalidationRequired", "'null'")], 4)),
        ("compliance", _obj([("limitations", "'null'"), ("imoModelCourse", "'null'"), ("issuingAuthority", _str("x.issuing_authority")),
                             ("recognizedAuthority", "'true'"), ("regulationReference", _str("x.regulation_reference"))], 4)),
        ("medicalData", _obj([("expiryDate", "'null'"), ("restrictions", _str("x.medical_restrictions")), ("specialNotes", "'null'"),
                              ("fitnessResult", _str("x.fitness_result")), ("drugTestResult", _str("x.drug_test_result"))], 4)),
        ("flags", flags), ("isExpired", expired), ("processingTimeMs", "CAST(x.processing_time_ms AS VARCHAR)"),
        ("summary", _str("x.summary")), ("promptVersion", _str("x.prompt_version")),
        ("createdAt", "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(x.seq AS BIGINT)), '\"%Y-%m-%dT%H:%M:%S.000Z\"')"),
    ], 2)
    head = _sql_str(prompts.VALIDATION_PROMPT + prompts.RECORDS_HEADER + "[\n")
    tail = _sql_str("\n]" + prompts.RECORDS_FOOTER + fx.AS_OF + prompts.DATE_TAIL)
    return f"""
SELECT session_id, COUNT(*) AS n_docs, arg_min(id, seq) AS first_id, arg_max(id, seq) AS last_id,
  {head} || string_agg('  ' || doc, ',' || chr(10) ORDER BY seq) || {tail} AS p
FROM (SELECT x.session_id, x.id, x.seq, {doc} AS doc FROM cx x) GROUP BY session_id HAVING COUNT(*) >= 2"""


frag("v2p", _v2_sql(), (), ("cx",))
register("v2_validation_requests", """
SELECT session_id, n_docs, first_id, last_id, length(p) AS prompt_len, sha256(p) AS prompt_sha FROM v2p""", (), ("v2p",))
frag("va", f"""
SELECT validation_id, session_id, stage, sp AS span, {ok_sql('sp')} AS ok
FROM (SELECT *, {span_sql('raw_text')} AS sp FROM fx_validation_answers)""", ("fx_validation_answers",))
frag("v3p", f"""
SELECT *, 'model-1' AS llm_model, CASE WHEN validation_id % 3 = 0 THEN 'anthropic' WHEN validation_id % 3 = 1 THEN 'openai' ELSE 'gemini' END AS llm_provider
FROM (SELECT *, CASE WHEN i_ok THEN i_span WHEN r_ok THEN r_span END AS c FROM (
  SELECT validation_id, session_id, max(length(raw_text)) FILTER (WHERE stage = 'INITIAL') AS prompt_tokens,
    max(span) FILTER (WHERE stage = 'INITIAL') AS i_span, bool_or(ok) FILTER (WHERE stage = 'INITIAL') AS i_ok,
    max(span) FILTER (WHERE stage = 'REPAIR') AS r_span, bool_or(ok) FILTER (WHERE stage = 'REPAIR') AS r_ok
  FROM (SELECT va.*, a.raw_text FROM va JOIN fx_validation_answers a USING (validation_id, stage)) GROUP BY validation_id, session_id))""",
     ("fx_validation_answers",), ("va",))
register("v3_parse_validations", f"""
SELECT validation_id, session_id, COALESCE(i_ok OR r_ok, false) AS ok, NOT COALESCE(i_ok, false) AS used_repair,
  json_extract_string(c, '$.overallStatus') AS overall_status, CAST(json_extract(c, '$.overallScore') AS BIGINT) AS overall_score,
  json_extract_string(c, '$.summary') AS summary, CAST(json_array_length(c, '$.recommendations') AS BIGINT) AS n_recommendations,
  {_sql_str(prompts.VALIDATION_PROMPT_VERSION)} AS prompt_version, llm_provider, llm_model, prompt_tokens,
  CASE WHEN c IS NOT NULL THEN '{{"overallScore":' || json_extract_string(c, '$.overallScore') || ',"overallStatus":"' || json_extract_string(c, '$.overallStatus') || '"'
    || COALESCE(',"recommendations":' || CAST(json_extract(c, '$.recommendations') AS VARCHAR), '')
    || COALESCE(',"summary":"' || json_extract_string(c, '$.summary') || '"', '') || '}}' END AS result_json
FROM v3p""", (), ("v3p",))
register("r9_latest_validation_full", f"""
SELECT session_id, validation_id, overall_status, overall_score, {_sql_str(prompts.VALIDATION_PROMPT_VERSION)} AS prompt_version, llm_provider, llm_model,
  json_extract_string(c, '$.summary') AS summary, CAST(COALESCE(json_array_length(c, '$.recommendations'), 0) AS BIGINT) AS n_recommendations,
  epoch_us(created_at) AS validated_us
FROM (SELECT v.*, p.c, p.llm_provider, p.llm_model, ROW_NUMBER() OVER (PARTITION BY v.session_id ORDER BY v.created_at DESC, v.validation_id DESC) AS rn
      FROM fx_validations v JOIN v3p p USING (validation_id)) WHERE rn = 1""", ("fx_validations",), ("v3p",))
frag("v4c", """
SELECT session_id, field,
  CASE WHEN COUNT(v) < 2 THEN 'INSUFFICIENT_DATA' WHEN COUNT(DISTINCT v) = 1 THEN 'CONSISTENT'
       ELSE 'INCONSISTENT' END AS status,
  COUNT(v) AS n_values, COALESCE(string_agg(DISTINCT v, '|' ORDER BY v), '') AS values_joined
FROM (SELECT session_id, field, CASE WHEN upper(trim(raw)) <> '' THEN upper(trim(raw)) END AS v FROM (
  SELECT session_id, 'fullName' AS field, holder_name AS raw FROM cx
  UNION ALL SELECT session_id, 'dateOfBirth', date_of_birth FROM cx
  UNION ALL SELECT session_id, 'nationality', nationality FROM cx
  UNION ALL SELECT session_id, 'passportNumber', passport_number FROM cx
  UNION ALL SELECT session_id, 'sirbNumber', sirb_number FROM cx))
GROUP BY session_id, field""", (), ("cx",))
register("v4_consistency_checks", "SELECT * FROM v4c", (), ("v4c",))
register("v5_rule_missing", """
SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS ord, document_type,
  true AS is_required, impact FROM missing""", (), ("missing",))
register("v6_rule_expiring", f"""
SELECT x.id, x.session_id, x.document_type, x.date_of_expiry, {DAYS} AS days_until_expiry,
  {urgency_sql(DAYS)} AS urgency
FROM cx x WHERE x.date_of_expiry IS NOT NULL AND x.date_of_expiry <= {AS_OF} + 90""", (), ("cx",))
_PDAYS = f"date_diff('day', {AS_OF}, p.date_of_expiry)"
register("v7_medical_flags", f"""
SELECT s.session_id, t.type,
  CASE t.type
    WHEN 'FITNESS' THEN CASE WHEN p.session_id IS NULL THEN 'MISSING' WHEN p.fitness_result = 'UNFIT' THEN 'FAIL'
                             WHEN p.fitness_result = 'FIT' THEN 'PASS' ELSE 'WARNING' END
    WHEN 'DRUG_TEST' THEN CASE WHEN d.session_id IS NULL THEN 'MISSING' WHEN d.drug_test_result = 'POSITIVE' THEN 'FAIL'
                               WHEN d.drug_test_result = 'NEGATIVE' THEN 'PASS' ELSE 'WARNING' END
    WHEN 'RESTRICTION' THEN CASE WHEN p.session_id IS NULL THEN 'MISSING'
                                 WHEN COALESCE(trim(p.medical_restrictions) <> '', false) THEN 'WARNING' ELSE 'PASS' END
    ELSE CASE WHEN p.session_id IS NULL THEN 'MISSING' WHEN {_PDAYS} < 0 THEN 'FAIL'
              WHEN {_PDAYS} <= 90 THEN 'WARNING' ELSE 'PASS' END
  END AS status
FROM fx_sessions s LEFT JOIN first_peme p ON p.session_id = s.session_id
LEFT JOIN first_drug d ON d.session_id = s.session_id
CROSS JOIN (SELECT * FROM (VALUES ('FITNESS'), ('DRUG_TEST'), ('RESTRICTION'), ('EXPIRY')) AS v(type)) t""",
         ("fx_sessions",), ("first_peme", "first_drug"))
register("v8_rule_score", f"""
SELECT session_id, rule_score,
  CASE WHEN rule_score < 45 OR critical_blocker THEN 'REJECTED' WHEN rule_score >= 75 THEN 'APPROVED'
       ELSE 'CONDITIONAL' END AS rule_status, critical_blocker, mismatches
FROM (
  SELECT f.session_id,
    CASE WHEN COALESCE(m.fitness_result = 'UNFIT' OR m.drug_test_result = 'POSITIVE', false) THEN 0
         ELSE least(100, greatest(0, 100 - 10 * COALESCE(mc.miss, 0) - 18 * f.er - 4 * f.ex - 15 * fl.critical
                                  - 7 * fl.high - 3 * fl.medium - 10 * COALESCE(cs.mm, 0))) END AS rule_score,
    (COALESCE(mc.miss_crit, false) OR f.ec > 0
     OR COALESCE(m.fitness_result = 'UNFIT' OR m.drug_test_result = 'POSITIVE', false)
     OR (COALESCE(cs.nb, false) AND COALESCE(cs.db, false))) AS critical_blocker,
    COALESCE(cs.mm, 0) AS mismatches
  FROM (SELECT session_id, COUNT(*) AS n,
          COUNT(*) FILTER (WHERE d < 0 AND COALESCE(is_required, false)) AS er,
          COUNT(*) FILTER (WHERE d >= 0 AND d <= 90) AS ex,
          COUNT(*) FILTER (WHERE d < 0 AND document_type IN ('COC', 'SIRB', 'PASSPORT', 'PEME', 'DRUG_TEST')) AS ec
        FROM (SELECT x.*, {DAYS} AS d FROM cx x) GROUP BY session_id) f
  JOIN flagsum fl ON fl.session_id = f.session_id
  JOIN medical m ON m.session_id = f.session_id
  LEFT JOIN (SELECT session_id, COUNT(*) AS miss, bool_or(document_type IN ('COC', 'SIRB', 'PASSPORT')) AS miss_crit
             FROM missing GROUP BY session_id) mc ON mc.session_id = f.session_id
  LEFT JOIN (SELECT session_id, COUNT(*) FILTER (WHERE status = 'INCONSISTENT') AS mm,
               bool_or(field = 'fullName' AND status = 'INCONSISTENT') AS nb,
               bool_or(field = 'dateOfBirth' AND status = 'INCONSISTENT') AS db
             FROM v4c GROUP BY session_id) cs ON cs.session_id = f.session_id
  WHERE f.n >= 2)""", (), ("cx", "flagsum", "medical", "missing", "v4c"))

# -------------------------------------------------------------------- jobs

_TS = "TIMESTAMP '2024-06-30 00:00:00'"
frag("qpos", """
SELECT job_id, COUNT(*) OVER (ORDER BY queued_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS queue_position
FROM fx_jobs WHERE status = 'QUEUED'""", ("fx_jobs",))
register("j2_queue_positions", "SELECT * FROM qpos", (), ("qpos",))
register("j1_job_status", f"""
SELECT j.job_id, j.session_id, j.view_status,
  CASE WHEN j.view_status = 'QUEUED' THEN p.queue_position END AS queue_position,
  CASE WHEN j.view_status = 'PROCESSING' THEN greatest(0, 15000 - (epoch_ms({_TS})
       - (epoch_ms(j.queued_at) + (j.job_id % 50) * 1000))) END AS estimated_complete_ms,
  CASE WHEN j.view_status = 'COMPLETE' THEN j.extraction_id END AS extraction_id,
  CASE WHEN j.view_status = 'COMPLETE' THEN x.document_type END AS result_document_type,
  CASE WHEN j.view_status = 'FAILED' THEN j.error_code END AS error_code,
  CASE WHEN j.view_status = 'FAILED' THEN j.retryable END AS retryable
FROM (SELECT *, CASE WHEN status = 'QUEUED' THEN 'QUEUED' WHEN status = 'PROCESSING' THEN 'PROCESSING'
                     WHEN status = 'COMPLETE' AND extraction_id IS NOT NULL THEN 'COMPLETE' ELSE 'FAILED' END AS view_status
      FROM fx_jobs_full) j
LEFT JOIN qpos p ON p.job_id = j.job_id LEFT JOIN fx_ext x ON x.id = j.extraction_id""",
         ("fx_jobs_full", "fx_ext"), ("qpos",))
register("j3_retry_eligibility", """
SELECT r.request_job_id,
  CASE WHEN j.job_id IS NULL THEN 'JOB_NOT_FOUND' WHEN j.status <> 'FAILED' THEN 'JOB_NOT_FAILED'
       WHEN NOT j.retryable THEN 'JOB_NOT_RETRYABLE' WHEN NOT j.has_file_data THEN 'JOB_DATA_UNAVAILABLE'
       ELSE 'OK' END AS code
FROM fx_retry_requests r LEFT JOIN fx_jobs j ON j.job_id = r.request_job_id""", ("fx_retry_requests", "fx_jobs"))
register("j4_requeue", f"""
SELECT job_id, CASE WHEN e THEN 'QUEUED' ELSE status END AS status,
  CASE WHEN e THEN NULL ELSE extraction_id END AS extraction_id,
  CASE WHEN e THEN NULL ELSE error_code END AS error_code,
  CASE WHEN e THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN e THEN epoch_ms({_TS}) ELSE epoch_ms(queued_at) END AS queued_ms, retryable
FROM (SELECT *, (status = 'FAILED' AND retryable AND has_file_data) AS e FROM fx_jobs_full)""", ("fx_jobs_full",))
register("j5_job_state", """
SELECT job_id,
  CASE WHEN lk IN ('queued', 'requeued') THEN 'QUEUED' WHEN lk IN ('started', 'attempt_failed') THEN 'PROCESSING'
       WHEN lk = 'completed' THEN 'COMPLETE' WHEN lk = 'final_failed' THEN 'FAILED' END AS status,
  CASE WHEN st_seq > COALESCE(rs, -1) THEN st_at END AS started_ms,
  CASE WHEN t_seq > COALESCE(rs, -1) THEN t_at END AS completed_ms,
  CASE WHEN t_seq > COALESCE(rs, -1) THEN t_eid END AS extraction_id,
  CASE WHEN t_seq > COALESCE(rs, -1) AND t_kind = 'final_failed' THEN
    CASE WHEN contains(t_msg, 'timed out') THEN 'LLM_TIMEOUT' ELSE 'LLM_ERROR' END END AS error_code,
  CASE WHEN t_seq > COALESCE(rs, -1) AND t_kind = 'final_failed' THEN t_msg END AS error_message,
  COALESCE(anyff, false) AS retryable,
  CASE WHEN t_seq > COALESCE(rs, -1) AND t_kind = 'final_failed' THEN t_attempt ELSE 0 END AS retry_count,
  NOT COALESCE(t_seq > COALESCE(rs, -1) AND t_kind = 'completed', false) AS has_file_data
FROM (SELECT job_id, arg_max(kind, seq) AS lk,
        max(seq) FILTER (WHERE kind IN ('queued', 'requeued')) AS rs,
        max(seq) FILTER (WHERE kind = 'started') AS st_seq,
        arg_max_null(at_ms, seq) FILTER (WHERE kind = 'started') AS st_at,
        max(seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_seq,
        arg_max_null(kind, seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_kind,
        arg_max_null(at_ms, seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_at,
        arg_max_null(extraction_id, seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_eid,
        arg_max_null(error_message, seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_msg,
        arg_max_null(attempt, seq) FILTER (WHERE kind IN ('completed', 'final_failed')) AS t_attempt,
        bool_or(kind = 'final_failed') AS anyff
      FROM fx_job_events GROUP BY job_id)""", ("fx_job_events",))
register("j6_retry_schedule", """
SELECT job_id, attempt, CASE WHEN attempt < 3 THEN CAST(5000 * pow(2, attempt - 1) AS BIGINT) END AS next_delay_ms
FROM fx_job_events WHERE kind IN ('attempt_failed', 'final_failed')""", ("fx_job_events",))


def _j7_sql(secret: str) -> str:
    from berth.functions.expr import hmac_pads_hex
    ipad, opad = hmac_pads_hex(secret)
    ts = "strftime(queued_at + (job_id % 50 + 12) * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ')"
    head = ("'\"jobId\":\"' || CAST(job_id AS VARCHAR) || '\",\"sessionId\":\"' || CAST(session_id AS VARCHAR) "
            "|| '\",\"extractionId\":' || COALESCE('\"' || CAST(extraction_id AS VARCHAR) || '\"', 'null')")
    body = ("CASE WHEN status = 'COMPLETE' THEN '{\"event\":\"JOB_COMPLETED\",' || " + head
            + " || ',\"status\":\"COMPLETE\",\"timestamp\":\"' || " + ts + " || '\"}' "
            "ELSE '{\"event\":\"JOB_FAILED\",' || " + head
            + " || ',\"status\":\"FAILED\",\"error\":{\"code\":' || COALESCE(to_json(error_code), 'null') "
            "|| ',\"message\":' || COALESCE(to_json(error_message), 'null') || '},\"timestamp\":\"' || "
            + ts + " || '\"}' END")
    return f"""
SELECT job_id, event, body,
  'sha256=' || sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(body)))) AS signature
FROM (SELECT job_id, CASE WHEN status = 'COMPLETE' THEN 'JOB_COMPLETED' ELSE 'JOB_FAILED' END AS event,
        CAST({body} AS VARCHAR) AS body
      FROM fx_jobs_full WHERE status IN ('COMPLETE', 'FAILED') AND webhook_url IS NOT NULL)"""


register("j7_notifications", _j7_sql("whsec_test"), ("fx_jobs_full",))
frag("ledger", """
SELECT j.job_id, j.status, COALESCE(d.n, 0) AS webhook_attempts, d.last_error AS webhook_last_error,
  d.delivered AS delivered_at_ms
FROM fx_jobs j LEFT JOIN (
  SELECT job_id, COUNT(*) AS n, arg_max_null(error, attempt_no) AS last_error,
    arg_max(at_ms, attempt_no) FILTER (WHERE ok) AS delivered
  FROM fx_deliveries GROUP BY job_id) d ON d.job_id = j.job_id
WHERE j.webhook_url IS NOT NULL""", ("fx_jobs", "fx_deliveries"))
register("j8_delivery_ledger", "SELECT * FROM ledger", (), ("ledger",))
register("j9_undelivered", """
SELECT job_id, status, webhook_attempts FROM ledger
WHERE status IN ('COMPLETE', 'FAILED') AND delivered_at_ms IS NULL""", (), ("ledger",))
register("j10_retain", """
SELECT job_id, status FROM (
  SELECT job_id, status, ROW_NUMBER() OVER (PARTITION BY status
    ORDER BY epoch_ms(queued_at) + (job_id % 50 + 12) * 1000 DESC, job_id DESC) AS rn
  FROM fx_jobs WHERE status IN ('COMPLETE', 'FAILED'))
WHERE rn <= CASE WHEN status = 'COMPLETE' THEN 1000 ELSE 5000 END""", ("fx_jobs",))


# ------------------------------------------------------------- limiter

frag("rl", """
WITH RECURSIVE r AS (
  SELECT client, request_id, ms, ROW_NUMBER() OVER (PARTITION BY client ORDER BY ms, request_id) AS rn
  FROM (SELECT request_id, ms,
          CASE WHEN forwarded_for IS NOT NULL THEN trim(split_part(forwarded_for, ',', 1))
               WHEN peer IS NOT NULL THEN peer ELSE 'unknown' END AS client FROM fx_requests)),
s AS (
  SELECT client, rn, request_id, ms, ms AS anchor, 9 AS tok, true AS allowed FROM r WHERE rn = 1
  UNION ALL
  SELECT r.client, r.rn, r.request_id, r.ms,
    CASE WHEN r.ms - s.anchor >= 60000 THEN r.ms ELSE s.anchor END,
    CASE WHEN r.ms - s.anchor >= 60000 THEN 9 WHEN s.tok > 0 THEN s.tok - 1 ELSE 0 END,
    (r.ms - s.anchor >= 60000) OR s.tok > 0
  FROM s JOIN r ON r.client = s.client AND r.rn = s.rn + 1)
SELECT client, request_id, ms, allowed,
  CASE WHEN NOT allowed THEN 60000 - (ms - anchor) END AS retry_after_ms,
  CASE WHEN NOT allowed THEN CAST(ceil((60000 - (ms - anchor)) / 1000.0) AS BIGINT) END AS retry_after_sec
FROM s""", ("fx_requests",))
register("t1_rate_limit", "SELECT * FROM rl", (), ("rl",))
register("t1_rate_limit_split", "SELECT * FROM rl", (), ("rl",))

# ------------------------------------------------------------------ intake

register("p1_triage_uploads", r"""
SELECT f.upload_id,
  CASE WHEN NOT COALESCE(v.allowed, true) THEN 'RATE_LIMITED'
       WHEN f.text IS NOT NULL AND f.mime_type NOT IN ('image/jpeg', 'image/png', 'application/pdf') THEN 'UNSUPPORTED_FORMAT'
       WHEN f.text IS NOT NULL AND f.size_bytes > 10485760 THEN 'FILE_TOO_LARGE'
       WHEN f.text IS NULL THEN 'MISSING_FILE'
       WHEN COALESCE(lower(f.mode) = 'sync', false) = false AND f.webhook_url IS NOT NULL AND f.webhook_url <> ''
            AND NOT COALESCE(regexp_matches(f.webhook_url, '^https?://[^/\s]+'), false) THEN 'INVALID_WEBHOOK_URL'
       ELSE 'ACCEPTED' END AS outcome,
  CASE WHEN lower(f.mode) = 'sync' THEN 'sync' ELSE 'async' END AS mode
FROM fx_files f LEFT JOIN rl v ON v.request_id = f.request_id""", ("fx_files",), ("rl",))
register("p2_resolve_sessions", """
SELECT f.upload_id,
  CASE WHEN s.session_id IS NOT NULL THEN CAST(f.session_id AS VARCHAR)
       ELSE sha256('session:' || CAST(f.upload_id AS VARCHAR)) END AS resolved_session_id,
  s.session_id IS NULL AS is_new
FROM fx_files f LEFT JOIN fx_sessions s ON s.session_id = f.session_id""", ("fx_files", "fx_sessions"))
# a file's first upload is its extraction (FAILED at v % 25 = 24): one window
# over the uploads instead of a join of two copies of them
register("p3_find_duplicates", """
SELECT session_id, seq, CAST(session_id AS VARCHAR) || '-' || CAST(first_seq AS VARCHAR) AS existing_extraction_id
FROM (SELECT session_id, seq, first_value(seq) OVER w AS first_seq, first_value(v) OVER w AS first_v
      FROM fx_uploads WINDOW w AS (PARTITION BY session_id, fid ORDER BY seq))
WHERE first_v % 25 <> 24""", ("fx_uploads",))
register("p4_new_work", """
SELECT session_id, seq, fid, file_hash FROM (
  SELECT u.*, ROW_NUMBER() OVER (PARTITION BY u.session_id, u.file_hash ORDER BY u.seq) AS rn
  FROM fx_upload_rows u
  WHERE NOT EXISTS (SELECT 1 FROM cx x WHERE x.session_id = u.session_id AND x.file_hash = u.file_hash))
WHERE rn = 1""", ("fx_upload_rows",), ("cx",))
register("p5_unknown_ids", """
SELECT DISTINCT session_id FROM fx_files f
WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_sessions s WHERE s.session_id = f.session_id)""",
         ("fx_files", "fx_sessions"))

# ----------------------------------------------------------------- sources

register("s1_read_table", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
register("s2_intake_files", """
SELECT upload_id, octet_length(encode(text)) AS size_bytes, sha256(text) AS file_hash,
  length(to_base64(encode(text))) AS b64_len, file_name, mime_type
FROM fx_files""", ("fx_files",))
register("s3_intake_stream", """
SELECT doc_id AS upload_id, octet_length(encode(text)) AS size_bytes, sha256(text) AS file_hash,
  length(to_base64(encode(text))) AS b64_len
FROM documents""")
register("s2_binary_files", """
SELECT 'doc ' || CAST(doc_id AS VARCHAR) || CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.Pdf'
    WHEN 4 THEN '' ELSE '.txt' END AS file_name,
  CASE WHEN doc_id % 6 IN (0, 1) THEN 'image/jpeg' WHEN doc_id % 6 = 2 THEN 'image/png' WHEN doc_id % 6 = 3 THEN 'application/pdf'
    ELSE 'application/octet-stream' END AS mime_type,
  octet_length(encode(c)) AS size_bytes, sha256(c) AS file_hash, length(to_base64(encode(c))) AS b64_len
FROM (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN '' ELSE coalesce(text, '') END AS c FROM documents)""")
register("s4_validation_snapshot", """
SELECT validation_id, session_id, CASE WHEN CAST(created_at AS DATE) = DATE '2024-01-10' THEN overall_score + 1 ELSE overall_score END AS overall_score,
  overall_status, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date FROM fx_validations""", ("fx_validations",))
register("s4_write_snapshot", "SELECT id, session_id, document_type, status, is_expired FROM cx", (), ("cx",))

# ----------------------------------------------------------------- answers


def _x1_sql() -> str:
    from berth.functions import prompts
    p = f"to_json({_sql_str(prompts.EXTRACTION_PROMPT)})"
    anth = ("'{\"model\":\"model-x\",\"max_tokens\":4096,\"messages\":[{\"role\":\"user\",\"content\":"
            "[{\"type\":\"image\",\"source\":{\"type\":\"base64\",\"media_type\":\"' || mime_type || "
            "'\",\"data\":\"' || b64 || '\"}},{\"type\":\"text\",\"text\":' || " + p + " || '}]}]}'")
    oai = ("'{\"model\":\"model-x\",\"max_tokens\":4096,\"messages\":[{\"role\":\"user\",\"content\":"
           "[{\"type\":\"image_url\",\"image_url\":{\"url\":\"data:' || mime_type || ';base64,' || b64 || "
           "'\"}},{\"type\":\"text\",\"text\":' || " + p + " || '}]}]}'")
    gem = ("'{\"contents\":[{\"parts\":[{\"inline_data\":{\"mime_type\":\"' || mime_type || "
           "'\",\"data\":\"' || b64 || '\"}},{\"text\":' || " + p + " || '}]}]}'")
    return f"""
SELECT upload_id, provider, length(body) AS body_len, sha256(body) AS body_sha FROM (
  SELECT upload_id, provider,
    CASE provider WHEN 'anthropic' THEN {anth} WHEN 'openai' THEN {oai} ELSE {gem} END AS body
  FROM (SELECT upload_id, mime_type, to_base64(encode(text)) AS b64,
          CASE WHEN upload_id % 3 = 0 THEN 'anthropic' WHEN upload_id % 3 = 1 THEN 'openai' ELSE 'gemini' END AS provider
        FROM fx_files WHERE text IS NOT NULL AND mime_type IN ('image/jpeg', 'image/png', 'application/pdf')))"""


register("x1_request_rows", _x1_sql(), ("fx_files",))
register("x2_decode_envelopes", """
SELECT session_id, fid, attempt_no, provider,
  COALESCE(CASE provider WHEN 'gemini' THEN json_extract_string(envelope, '$.candidates[0].content.parts[0].text')
                WHEN 'anthropic' THEN json_extract_string(envelope, '$.content[0].text')
                ELSE json_extract_string(envelope, '$.choices[0].message.content') END, '') AS text,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.promptTokenCount') AS BIGINT)
                WHEN 'anthropic' THEN CAST(json_extract(envelope, '$.usage.input_tokens') AS BIGINT)
                ELSE CAST(json_extract(envelope, '$.usage.prompt_tokens') AS BIGINT) END AS prompt_tokens,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.candidatesTokenCount') AS BIGINT)
                WHEN 'anthropic' THEN CAST(json_extract(envelope, '$.usage.output_tokens') AS BIGINT)
                ELSE CAST(json_extract(envelope, '$.usage.completion_tokens') AS BIGINT) END AS completion_tokens,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.totalTokenCount') AS BIGINT)
                WHEN 'anthropic' THEN CASE WHEN json_extract(envelope, '$.usage') IS NOT NULL THEN
                  COALESCE(CAST(json_extract(envelope, '$.usage.input_tokens') AS BIGINT), 0)
                  + COALESCE(CAST(json_extract(envelope, '$.usage.output_tokens') AS BIGINT), 0) END
                ELSE CAST(json_extract(envelope, '$.usage.total_tokens') AS BIGINT) END AS total_tokens
FROM fx_envelopes""", ("fx_envelopes",))
frag("att", f"""
SELECT a.*, sp AS span, {ok_sql('sp')} AS ok,
  CASE WHEN {ok_sql('sp')} THEN json_type(sp, '$.detection') = 'OBJECT' END AS has_det,
  CASE WHEN {ok_sql('sp')} THEN json_extract_string(sp, '$.detection.confidence') END AS conf
FROM (SELECT *, {span_sql('raw_text')} AS sp FROM fx_llm_attempts) a""", ("fx_llm_attempts",))
register("x3_json_span", "SELECT session_id, fid, attempt_no, span FROM att", (), ("att",))
register("x4_parse_extractions", """
SELECT session_id, fid, attempt_no, ok,
  CASE WHEN ok THEN json_extract_string(span, '$.detection.documentType') END AS document_type,
  conf AS confidence FROM att""", (), ("att",))


def _stage(stage: str, p: str) -> str:
    f = f"FILTER (WHERE stage = '{stage}')"
    return (f"count(*) {f} > 0 AS {p}_has, max(error_message) {f} AS {p}_msg, "
            f"COALESCE(bool_or(ok) {f}, false) AS {p}_ok0, max(raw_text) {f} AS {p}_raw, "
            f"max(span) {f} AS {p}_span, bool_or(has_det) {f} AS {p}_det, max(conf) {f} AS {p}_conf")


frag("res", f"""
SELECT session_id, fid, error_message,
  CASE WHEN error_message IS NULL THEN 'COMPLETE' ELSE 'FAILED' END AS status,
  CASE WHEN error_message IS NULL THEN stage0 END AS stage, raw_text, retry_count,
  CASE WHEN error_message IS NOT NULL THEN
    CASE WHEN contains(error_message, 'timed out') THEN 'LLM_TIMEOUT' ELSE 'LLM_ERROR' END END AS error_code
FROM (
  SELECT session_id, fid,
    CASE WHEN i_err THEN i_msg WHEN r_err THEN r_msg
         WHEN need_r AND NOT r_has THEN 'No JSON object found in LLM response'
         WHEN need_r AND NOT r_ok THEN CASE WHEN r_span IS NULL THEN 'No JSON object found in LLM response'
                                            ELSE 'Unexpected token in JSON' END
         WHEN NOT COALESCE(c_det, false) THEN 'Cannot read properties of undefined (reading ''confidence'')'
         WHEN l_err THEN l_msg END AS error_message,
    CASE WHEN adopt THEN 'LOW_CONF_RETRY' WHEN use_i THEN 'INITIAL' WHEN r_ok THEN 'REPAIR' END AS stage0,
    CASE WHEN i_err THEN NULL WHEN adopt THEN l_raw WHEN use_i THEN i_raw ELSE COALESCE(r_raw, i_raw) END AS raw_text,
    CAST(need_r AS INTEGER) + CAST(low_run AS INTEGER) AS retry_count
  FROM (
    SELECT *, low_run AND l_has AND l_msg IS NOT NULL AS l_err,
      low_run AND l_has AND l_msg IS NULL AND l_ok0 AND COALESCE(l_det, false) AND COALESCE(l_conf, '') <> 'LOW' AS adopt
    FROM (
      SELECT *, (use_i OR r_ok) AND COALESCE(c_det, false) AND COALESCE(c_conf, '') = 'LOW' AS low_run
      FROM (
        SELECT *, CASE WHEN use_i THEN COALESCE(i_det, false) WHEN r_ok THEN COALESCE(r_det, false) END AS c_det,
          CASE WHEN use_i THEN i_conf WHEN r_ok THEN r_conf END AS c_conf
        FROM (
          SELECT *, need_r AND r_has AND r_msg IS NOT NULL AS r_err,
            need_r AND r_has AND r_msg IS NULL AND r_ok0 AS r_ok
          FROM (
            SELECT *, i_msg IS NOT NULL AS i_err, i_msg IS NULL AND i_ok0 AS use_i,
              i_msg IS NULL AND NOT i_ok0 AS need_r
            FROM (SELECT session_id, fid, {_stage('INITIAL', 'i')}, {_stage('REPAIR', 'r')},
                    {_stage('LOW_CONF_RETRY', 'l')}
                  FROM att GROUP BY session_id, fid)))))))""", (), ("att",))
register("x5_resolve_attempts", """
SELECT session_id, fid, status, stage, retry_count, error_code, error_message, sha256(raw_text) AS raw_sha FROM res""", (), ("res",))


def _low_prompt_sql() -> str:
    from berth.functions import prompts as pr
    return (f"{_sql_str(pr.EXTRACTION_PROMPT + pr.LOW_CONF_HEAD)} || file_name || "
            f"{_sql_str(pr.LOW_CONF_MIME)} || mime_type || {_sql_str(pr.LOW_CONF_TAIL)}")


def _repair_prompt_sql() -> str:
    from berth.functions import prompts as pr
    return f"{_sql_str(pr.REPAIR_PREFIX)} || raw_text || {_sql_str(pr.REPAIR_SUFFIX)}"


register("x6_followup_requests", f"""
SELECT session_id, fid, kind, length(prompt) AS prompt_len, sha256(prompt) AS prompt_sha FROM (
  SELECT session_id, fid, 'REPAIR' AS kind, {_repair_prompt_sql()} AS prompt
  FROM att WHERE stage = 'INITIAL' AND error_message IS NULL AND NOT ok
  UNION ALL
  SELECT session_id, fid, 'LOW_CONF_RETRY', {_low_prompt_sql()} FROM (
    SELECT session_id, fid, arg_min(file_name, attempt_no) AS file_name, arg_min(mime_type, attempt_no) AS mime_type,
      arg_min_null(conf, attempt_no) AS conf
    FROM att WHERE stage IN ('INITIAL', 'REPAIR') AND ok AND error_message IS NULL GROUP BY session_id, fid)
  WHERE conf = 'LOW')""", (), ("att",))
register("x1_text_requests", f"""
SELECT key, kind, provider, length(body) AS body_len, sha256(body) AS body_sha FROM (
  SELECT key, kind, provider, CASE provider WHEN 'gemini' THEN '{{"contents":[{{"parts":[{{"text":' || to_json(prompt) || '}}]}}]}}'
    ELSE '{{"model":"model-x","max_tokens":4096,"messages":[{{"role":"user","content":' || to_json(prompt) || '}}]}}' END AS body
  FROM (SELECT key, kind, prompt, CASE WHEN session_id % 3 = 0 THEN 'anthropic' WHEN session_id % 3 = 1 THEN 'openai' ELSE 'gemini' END AS provider
        FROM (SELECT CAST(session_id AS VARCHAR) || '-' || CAST(fid AS VARCHAR) AS key, 'REPAIR' AS kind, session_id, {_repair_prompt_sql()} AS prompt
              FROM att WHERE stage = 'INITIAL' AND error_message IS NULL AND NOT ok
              UNION ALL SELECT CAST(session_id AS VARCHAR), 'VALIDATION', session_id, p FROM v2p)))""", (), ("att", "v2p"))
register("x7_classify_failures", """
SELECT session_id, fid, attempt_no,
  CASE WHEN contains(error_message, 'timed out') THEN 'LLM_TIMEOUT' ELSE 'LLM_ERROR' END AS error_code
FROM fx_llm_attempts WHERE error_message IS NOT NULL""", ("fx_llm_attempts",))

_DMY = r"'^\d{2}/\d{2}/\d{4}\z'"


def dmy_sql(x: str) -> str:
    return f"(CASE WHEN COALESCE(regexp_matches({x}, {_DMY}), false) THEN CAST(try_strptime({x}, '%d/%m/%Y') AS DATE) END)"


def dmy_bad_sql(x: str) -> str:
    return (f"(COALESCE(regexp_matches({x}, {_DMY}), false) AND try_strptime({x}, '%d/%m/%Y') IS NULL)")


register("x8_parse_dmy", f"""
SELECT session_id, fid, attempt_no, e AS raw_expiry, {dmy_sql('e')} AS expiry_date,
  {dmy_bad_sql('e')} AS expiry_impossible, {dmy_sql('i')} AS issue_date
FROM (SELECT *, json_extract_string(span, '$.validity.dateOfExpiry') AS e,
        json_extract_string(span, '$.validity.dateOfIssue') AS i FROM att WHERE ok)""", (), ("att",))


def _section_sql(path: str, *keys: str) -> str:
    """A section's compact JSON text, keys in alphabetical order."""
    inner = " || ',' || ".join(f"'\"{k}\":' || COALESCE(CAST(json_extract(sp, '$.{path}.{k}') AS VARCHAR), 'null')" for k in sorted(keys))
    return f"CASE WHEN ok2 THEN '{{' || {inner} || '}}' END"


frag("prom", f"""
SELECT session_id, fid,
  CASE WHEN bad THEN 'FAILED' ELSE status END AS status,
  CASE WHEN bad THEN 'LLM_ERROR' ELSE error_code END AS error_code,
  CASE WHEN bad THEN 'Extraction could not be stored' ELSE error_message END AS error_message,
  retry_count, raw_text,
  CASE WHEN ok2 THEN json_extract_string(sp, '$.detection.documentType') END AS document_type,
  CASE WHEN ok2 THEN json_extract_string(sp, '$.detection.confidence') END AS confidence,
  CASE WHEN ok2 THEN json_extract_string(sp, '$.holder.fullName') END AS holder_name,
  CASE WHEN ok2 THEN {dmy_sql("json_extract_string(sp, '$.validity.dateOfExpiry')")} END AS date_of_expiry,
  CASE WHEN ok2 THEN TRY_CAST(json_extract_string(sp, '$.validity.isExpired') AS BOOLEAN) END AS is_expired,
  CASE WHEN ok2 THEN json_extract_string(sp, '$.detection.detectionReason') END AS detection_reason,
  CASE WHEN ok2 THEN json_extract_string(sp, '$.medicalData.restrictions') END AS medical_restrictions,
  {_section_sql('validity', 'dateOfIssue', 'dateOfExpiry', 'isExpired', 'daysUntilExpiry', 'revalidationRequired')} AS validity_json,
  {_section_sql('compliance', 'issuingAuthority', 'regulationReference', 'imoModelCourse', 'recognizedAuthority', 'limitations')} AS compliance_json,
  {_section_sql('medicalData', 'fitnessResult', 'drugTestResult', 'restrictions', 'specialNotes', 'expiryDate')} AS medical_data_json,
  CASE WHEN ok2 THEN json_array_length(sp, '$.flags') END AS n_flags,
  CASE WHEN ok2 THEN json_array_length(sp, '$.fields') END AS n_fields
FROM (
  SELECT *, status = 'COMPLETE' AND NOT bad AS ok2 FROM (
    SELECT *, status = 'COMPLETE' AND (
      COALESCE(json_type(sp, '$.detection'), '') <> 'OBJECT' OR COALESCE(json_type(sp, '$.holder'), '') <> 'OBJECT'
      OR COALESCE(json_type(sp, '$.validity'), '') <> 'OBJECT' OR COALESCE(json_type(sp, '$.compliance'), '') <> 'OBJECT'
      OR COALESCE(json_type(sp, '$.medicalData'), '') <> 'OBJECT'
      OR TRY_CAST(json_extract_string(sp, '$.validity.isExpired') AS BOOLEAN) IS NULL
      OR {dmy_bad_sql("json_extract_string(sp, '$.validity.dateOfIssue')")}
      OR {dmy_bad_sql("json_extract_string(sp, '$.validity.dateOfExpiry')")}) AS bad
    FROM (SELECT *, CASE WHEN status = 'COMPLETE' THEN {span_sql('raw_text')} END AS sp FROM res)))""", (), ("res",))
register("x9_promote", """
SELECT session_id, fid, status, error_code, document_type, holder_name, date_of_expiry, is_expired, n_flags, n_fields,
  detection_reason, medical_restrictions, validity_json, compliance_json, medical_data_json
FROM prom""", (), ("prom",))
register("x10_explode_fields", """
SELECT id, session_id, pos, key, label, value, importance, field_status FROM fx_ext_fields""", ("fx_ext_fields",))
register("x10_explode_flags", "SELECT id, session_id, pos, severity, message FROM fx_ext_flags", ("fx_ext_flags",))
register("x11_search_fields", """
SELECT DISTINCT id, session_id FROM fx_ext_fields WHERE contains(lower(value), 'peme')""", ("fx_ext_fields",))
_X12 = """
SELECT session_id, file_hash,
  COALESCE(CAST(arg_min_null(id, version) AS VARCHAR), sha256(CAST(session_id AS VARCHAR) || ':' || file_hash)) AS id,
  arg_max_null(status, version) AS status, arg_max_null(error_code, version) AS error_code,
  arg_max_null(retry_count, version) AS retry_count,
  arg_max_null(document_type, version) FILTER (WHERE status = 'COMPLETE') AS document_type,
  arg_max_null(confidence, version) FILTER (WHERE status = 'COMPLETE') AS confidence,
  arg_max_null(holder_name, version) FILTER (WHERE status = 'COMPLETE') AS holder_name,
  arg_max_null(date_of_expiry, version) FILTER (WHERE status = 'COMPLETE') AS date_of_expiry,
  arg_max_null(is_expired, version) FILTER (WHERE status = 'COMPLETE') AS is_expired
FROM (
  SELECT session_id, file_hash, 1 AS version, id, status, error_code, retry_count, document_type, confidence,
    holder_name, date_of_expiry, is_expired FROM fx_ext
  UNION ALL
  SELECT p.session_id, f.file_hash, 2, NULL, p.status, p.error_code, p.retry_count, p.document_type, p.confidence,
    p.holder_name, p.date_of_expiry, p.is_expired
  FROM prom p JOIN (SELECT DISTINCT session_id, fid, file_hash FROM fx_llm_attempts) f
    ON f.session_id = p.session_id AND f.fid = p.fid)
GROUP BY session_id, file_hash"""
register("x12_upsert_extractions", _X12, ("fx_ext", "fx_llm_attempts"), ("prom",))
register("x13_usage_rollup", """
SELECT provider, 'model-' || provider AS model, '1.0.0' AS prompt_version, COUNT(*) AS calls,
  COUNT(*) FILTER (WHERE error_message IS NULL) AS successes,
  SUM(pt) AS prompt_tokens, SUM(ct) AS completion_tokens, SUM(tt) AS total_tokens,
  AVG(latency_ms) AS avg_latency_ms, quantile_cont(latency_ms, 0.5) AS p50_latency_ms
FROM (SELECT *,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.promptTokenCount') AS BIGINT)
    WHEN 'anthropic' THEN CAST(json_extract(envelope, '$.usage.input_tokens') AS BIGINT)
    ELSE CAST(json_extract(envelope, '$.usage.prompt_tokens') AS BIGINT) END AS pt,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.candidatesTokenCount') AS BIGINT)
    WHEN 'anthropic' THEN CAST(json_extract(envelope, '$.usage.output_tokens') AS BIGINT)
    ELSE CAST(json_extract(envelope, '$.usage.completion_tokens') AS BIGINT) END AS ct,
  CASE provider WHEN 'gemini' THEN CAST(json_extract(envelope, '$.usageMetadata.totalTokenCount') AS BIGINT)
    WHEN 'anthropic' THEN CASE WHEN json_extract(envelope, '$.usage') IS NOT NULL THEN
      COALESCE(CAST(json_extract(envelope, '$.usage.input_tokens') AS BIGINT), 0)
      + COALESCE(CAST(json_extract(envelope, '$.usage.output_tokens') AS BIGINT), 0) END
    ELSE CAST(json_extract(envelope, '$.usage.total_tokens') AS BIGINT) END AS tt
  FROM fx_envelopes)
GROUP BY provider""", ("fx_envelopes",))
register("x14_run_extractor", """
SELECT upload_id,
  CASE WHEN octet_length(encode(text)) % 13 = 0 THEN NULL
       ELSE '{"detection":{"documentType":"OTHER","confidence":"' ||
            CASE WHEN octet_length(encode(text)) % 2 = 1 THEN 'LOW' ELSE 'HIGH' END ||
            '"},"size":' || CAST(octet_length(encode(text)) AS VARCHAR) || '}' END AS raw_text,
  CASE WHEN octet_length(encode(text)) % 13 = 0 THEN 'LLM request timed out after 90000ms' END AS error_message
FROM fx_files WHERE text IS NOT NULL""", ("fx_files",))


# --------------------------------------------------------------- streaming

ORACLE["t2_rate_limit_stream"] = ORACLE["t1_rate_limit"]
register("t3_dedup_stream", """
SELECT session_id, file_hash, min(seq) AS seq, arg_min(file_name, seq) AS file_name
FROM fx_upload_rows GROUP BY session_id, file_hash""", ("fx_upload_rows",))
ORACLE["t4_job_state_stream"] = ORACLE["j5_job_state"]
# t5: files with fid % 5 = 4 are not stored yet, so their first rows have no id
register("t5_upsert_stream", _X12.replace("1 AS version, id,", "1 AS version, CASE WHEN fid % 5 <> 4 THEN id END AS id,"),
         ("fx_ext", "fx_llm_attempts"), ("prom",))
