"""Column expressions shared by the operators. All JVM-side (codegen'd)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference semantics): urgency bands in days.
URGENCY_CRITICAL_DAYS = 30
URGENCY_WARNING_DAYS = 90


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_until(expiry: str | Column, as_of: str) -> Column:
    """Whole days from ``as_of`` to the expiry date (ceil of the day difference)."""
    return F.datediff(col(expiry), F.lit(as_of).cast("date"))


def urgency(days: str | Column) -> Column:
    """<0 EXPIRED, <=30 CRITICAL, <=90 WARNING, else OK."""
    d = col(days)
    return (F.when(d < 0, "EXPIRED")
             .when(d <= URGENCY_CRITICAL_DAYS, "CRITICAL")
             .when(d <= URGENCY_WARNING_DAYS, "WARNING")
             .otherwise("OK"))


def first_by(order: list[str | Column], value: Column, cond: Column | None = None) -> Column:
    """Aggregate: the value of the row with the smallest ``order`` among rows
    with ``cond``; null if none. ``min`` over a struct ignores nulls, so this is
    a partial (map-side) aggregate with O(1) state per group."""
    s = F.struct(*[col(o) for o in order], value.alias("v"))
    if cond is not None:
        s = F.when(cond, s)
    return F.min(s)["v"]


def last_by(order: list[str | Column], value: Column, cond: Column | None = None) -> Column:
    s = F.struct(*[col(o) for o in order], value.alias("v"))
    if cond is not None:
        s = F.when(cond, s)
    return F.max(s)["v"]


# --------------------------------------------------------------------------
# LLM answer text
# --------------------------------------------------------------------------

def with_json_span(df, text: str, out: str = "span"):
    """Add the JSON span of ``text`` as column ``out``: from the first ``{`` to
    the last ``}`` of the first fenced block's inside if a fence is closed,
    else of the text; null if absent or reversed.

    Same result as the lazy pattern of the reference (its optional ``json``
    tag and leading white space hold no brace, so they need no cutting off),
    in linear time. Every step is a column of its own: an expression used
    twice is not merged into the next projection, so it runs once a row."""
    o, rest, close, body, first, last = (f"_{out}_{k}" for k in ("open", "rest", "close", "body", "first", "last"))
    steps = {
        o: F.instr(F.col(text), "```"),
        rest: F.when(F.col(o) > 0, F.substr(F.col(text), F.col(o) + 3)),
        close: F.coalesce(F.instr(F.col(rest), "```"), F.lit(0)),
        body: F.when(F.col(close) > 0, F.substr(F.col(rest), F.lit(1), F.col(close) - 1)).otherwise(F.col(text)),
        first: F.instr(F.col(body), "{"),
        last: F.length(body) - F.length(F.substring_index(F.col(body), "}", -1)),  # 0 without a brace
    }
    for name, step in steps.items():
        df = df.withColumn(name, step)
    span = F.when((F.col(first) > 0) & (F.col(last) > F.col(first)), F.substr(F.col(body), F.col(first), F.col(last) - F.col(first) + 1))
    return df.withColumn(out, span).drop(*steps)


def bind(df, **exprs: Column):
    """Add columns that are computed once per row, whatever stands above. A
    filter on a projected column is pushed below the projection with the
    column's whole expression; a filter on a generated column is not."""
    made = F.explode(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))).alias("_bound")
    return df.select("*", made).select(*df.columns, *[F.col(f"_bound.{n}").alias(n) for n in exprs])


def parse_answer(span: str | Column) -> Column:
    """The span as VARIANT, parsed once and strictly, as a JSON.parse would
    accept it: wrapped in ``[...]``, so that a second object after the first
    is a second element. Null if it is not JSON."""
    return F.try_parse_json(F.concat(F.lit("["), col(span), F.lit("]")))


def answer_ok(answer: str | Column) -> Column:
    """Whether a parsed answer is one value and nothing behind it."""
    return F.coalesce(F.size(F.try_variant_get(col(answer), "$", "array<variant>")) == 1, F.lit(False))


def answer_get(answer: str | Column, path: str, type_: str = "string") -> Column:
    """A typed member of a parsed answer; null where it is absent, null or of
    another kind."""
    return F.try_variant_get(col(answer), f"$[0].{path}", type_)


def answer_has(answer: str | Column, path: str) -> Column:
    """Whether a member is there and not null (a JSON null reads as null)."""
    return answer_get(answer, path, "variant").isNotNull()


def json_object_ok(span: str | Column) -> Column:
    """Strict JSON validity of one object."""
    return answer_ok(parse_answer(span))


# ``^\d{2}/\d{2}/\d{4}$`` of the reference; JS ``$`` has no final-newline
# exception, so Java's ``\z`` is the equal.
DMY_RE = r"^\d{2}/\d{2}/\d{4}\z"


def dmy_matches(value: str | Column) -> Column:
    return F.coalesce(col(value).rlike(DMY_RE), F.lit(False))


def parse_dmy(value: str | Column) -> Column:
    """``DD/MM/YYYY`` to a date; anything else (or an impossible date) to null."""
    v = col(value)
    return F.when(dmy_matches(v), F.try_to_date(v, "dd/MM/yyyy"))


def dmy_impossible(value: str | Column) -> Column:
    """Well-formed but impossible (e.g. 31/02): the row must fail."""
    v = col(value)
    return dmy_matches(v) & parse_dmy(v).isNull()


# --------------------------------------------------------------------------
# Hashing (S2, J7)
# --------------------------------------------------------------------------

def hmac_sha256_hex(body: str | Column, secret: str) -> Column:
    """HMAC-SHA256 of the UTF-8 body, hex. Pads are derived once on the driver
    from the (parameter) secret; the per-row work is two JVM sha2 calls."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(col(body), "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def hmac_pads_hex(secret: str) -> tuple[str, str]:
    """The two pads as hex, for the SQL oracle."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    return (bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex())


def js_string(c: str | Column) -> Column:
    """How a JS template literal prints a value: null becomes ``null``."""
    return F.coalesce(col(c).cast("string"), F.lit("null"))
