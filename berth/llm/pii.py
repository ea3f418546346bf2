"""Personal data with bootstrapped contextual extraction (operator 10).

DataFrame functions only. Four base kinds are found by their patterns. They
seed a graph: its instances are the whole base spans and every other candidate
run (``CANDIDATE``: numbers with their separators, and words that hold a digit
or inner punctuation). The word before an instance and the word after it, each
with the instance's shape, are its lexical patterns; a shape is taken twice,
once by runs of characters without their lengths and once by their classes
only. Scores run over the graph ``ROUNDS`` times: a pattern's confidence is the
mean score of its distinct instances (shrunk by ``PRIOR``), an instance's score
is one for a seed, else one minus the product of its patterns' doubts. Patterns
with at least ``SUPPORT`` instances that are seeds or were accepted in an
earlier round, and a confidence of at least ``CONFIDENCE``, discover further
identifiers, which are added as spans of the kind ``context``. Base spans are
never changed. A plain word, or a number of fewer than ``DIGITS`` digits (the
fewest of a base kind), is no candidate.

Offsets are code points, end exclusive: a text split by a pattern gives the
gaps between the pattern's matches, and running sums of both give places.

Defined results: a null or empty text has no spans; equal rows are each
returned; a null doc_id passes; texts are read whole; extra columns are not
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import cut, match_ends, prepare

ROUNDS, SUPPORT, CONFIDENCE, PRIOR = 3, 5, 0.8, 1.0
DIGITS, NEAR = 4, 48  # NEAR: characters on each side in which a context word is looked for
KINDS = ("email", "ip", "card", "phone")

# Possessive where the next thing can't begin inside the run, so no pattern
# backtracks or recurses on long input. A local part only starts at the start
# of its run or where the last match ended: no later start can match. A card's
# run of fewer than 16 digits fails as a whole, so it is not matched at all.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Runs that may be identifiers: a match of a base pattern, a number with its
# separators (that ends before an address or a card), or a word with a digit or
# inner punctuation. Both start and end with a letter or digit, so the
# punctuation around them stays outside.
_WORD, _INNER = r"[\p{L}\p{N}]", r"[^\s\p{L}\p{N}:=,;\"'<>|]"
_STEP = r"(?:[ ./-]|\)[ -]?| ?\()"
CANDIDATE = "|".join((
    *(PATTERNS[k] for k in ("email", "ip", "card", "phone")),
    rf"(?<!{_WORD})\(?[0-9]++(?!\p{{L}})(?:{_STEP}(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])(?![0-9](?:[ -]?[0-9]){{15}})[0-9]++(?!\p{{L}}))*+",
    rf"(?<!{_WORD})(?=\p{{L}}*+(?:\p{{N}}|{_INNER}++{_WORD})){_WORD}++(?:{_INNER}++{_WORD}++)*+"))


def _place(text: Column, pattern: str, some: Column) -> Column:
    """The matches and the gaps around them, where ``some`` (a cheap test)
    holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(some, F.struct(found.alias("found"), gaps.alias("gaps")))


def _spans(raw: Column, ends: Column) -> Column:
    """[(start, end, value, word before, word after)] of the matches."""
    found, gaps = raw["found"], raw["gaps"]
    tail = lambda c: F.substring(F.coalesce(c, F.lit("")), -NEAR, NEAR)
    head = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, NEAR)
    one = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(
        (F.get(ends, i - 1) - F.length(F.get(found, i - 1))).alias("start"), F.get(ends, i - 1).alias("end"),
        F.get(found, i - 1).alias("value"),
        # a gap may be shorter than the way to the next word: the match beyond it has that word
        F.lower(F.regexp_extract(F.concat(tail(F.get(found, i - 2)), tail(F.get(gaps, i - 1))),
                                 rf"({_WORD}++)[^\p{{L}}\p{{N}}]*+$", 1)).alias("left"),
        F.lower(F.regexp_extract(F.concat(head(F.get(gaps, i)), head(F.get(found, i))),
                                 rf"^[^\p{{L}}\p{{N}}]*+({_WORD}++)", 1)).alias("right")))
    return F.when(raw.isNotNull() & (F.size(found) > 0), one).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(f"_all_{kind}", lambda s: _valid(kind, s["value"]))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array of spans per base kind and ``tokens``, the
    places of candidate runs; all with the words next to them."""
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]")
    some = {"email": F.instr(t, "@") > 0, "phone": F.instr(t, "+") > 0}
    out = docs.select("*", *[_place(t, p, some.get(k, digit)).alias(f"_{k}") for k, p in PATTERNS.items()],
                      _place(t, CANDIDATE, t != "").alias("_token"))
    for k in (*KINDS, "token"):
        out = match_ends(out, f"_{k}.found", f"_{k}.gaps", f"_ends_{k}")
    out = out.select(*docs.columns, *[_spans(F.col(f"_{k}"), F.col(f"_ends_{k}")).alias(f"_all_{k}") for k in KINDS],
                     _spans(F.col("_token"), F.col("_ends_token")).alias("_tokens"))
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    return out.select(
        *docs.columns, *[_checked(k).alias(k) for k in KINDS],
        F.filter("_tokens", lambda s: s["value"].rlike(r"\p{L}") | (digits(s) >= DIGITS)).alias("tokens"))


def _shapes(value: Column) -> list[Column]:
    """Runs of letters and of digits without their lengths; and classes only:
    a number, or a word with inner punctuation or without."""
    runs = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\p{N}+", "9")
    return [runs, F.when(~runs.contains("a"), F.lit("#")).when(runs.rlike("[^a9]"), F.lit("#a.")).otherwise(F.lit("#a"))]


def discover(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Instances (value, seed, left, right) to the values discovered by
    confident patterns: (value, score)."""
    shapes = _shapes(F.col("value"))
    edges = cut(instances.select("value", "seed", F.explode(F.array(*[
        F.concat(F.lit(side), F.col(word), F.lit(" "), shape) for side, word in (("<", "left"), (">", "right")) for shape in shapes])).alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    scores = cut(edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seed")))
    for _ in range(rounds):
        conf = (edges.select("pattern", "value").join(scores.select("value", "score"), "value")
                .groupBy("pattern").agg(F.sum("score").alias("s"), F.count("*").alias("n"),
                                        F.sum((F.col("score") >= CONFIDENCE).cast("long")).alias("accepted"))
                .where(F.col("accepted") >= SUPPORT)
                .select("pattern", (F.col("s") / (F.col("n") + PRIOR)).alias("conf"))
                .where(F.col("conf") >= CONFIDENCE))
        doubt = (edges.join(conf, "pattern").groupBy("value")
                 .agg(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))).alias("d")))
        scores = cut(scores.join(doubt, "value", "left").select(
            "value", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce(1 - F.exp("d"), F.lit(0.0))).alias("score"), "seed"))
    return scores.where(~F.col("seed") & (F.col("score") >= CONFIDENCE)).select("value", "score")


def _joined(spans: list[tuple[str, Column]]) -> Column:
    def named(kind: str, a: Column) -> Column:
        pairs = F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(pairs, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", *[named(k, a) for k, a in spans])


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context;
    one row per row of ``docs``."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "key", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1), "doc_id").alias("b")))
    base = cut(base_spans(src).drop("text"))
    seeds = F.concat(*[F.col(k) for k in KINDS])
    # base spans are seeds; a candidate inside one, or around one, is not taken again
    apart = lambda t: ~F.exists(seeds, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    both = F.concat(F.transform(seeds, lambda s: s.withField("seed", F.lit(True))),
                    F.transform(F.filter("tokens", apart), lambda t: t.withField("seed", F.lit(False))))
    places = cut(base.select("key", F.explode(both).alias("t")).select("key", "t.*").dropDuplicates(["key", "start", "end", "seed"]))
    new = discover(places.select("value", "seed", "left", "right"))
    own = (places.where(~F.col("seed")).join(new, "value").groupBy("key")
           .agg(F.collect_list(F.struct("start", "end")).alias("context")))
    out = base.join(own, "key", "left").withColumn("context", F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")))
    parts = [(k, F.col(k)) for k in KINDS]
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(parts), 256).alias("base_sha256"),
        _joined([*parts, ("context", F.col("context"))]).alias("spans"),
        F.size("context").cast("long").alias("n_context"))
