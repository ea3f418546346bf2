"""Secret scan with a random forest against false positives (operator 4).

DataFrame functions and Spark ML only. Candidates are runs of at least 16 key
characters, and after a name that secrets are assigned to the whole quoted or
white-space delimited value of at least ``KEYED_MIN`` characters. A candidate's features are its length, its character transitions
(share of class changes, share of digits and of upper case, distinct
characters, and how unlikely its letter pairs are in the corpus), the share of
its characters that dictionary words of the corpus cover, whether it is part
of a path, and the neighbouring words (the rate of findings next to that word
among the labelled ones, an assignment sign, a quote). A random forest fitted
on labelled findings decides which candidates are secrets.

Dictionary and letter pairs are counted over the whole corpus. The labelled
findings are at most about ``FIT_ROWS`` rows for each label, drawn by a hash.
Where none are given, ``weak_labels`` labels candidates of provider formats
and of quoted or keyed assignments as secrets and the rest as none.

Defined results: a null or empty text has no candidate; equal rows each keep
their findings; with fewer than ``MIN_LABELS`` labelled findings of either kind
the labels' own rule decides;
extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import cut, match_ends, prepare

FIT_ROWS = 10_000
KEYED_MIN = 6
WORD_MIN = 5  # occurrences of a dictionary word
MIN_LABELS = 20  # of each label, or the labels' rule decides
MASK = "[SECRET]"

# Public key formats, and names that secrets are assigned to.
FORMATS = (r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|"
           r"sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20})$")
NAMES = r"(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|auth|access[_-]?key|private[_-]?key|credentials?|bearer)"
KEYS = rf"(?i)(?:^|[^a-z]){NAMES}[\"']?\s*[=:]{{1,2}}>?\s*[\"']?$"

# A look behind is bounded, so up to 8 white-space characters stand on a side
# of the sign; the cheap ones come first. A quoted value runs to its quote, any
# other to white space, without the punctuation that ends it.
_AFTER = r"(?<=[=:>\s\"'])(?<=[=:]>?\s{0,8}%s)(?<=(?i:(?:^|[^a-z])" + NAMES + r")[\"']?\s{0,8}[=:]{1,2}>?\s{0,8}%s)"
KEYED = "|".join((
    *(_AFTER % (q, q) + rf"(?! )[^{q}\r\n]{{{KEYED_MIN},}}+(?={q})" for q in ('"', "'")),
    _AFTER % ("[\"']?", "[\"']?") + rf"(?![\"'=:>\s])\S{{{KEYED_MIN},}}(?<=[^.,;:)\]}}\"'])(?!\S*[^\s.,;:)\]}}\"'])"))
CANDIDATE = KEYED + r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"

FEATURES = ("f_length", "f_changes", "f_digits", "f_upper", "f_distinct", "f_pairs", "f_dictionary",
            "f_path", "f_neighbour", "f_assign", "f_quote")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: key, doc_id, start, end (code points), value,
    and up to 40 characters on both sides."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col("doc_id"), F.struct(
        F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, F.lit(1), "doc_id").alias("b")).alias("key"),
        F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(t, CANDIDATE, -1).alias("gaps"))
    src = match_ends(src.where(F.size("found") > 0), "found", "gaps", "ends")
    one = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.struct(
        (F.get("ends", i) - F.length(F.get("found", i))).cast("long").alias("start"), F.get("ends", i).cast("long").alias("end"),
        F.get("found", i).alias("value"),
        # a long name before the sign may be a match of its own
        F.substring(F.concat(F.substring(F.coalesce(F.get("found", i - 1), F.lit("")), -40, 40),
                             F.substring(F.get("gaps", i), -40, 40)), -40, 40).alias("left"),
        F.substring(F.get("gaps", i + 1), 1, 40).alias("right")))
    return src.select("doc_id", "key", F.explode(one).alias("c")).select("doc_id", "key", "c.*")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): lower-case words of 3 to 8 letters a-z over the corpus."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("(?<![a-z])[a-z]{3,8}+(?![a-z])"), F.lit(0))
    return (docs.select(F.explode(ws).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= WORD_MIN))


def letter_pairs(words: DataFrame) -> Column:
    """Map literal of letter pair -> log share; at most 26 x 26 entries."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    rows = words.select(pair.alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows) or 1
    return F.create_map(*[F.lit(x) for r in sorted(rows) for x in (r["p"], float(r["n"]) / total)]) if rows else F.create_map(
        F.lit(""), F.lit(0.0))


def weak_labels() -> Column:
    """1 for provider formats and keyed values with digits, else 0."""
    keyed = F.col("left").rlike(KEYS) & F.col("value").rlike("[0-9]")
    return (F.col("value").rlike(FORMATS) | keyed).cast("int")


def _neighbour() -> Column:
    return F.lower(F.regexp_extract("left", r"([A-Za-z_]{2,30})[^A-Za-z]{0,8}$", 1))


def features(cands: DataFrame, words: DataFrame, rates: DataFrame) -> DataFrame:
    """Candidates with their features. Each distinct value is worked on once."""
    v, low, n = F.col("value"), F.lower("value"), F.length("value").cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9"), "[^Aa9]", "-")
    changes = n - F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    pairs = letter_pairs(words)
    at = F.sequence(F.lit(1), F.length(low) - 1)
    rare = F.aggregate(at, F.lit(0.0), lambda acc, i: acc - F.log(
        F.coalesce(F.element_at(F.col("pairs"), F.substring(low, i, F.lit(2))), F.lit(0.0)) + 1e-5))
    values = cut(cands.select("value").distinct().select(
        "value", n.alias("f_length"), (1 - changes / n).alias("f_changes"),
        ((n - F.length(F.regexp_replace(v, "[0-9]", ""))) / n).alias("f_digits"),
        ((n - F.length(F.regexp_replace(v, "[A-Z]", ""))) / n).alias("f_upper"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("f_distinct"),
        low.alias("low"), pairs.alias("pairs")).withColumn("f_pairs", rare / (n - 1)).drop("pairs", "low"))
    # dictionary coverage: letter runs of a value, cut into runs a word may fill
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    pieces = runs.distinct().select("value", "run", F.explode(F.sequence(F.lit(1), F.length("run") - 2)).alias("i")).select(
        "value", "run", "i", F.explode(F.sequence(F.lit(3), F.least(F.lit(8), F.length("run") - F.col("i") + 1))).alias("k"))
    hit = (pieces.withColumn("word", F.substring(F.col("run"), F.col("i"), F.col("k"))).join(words.select("word"), "word")
           .select("value", "run", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("k") - 1)).alias("at")).distinct()
           .groupBy("value").agg(F.count("*").alias("covered")))
    values = values.join(hit, "value", "left").withColumn("f_dictionary", F.coalesce("covered", F.lit(0)) / F.col("f_length")).drop("covered")
    path = v.rlike("/[^/]+/") | F.col("left").rlike(r"[/\\]$|https?:\S*$") | F.col("right").rlike(r"^\.[A-Za-z]{2,4}\b|^[/\\]")
    return (cands.join(values, "value").withColumn("word", _neighbour()).join(rates, "word", "left")
            .withColumn("f_path", path.cast("double")).withColumn("f_neighbour", F.coalesce("rate", F.lit(0.0)))
            .withColumn("f_assign", F.col("left").rlike(r"[=:]\s*[\"']?$").cast("double"))
            .withColumn("f_quote", F.col("left").rlike("[\"']$").cast("double")).drop("word", "rate"))


def neighbour_rates(labelled: DataFrame) -> DataFrame:
    """(word, rate): smoothed rate of secrets next to a word."""
    return (labelled.select(_neighbour().alias("word"), "label").where("word <> ''").groupBy("word")
            .agg((F.sum("label") / (F.count("*") + 4)).alias("rate")).where("rate > 0"))


def draw_labelled(cands: DataFrame, label: Column, rows: int = FIT_ROWS) -> DataFrame:
    """Distinct labelled findings, about ``rows`` for each label at most."""
    one = cands.withColumn("label", label).groupBy("value", "label").agg(
        F.min(F.struct("left", "right")).alias("m")).select("value", "label", "m.left", "m.right")
    n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, rows / v))) for k, v in n.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / float(1 << 30)
    return one.where(draw < share)


def train(labelled: DataFrame, words: DataFrame) -> tuple[RandomForestClassificationModel | None, DataFrame]:
    """Forest and neighbour rates from labelled findings (value, left, right,
    label). No forest with too few of either label."""
    rates = cut(neighbour_rates(labelled))
    rows = features(labelled, words, rates)
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select(
        "features", F.col("label").cast("double").alias("label"), "value")
    vec = cut(vec.repartition(1).sortWithinPartitions("value", "label"))  # the bounded sample; in one order, so one forest
    n = {r["label"]: r["count"] for r in vec.groupBy("label").count().collect()}
    if min(n.get(0.0, 0), n.get(1.0, 0)) < MIN_LABELS:
        return None, rates
    forest = RandomForestClassifier(numTrees=24, maxDepth=6, seed=11, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    return forest.fit(vec.select("features", "label")), rates


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings: doc_id, key, start, end, value, score (probability), and
    rule (what the weak label alone says)."""
    prepare(docs.sparkSession)
    cands = cut(candidates(docs))
    words = cut(dictionary(docs))
    if labelled is None:
        fit = cands.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False)))
        labelled = cut(draw_labelled(fit, weak_labels()))
    forest, rates = train(labelled, words)
    rows = features(cands, words, rates).withColumn("rule", weak_labels())
    if forest is None:
        scored = rows.withColumn("score", F.col("rule").cast("double"))
    else:
        scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).withColumn(
            "score", F.round(vector_to_array("probability")[1], 9))
    return scored.where(F.col("score") >= threshold).select(
        "doc_id", "key", "start", "end", "value", F.round("score", 6).alias("score"), "rule")


def redact(docs: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the found values replaced by ``MASK``; a value of fewer
    than 16 characters only where it stands alone."""
    per = findings.groupBy("key").agg(F.sort_array(F.collect_set("value"), asc=False).alias("_values"))
    key = F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, F.lit(1), "doc_id").alias("b"))
    out = docs.withColumn("_key", key).join(per.withColumnRenamed("key", "_key"), "_key", "left")
    clean = F.when(F.col("_values").isNull(), F.col(text)).otherwise(
        F.aggregate("_values", F.col(text), lambda t, v: F.when(F.length(v) >= 16, F.replace(t, v, F.lit(MASK))).otherwise(
            F.regexp_replace(t, F.concat(F.lit("(?<![A-Za-z0-9])"), F.regexp_replace(v, r"([^A-Za-z0-9\s])", r"\\$1"),
                                         F.lit("(?![A-Za-z0-9])")), F.lit(MASK)))))
    return out.withColumn(text, clean).select(*docs.columns)
