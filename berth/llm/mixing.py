"""Mixing sources to target weights by temperature (operator 9).

A source's token share p becomes a weight proportional to p ** a. The exponent
is found by repeated section of [0, 1]: the largest one that still reaches the
target entropy, or, if that one would repeat a source more often than
``max_repeat`` times, the smallest one that keeps the limit. The entropy falls
and the largest repetition shrinks as the exponent grows. Each round is one
aggregate over the source table, so no list of sources reaches the driver.

The weights are realised as block permutations: a source with a budget of b
tokens runs through whole permutations of its documents (epochs) and through
the head of one more, up to the budget. A copy's place in its source's stream,
as a fraction of the budget, is its block; the blocks thus hold all sources by
weight and are shuffled inside by a hash. Running token sums use three levels
of hash ranges, so a source holding a third of all rows is not one task.

Defined results: null is a source of its own; a document without words takes
no budget and stands in every epoch; sources without a token are not mixed;
rows with a null id or repeated ids are separate documents; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import cut, prepare

POINTS, ROUNDS = 64, 5
FINE, COARSE = 1 << 10, 1 << 20


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, tokens): words of the whole text."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit("\\S+")), F.lit(0)).cast("long").alias("tokens"))


def find_exponent(sources: DataFrame, budget: float, flatten: float, max_repeat: float) -> float:
    """Exponent of the weights over ``sources(skey, tokens)``. The target
    entropy lies ``flatten`` of the way from the shares' own to uniform."""
    base = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not base["n"]:
        return 1.0

    def measure(points: list[float]) -> list:
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(points)]))
        p = F.col("tokens") / F.lit(float(base["t"]))
        w = sources.select("tokens", p.alias("p"), grid.alias("g")).select(
            "tokens", F.col("g.i").alias("i"), F.pow("p", F.col("g.a")).alias("w"))
        # with z the sum of w: the entropy is ln z - sum(w ln w) / z
        return w.groupBy("i").agg(
            F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s"),
            F.max(F.col("w") / F.col("tokens")).alias("r")).orderBy("i").collect()

    own = measure([1.0])[0]
    lowest = math.log(own["z"]) - own["s"] / own["z"]
    target = lowest + flatten * (math.log(base["n"]) - lowest)

    def section(holds, largest: bool) -> float:
        """Edge of the exponents that hold, which lie below (largest) or above."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * k / (POINTS - 1) for k in range(POINTS)]
            ok = [holds(r) for r in measure(points)]
            if largest:
                k = max((i for i, x in enumerate(ok) if x), default=0)
                lo, hi = points[k], points[min(k + 1, POINTS - 1)]
            else:
                k = min((i for i, x in enumerate(ok) if x), default=POINTS - 1)
                lo, hi = points[max(k - 1, 0)], points[k]
        return lo if largest else hi

    a = section(lambda r: math.log(r["z"]) - r["s"] / r["z"] >= target - 1e-12, True)
    fits = lambda r: r["r"] / r["z"] * budget <= max_repeat + 1e-9
    return a if fits(measure([a])[0]) else section(fits, False)


def _running(df: DataFrame, part: list[str], place: Column, n: Column, order: list, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over earlier rows of the
    part, by ``place`` in [0, 1). Sums over coarse ranges, fine ranges within
    one, and rows within one, each a window over a bounded group."""
    df = df.withColumn("_c", F.floor(place * F.ceil(n / COARSE))).withColumn("_f", F.floor(place * F.ceil(n / FINE)))
    fine = cut(df.groupBy(*part, "_c", "_f").agg(F.sum(value).alias("_v")))
    coarse = fine.groupBy(*part, "_c").agg(F.sum("_v").alias("_v"))
    before = lambda p, o: F.coalesce(F.sum("_v").over(
        Window.partitionBy(*p).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(*part, "_c", before(part, "_c").alias("_b0"))
    fine = (fine.select(*part, "_c", "_f", before([*part, "_c"], "_f").alias("_b1")).join(coarse, [*part, "_c"])
            .select(*part, "_c", "_f", (F.col("_b0") + F.col("_b1")).alias("_b")))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*part, "_f").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return (df.withColumn("_own", own).join(fine, [*part, "_c", "_f"])
            .withColumn("before", F.col("_b") + F.col("_own")).drop("_c", "_f", "_b", "_own"))


def mix_sources(docs: DataFrame, budget: int | None = None, flatten: float = 0.5, max_repeat: float = 4.0,
                blocks: int = 64, seed: int = 1) -> DataFrame:
    """One row per copy in the mixture: doc_id, source, epoch, n_tokens, block
    and order_key (order inside a block). ``budget`` in tokens; all tokens of
    the input if it is not given."""
    prepare(docs.sparkSession)
    table = cut(token_table(docs))
    src = table.groupBy("skey").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).where("tokens > 0")
    src = cut(src)
    total = src.agg(F.sum("tokens")).first()[0] or 0
    goal = float(total if budget is None else budget)
    a = find_exponent(src, goal, flatten, max_repeat)
    w = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = src.agg(F.sum(w)).first()[0] or 1.0
    plan = src.select("skey", "n", F.col("tokens").alias("t"), (w / F.lit(z) * F.lit(goal)).alias("b"))
    epoch = F.explode(F.sequence(F.lit(0), F.floor(F.col("b") / F.col("t")).cast("int")))
    runs = table.join(plan, "skey").withColumn("epoch", epoch)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "epoch", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    runs = runs.withColumn("place", place)
    runs = _running(runs, ["skey", "epoch"], F.col("place"), F.col("n"), [F.col("place"), F.col("doc_id"), F.col("tokens")], "tokens")
    end = F.col("epoch") * F.col("t") + F.col("before") + F.col("tokens")
    block = F.floor((F.col("epoch") * F.col("t") + F.col("before")) / F.col("b") * blocks)
    return runs.where(end <= F.col("b") + 1e-6).select(
        "doc_id", "source", "epoch", F.col("tokens").alias("n_tokens"),
        F.least(block, F.lit(blocks - 1)).cast("int").alias("block"),
        F.xxhash64(F.col("doc_id").cast("string"), "epoch", F.lit(seed + 1)).alias("order_key"))
