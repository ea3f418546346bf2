"""Near-duplicates by BagMinHash (operator 5).

A document is the multiset of its five-word shingles (a shorter, not empty
document is one shingle). Its signature is that of hierarchical Poisson
processes: an element's weight axis is cut into dyadic nodes [0,1), [1,2),
[2,4), ...; every node is a Poisson process with a rate equal to its width, a
point of a node that the weight covers in part is halved down the node by
hashed bits and kept if it falls below the weight. A point falls into one of
``BANDS * ROWS`` registers and a register keeps its earliest point, so two
signatures agree in a register with probability equal to the weighted Jaccard
similarity. Points later than a document's last filled register cannot change
the signature, so most elements cost one draw.

Signatures are cut into bands. Documents with equal multisets form one class,
and only class representatives meet in band buckets. A bucket never emits all
its pairs: its members are checked against its most central member first,
what is linked becomes one component, and only pairs between different
components that could still be similar are checked after that, the bucket's
largest component against the rest. Two bounds drop strongly edited copies
before a pair is made: the shingles that no other document holds, and hash
cells that only one document of the pair fills. Every check is exact: overlap of the shingle multisets.

Defined results: null, empty or wordless texts are never similar to anything;
rows that share a doc_id and text are copies, of which the first in no
particular order is kept; a null doc_id sorts last; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import components, cut, gram_hash, mix64, powers, prepare, slices, utf8, words

BANDS, ROWS = 32, 6
SHINGLE, THRESHOLD = 5, 0.8
# A bucket row of the last step meets at most so many rows in one salted part.
SPLIT = 512
# Hash cells whose occupation bounds an overlap; the top ten bits of a shingle.
CELLS = 1 << 10
# Ids are broadcast up to this number (8 MB), counted before.
BROADCAST_IDS = 1_000_000


def shingles(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, sorted by both."""
    _, _, _, row, h = words(raw, off)
    if not len(h):
        return row, h
    g = gram_hash(h, k)
    ok = row[:len(g)] == row[k - 1:] if len(g) else np.zeros(0, bool)
    rows, hs = row[:len(g)][ok], g[ok]
    count = np.bincount(row, minlength=len(off) - 1)
    for r in np.flatnonzero((count > 0) & (count < k)):  # short documents
        a = np.searchsorted(row, r)
        rows = np.append(rows, r)
        hs = np.append(hs, gram_hash(h[a:a + count[r]], int(count[r])))
    order = np.lexsort((hs, rows))
    return rows[order], hs[order]


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) identifiers of the earliest point of each register."""
    # dyadic nodes: node 0 is [0,1), node j is [2^(j-1), 2^j)
    top = np.floor(np.log2(weight)).astype(np.int64) + 1  # nodes 0..top-1 are covered whole
    part = weight > (1 << (top - 1))  # node `top` is covered in part
    n_nodes = top + part
    el = np.repeat(np.arange(len(row)), n_nodes)
    node = np.arange(len(el)) - np.repeat(np.cumsum(n_nodes) - n_nodes, n_nodes)
    rate = np.where(node == 0, 1.0, 2.0 ** (node - 1))
    frac = np.where(node < top[el], 1.0, (weight[el] - rate) / rate)
    owner = row[el]
    with np.errstate(over="ignore"):
        seed = mix64(h[el] + (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    when = np.full(n_rows * m, np.inf)
    who = np.zeros(n_rows * m, np.uint64)
    last = np.full(n_rows, np.inf)
    t = np.zeros(len(el))
    state = seed
    while len(el):
        with np.errstate(over="ignore"):
            state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            t = t - np.log(_unit(state)) / rate
            live = t <= last[owner]
            el, owner, rate, frac, t, state = (v[live] for v in (el, owner, rate, frac, t, state))
            draw = mix64(state ^ np.uint64(0xA0761D6478BD642F))
            inside = np.flatnonzero(_unit(mix64(draw ^ np.uint64(0xE7037ED1A0B428DB))) < frac)
        slot = owner[inside] * m + ((draw[inside] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((draw[inside], t[inside], slot))
        s = slot[order]
        lead = order[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else order
        at, ti = slot[lead], t[inside][lead]
        better = ti < when[at]
        when[at[better]] = ti[better]
        who[at[better]] = draw[inside][lead][better]
        last = when.reshape(n_rows, m).max(1)
    return who.reshape(n_rows, m)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = BANDS * ROWS
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            n = b.num_rows
            row, h = shingles(*utf8(b.column("text")))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            size = np.bincount(row, minlength=n)
            ids = np.flatnonzero(size)
            back = np.zeros(n, np.int64)
            back[ids] = np.arange(len(ids))
            sig = signatures(back[row[at]], h[at], np.diff(np.append(at, len(h))), len(ids), m)
            with np.errstate(over="ignore"):
                band = np.zeros((len(ids), BANDS), np.uint64)
                cols = sig.reshape(len(ids), BANDS, ROWS)
                for j, p in enumerate(powers(ROWS)):
                    band += cols[:, :, j] * p
                band = mix64(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                occ = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
                tagged = mix64(h + occ.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
                edges = np.searchsorted(row, ids)
                k1 = np.add.reduceat(tagged, edges) if len(ids) else tagged
                k2 = np.add.reduceat(mix64(tagged ^ np.uint64(0xC2B2AE3D27D4EB4F)), edges) if len(ids) else tagged
            # two bits of every register: a sketch that bounds similarity without the texts
            bits = (sig & np.uint64(3)).astype(np.uint8)
            packed = np.zeros((len(ids), m // 32), np.uint64)
            for j in range(m):
                packed[:, j // 32] |= bits[:, j].astype(np.uint64) << np.uint64(2 * (j % 32))
            pick = pa.array(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pick), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.array(size[ids], pa.int64()),
                 pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                 pa.array(list(packed.view(np.int64)), pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence-tagged shingles: the overlap of these sets is that of the
    multisets."""
    for whole in batches:
        for b in slices(whole, "text"):
            row, h = shingles(*utf8(b.column("text")))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            occ = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
            with np.errstate(over="ignore"):
                tagged = mix64(h + occ.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
            edges = np.searchsorted(row, np.arange(b.num_rows + 1))
            cell = (tagged >> np.uint64(54)).astype(np.int64)
            bits = np.zeros((b.num_rows, CELLS // 64), np.uint64)
            np.bitwise_or.at(bits, (row, cell // 64), np.uint64(1) << (cell % 64).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tagged.view(np.int64))),
                 pa.array(list(bits.view(np.int64)), pa.list_(pa.int64()))], names=["id", "set", "cells"])


def _set_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set, cells) of the documents with these ids. The ids are broadcast where
    there are few of them, else the texts are shuffled to them."""
    ids = cut(ids.select("id").distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    few = ids.count() <= BROADCAST_IDS
    need = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return cut(need.mapInArrow(_sets, "id long, set array<long>, cells array<long>").dropDuplicates(["id"]))


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the candidate pairs (src, dst) those whose shingle multisets overlap
    by at least the threshold."""
    pairs = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = (pairs.join(sets.select(F.col("id").alias("dst"), F.col("set").alias("b")), "dst")
            .join(sets.select(F.col("id").alias("src"), F.col("set").alias("a")), "src"))
    # a pair can only reach the threshold if the sizes do
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    common = F.when(small >= large * threshold, F.size(F.array_intersect("a", "b"))).otherwise(F.lit(0))
    return both.select("src", "dst", common.alias("c"), (F.size("a") + F.size("b")).alias("s")).where(
        F.col("c") >= (F.col("s") - F.col("c")) * F.lit(threshold) - F.lit(1e-9)).select("src", "dst")


def _shareable(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, most, cells): size of a document's multiset, and how much of it
    any other of these documents holds. No pair overlaps in more."""
    own = sets.join(ids, "id", "left_semi")
    alone = (own.select("id", F.explode("set").alias("s")).groupBy("s")
             .agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("u")))
    return own.select("id", F.size("set").alias("n"), "cells").join(alone, "id", "left").select(
        "id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"), "cells")


def _missing(a: str, b: str):
    """Cells of a document that the other leaves empty: each holds at least
    one shingle they don't share."""
    return sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(1, CELLS // 64)),
               F.bit_count(F.col(a)[0].bitwiseAND(F.bitwise_not(F.col(b)[0]))))


def _may_be_similar(a: str, b: str, threshold: float):
    """Sketches differ in no more places than six standard deviations above
    what the threshold predicts."""
    m = BANDS * ROWS
    low = F.lit(0x5555555555555555)
    diff = sum(
        (F.bit_count(((F.col(a)[k].bitwiseXOR(F.col(b)[k])).bitwiseOR(
            F.shiftright(F.col(a)[k].bitwiseXOR(F.col(b)[k]), 1))).bitwiseAND(low)) for k in range(1, m // 32)),
        F.bit_count(((F.col(a)[0].bitwiseXOR(F.col(b)[0])).bitwiseOR(
            F.shiftright(F.col(a)[0].bitwiseXOR(F.col(b)[0]), 1))).bitwiseAND(low)))
    p = (1 - threshold) * 0.75
    return diff <= int(m * p + 6 * (m * p * (1 - p)) ** 0.5)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, class_id, group_id): one row per distinct doc_id.
    class_id is the smallest doc_id with the same shingle multiset, group_id
    the smallest doc_id reachable by links. Of rows that share a doc_id but
    not the text, the smallest (class key) stands for the id."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    key = ["k1", "k2", "n"]
    sig = cut(docs.mapInArrow(
        _sign, "doc_id long, k1 long, k2 long, n long, bands array<long>, sketch array<long>"))
    member = cut(sig.select("doc_id", F.col("n").alias("n_shingles"), F.min("doc_id").over(Window.partitionBy(*key)).alias("class_id")))
    reps = cut(sig.join(member.where("doc_id = class_id").select("doc_id").distinct(), "doc_id", "left_semi")
               .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "bands", "sketch"))

    bucket = Window.partitionBy("band")
    band = reps.select("id", F.explode("bands").alias("band")).withColumn("size", F.count("*").over(bucket)).where("size > 1")
    # the member that shares most buckets with most others stands in the middle of its group
    band = cut(band.withColumn("weight", F.sum("size").over(Window.partitionBy("id"))))
    lead = F.min(F.struct((-F.col("weight")).alias("w"), "id")).over(bucket)
    star = cut(band.withColumn("lead", lead).select(F.col("lead.id").alias("src"), F.col("id").alias("dst")).distinct())
    sets = _set_table(star.select(F.col("dst").alias("id")), docs)
    links = cut(_links(star, sets, threshold))
    comp = cut(components(links))

    # what is left: pairs of a bucket in different components
    at = (band.select("band", "id").join(comp, "id", "left")
          .select("band", "id", F.coalesce("comp", "id").alias("comp")))
    count = at.groupBy("band", "comp").agg(F.count("*").alias("k"))
    big = count.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("size"),
                                    F.count("*").alias("comps")).where("comps > 1")
    at = cut(at.join(big, "band"))
    # a document with too many shingles of its own is similar to none
    share = _shareable(sets, at.select("id").distinct()).where(F.col("most") >= F.col("n") * F.lit(threshold) - F.lit(1e-9))
    at = cut(at.join(share, "id").join(reps.select("id", "sketch"), "id")
             .select("band", "id", "comp", "sketch", "cells", "n", "most", (F.col("comp") == F.col("m.comp")).alias("largest"),
                     F.ceil(F.col("size") / SPLIT).cast("int").alias("parts")))
    left = at.where("not largest").select(
        "band", F.col("id").alias("src"), F.col("comp").alias("c1"), F.col("sketch").alias("s1"), F.col("cells").alias("b1"), F.col("n").alias("n1"),
        F.col("most").alias("m1"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    right = at.select(
        "band", F.col("id").alias("dst"), F.col("comp").alias("c2"), F.col("sketch").alias("s2"), F.col("cells").alias("b2"), F.col("n").alias("n2"),
        F.col("most").alias("m2"), "largest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    overlap = F.least(F.col("m1"), F.col("m2"), F.col("n1") - _missing("b1", "b2"), F.col("n2") - _missing("b2", "b1"))
    rest = (left.join(right, ["band", "salt"])
            .where((F.col("c1") != F.col("c2")) & (F.col("largest") | (F.col("src") < F.col("dst")))
                   & (overlap >= (F.col("n1") + F.col("n2") - overlap) * F.lit(threshold) - F.lit(1e-9))
                   & _may_be_similar("s1", "s2", threshold))
            .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    done = star.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    more = _links(rest.join(done, ["src", "dst"], "left_anti"), sets, threshold)
    comp = cut(components(links.union(more)))
    grouped = (member.join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
               .select("doc_id", "n_shingles", "class_id", F.coalesce("comp", "class_id").alias("group_id")))
    # one row per id, also for ids whose text has no words or is null
    return (docs.select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"),
                        F.col("doc_id").alias("group_id"))
            .union(grouped).groupBy("doc_id").agg(
                F.coalesce(F.max("n_shingles"), F.lit(0).cast("long")).alias("n_shingles"),
                F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group (the
    smallest doc_id). Rows without a doc_id stay; of rows with the same doc_id
    one stays. A text without words is only a copy of its own doc_id."""
    groups = near_duplicates(docs, threshold)
    best = groups.where("doc_id = group_id").select(F.col("doc_id").alias("_keep"))
    kept = docs.join(best, docs["doc_id"].cast("long") == F.col("_keep"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))



