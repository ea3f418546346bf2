"""Conversation prefix trie with a centroid rollup (operator 11).

A node is a distinct sequence of first turns; its name is its smallest member
conversation and its depth. Node keys are running XORs of 128 bits per turn
(position, role and text), so they come from running sums in blocks of turns
and a very long conversation is many rows, not one task. Two different
prefixes with one key would be found (their last turns differ) and raise.

Rollup by centroid decomposition of the parent-edge forest. A component is a
connected part of the trie with a top; a node's weight is the number of turns
that its members have from it on, which one aggregate gives for the whole
trie. Nodes with more than half of their component's weight are the path from
the top to the centroid, its last node. The centroid and its side of the
component are summed, the sum is added along the path, the centroid goes, and
its children's parts and the part around the top are components of at most
half the weight. Which child's part a node belongs to is the node that its
first member passes at that depth: one equi-join. Components of over ``BLOCK``
turns are split so by joins and aggregates (there are never more than ``MOST``
of them, so what is broadcast about them is bounded), smaller ones by the same
rule in NumPy, many to a task. Rounds: the logarithm of the weight, whatever
the trie's depth.

Defined results: turns of equal number are ordered by a digest of role and
text, repeated rows are turns of their own; a null role or text is empty; rows
with a null conv_id belong to no conversation and are left out; ``c - c % 5``
uses the remainder with the sign of c; long texts are read whole; other
columns play no part; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import cut, prepare

HEAD, GROUP = 9, 5  # h = crc32 % HEAD, base = c - c % GROUP
STEP = 1024  # turns of a block of running keys
BLOCK = 1 << 15
MOST = 100_000
CHUNK_IDS = 8192  # ids of a chunk of text to be hashed
NODE = ["d", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, digest, size, times): the text's part is over after this."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size")).groupBy("c", "turn", "digest", "size").agg(F.count("*").alias("times"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, d, digest, size, len) and conversations (c, len).

    Turns are range-partitioned by their order, so a long conversation spans
    partitions; its place in each is the sum of its counts before."""
    laid = cut(turns(conversations).repartitionByRange("c", "turn", "digest").withColumn("part", F.spark_partition_id()))
    inside = laid.groupBy("c", "part").agg(F.sum("times").alias("n"))
    convs = inside.groupBy("c").agg(F.sum("n").alias("n")).withColumn("base", F.col("c") - F.col("c") % GROUP)
    heads = convs.select(F.col("c").alias("base"), F.col("n").alias("nb"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEAD
    convs = convs.join(heads, "base", "left").withColumn("h", h).select(
        "c", "base", "h", F.least("h", F.coalesce("nb", F.lit(0))).alias("s"), "n").withColumn(
        "len", F.col("s") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = cut(convs)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = inside.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).join(convs.drop("n", "base"), "c").drop("n")
    run = Window.partitionBy("c", "part").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = laid.withColumn("run", F.coalesce(F.sum("times").over(run), F.lit(0))).join(places, ["c", "part"]).select(
        "c", "h", "s", "len", "digest", "size", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("i"),
        (F.col("off") + F.col("run")).alias("r0")).withColumn("r", F.col("r0") + F.col("i"))
    own = ranked.where("r > h").select("c", (F.col("r") - F.col("h") + F.col("s")).alias("d"), "digest", "size", "len")
    first = ranked.where((F.col("c") % GROUP == 0) & (F.col("r") < HEAD)).select(
        F.col("c").alias("base"), F.col("r").alias("d"), "digest", "size")
    shared = convs.where("s > 0").join(first, "base").where("d <= s").select("c", "d", "digest", "size", "len")
    return own.unionByName(shared), convs.select("c", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, len, size, z1, z2, x1, x2): keys of each turn and of the prefix
    that it ends."""
    rows = rows.withColumn("b", F.floor((F.col("d") - 1) / STEP).cast("long")).withColumn(
        "z1", F.xxhash64("d", "digest")).withColumn("z2", F.xxhash64("digest", F.lit("second"), "d"))
    run = Window.partitionBy("c", "b").orderBy("d")
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "b").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"))
    blocks = blocks.select("c", "b", *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(t) for t in ("t1", "t2")])
    seen = rows.select("c", "b", "d", "len", "size", "z1", "z2", F.bit_xor("z1").over(run).alias("r1"), F.bit_xor("z2").over(run).alias("r2"))
    return seen.join(blocks, ["c", "b"]).select(
        "c", "d", "len", "size", "z1", "z2", F.expr("r1 ^ t1").alias("x1"), F.expr("r2 ^ t2").alias("x2"))


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv, d, pconv, n_convs, n_children, weight, bytes), and which
    node each member passes (c, d, conv, pconv, len), the root left out."""
    whole = convs.agg(F.min("c").alias("c"), F.count("*").alias("n"), F.sum(F.col("len") + 1).alias("w")).first()
    root = F.lit(whole["c"]).cast("long")
    nodes = cut(rows.groupBy(*NODE).agg(
        F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("d") + 1).alias("weight"), F.max("size").alias("bytes"),
        F.min("z1").alias("z1"), F.min("z2").alias("z2"), F.max("z1").alias("m1"), F.max("z2").alias("m2")))
    if nodes.where("z1 <> m1 or z2 <> m2").limit(1).count():
        raise RuntimeError("two different prefixes have one key")
    nodes = nodes.drop("m1", "m2").withColumn("p1", F.expr("x1 ^ z1")).withColumn("p2", F.expr("x2 ^ z2")).drop("z1", "z2")
    up = [(F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    over = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("pconv"))
    named = nodes.where("d = 1").withColumn("pconv", root).unionByName(nodes.where("d > 1").join(over, ["d", "p1", "p2"]))
    named = cut(named.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    passes = rows.select("c", "len", *NODE).join(named.select(*NODE, "conv", "pconv"), NODE).select("c", "d", "conv", "pconv", "len")
    cols = ["conv", "d", "pconv", "n_convs", "n_children", "weight", "bytes"]
    top = convs.sparkSession.range(1).select(
        root.alias("conv"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("pconv"), F.lit(whole["n"]).alias("n_convs"),
        F.lit(named.where("d = 1").count()).alias("n_children"), F.lit(whole["w"]).alias("weight"), F.lit(0).cast("long").alias("bytes"))
    return named.select(*cols).unionByName(top.where("conv is not null")), passes


# --- rollup ------------------------------------------------------------------

def _preorder(parent: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preorder places and subtree sizes; parent is -1 at level 0."""
    n = len(parent)
    size, place = np.ones(n, np.int64), np.zeros(n, np.int64)
    by = np.lexsort((parent, level))
    edge = np.searchsorted(level[by], np.arange(level.max() + 2))
    for a, b in zip(edge[-2:0:-1], edge[:1:-1], strict=True):
        np.add.at(size, parent[by[a:b]], size[by[a:b]])
    top = by[:edge[1]]
    place[top] = np.cumsum(size[top]) - size[top]
    for a, b in zip(edge[1:-1], edge[2:], strict=True):
        at = by[a:b]
        before = np.cumsum(size[at]) - size[at]
        first = np.concatenate(([True], parent[at[1:]] != parent[at[:-1]]))
        place[at] = place[parent[at]] + 1 + before - np.repeat(before[first], np.diff([*np.flatnonzero(first), len(at)]))
    return place, size


def rollup(top: np.ndarray, level: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of ``values`` inside each component by centroid
    decomposition. top: row of the component's top."""
    n = len(top)
    place, size = _preorder(parent, level)
    row = np.argsort(place)  # from here on, nodes in preorder
    size, weight, level, label = size[row], weight[row].copy(), level[row], place[top[row]]
    values = [v[row] for v in values]
    sums = [np.zeros(n, np.int64) for _ in values]
    at_level = np.sort(level * n + np.arange(n))
    at = np.arange(n)
    while len(at):
        lab = label[at]
        path = 2 * weight[at] > weight[lab]
        centre = np.full(n, -1)
        np.maximum.at(centre, lab[path], at[path])  # on a path, deeper is later
        k = centre[lab]
        under = (at >= k) & (at < k + size[k])
        for v, s in zip(values, sums, strict=True):
            total = np.zeros(n, np.int64)
            np.add.at(total, lab[under], v[at[under]])
            s[at[path]] += total[lab[path]]
        over = path & (at != k)
        weight[at[over]] -= weight[k[over]]
        into = under & (at != k)
        child = at_level[np.searchsorted(at_level, (level[k[into]] + 1) * n + at[into], side="right") - 1] % n
        label[at[into]] = child
        at = at[at != k]
    out = [np.empty(n, np.int64) for _ in sums]
    for o, s in zip(out, sums, strict=True):
        o[row] = s
    return out


STATE = "conv long, d long, pconv long, tc long, td long, weight long, leaf long, save long, s_leaf long, s_save long"
COLS = [f.split()[0] for f in STATE.split(", ")]


def _solve(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Whole components of a task, rows sorted by (tc, td, d, conv)."""
    def done(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        conv, d, tc, td = x["conv"], x["d"], x["tc"], x["td"]
        new = np.concatenate(([True], (tc[1:] != tc[:-1]) | (td[1:] != td[:-1])))
        top = np.flatnonzero(new)[np.cumsum(new) - 1]
        step = np.concatenate(([True], new[1:] | (d[1:] != d[:-1])))
        lev = np.cumsum(step)
        names, code = np.unique(conv, return_inverse=True)
        key = lev * len(names) + code
        parent = np.searchsorted(key, (lev - 1) * len(names) + np.searchsorted(names, x["pconv"]))
        parent[new] = -1
        leaf, save = rollup(top, d - td, parent, x["weight"], [x["leaf"], x["save"]])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (conv, d, leaf + x["s_leaf"], save + x["s_save"])], names=["conv", "d", "n_leaves", "saved_tokens"])

    kept: list[dict[str, np.ndarray]] = []
    rows = 0
    for b in batches:
        got = {c: b.column(c).fill_null(0).to_numpy() for c in COLS}
        kept.append(got)
        rows += b.num_rows
        if rows < least or not b.num_rows:
            continue
        x = {c: np.concatenate([k[c] for k in kept]) for c in COLS}
        change = np.flatnonzero((x["tc"][1:] != x["tc"][:-1]) | (x["td"][1:] != x["td"][:-1]))
        last = change[-1] + 1 if len(change) else 0  # the last component may go on
        if last:
            yield done({c: v[:last] for c, v in x.items()})
        kept = [{c: v[last:] for c, v in x.items()}]
        rows = rows - last
        least = max(1 << 16, 2 * rows)
    x = {c: np.concatenate([k[c] for k in kept]) for c in COLS} if kept else {"d": []}
    if len(x["d"]):
        yield done(x)


def subtree_sums(nodes: DataFrame, passes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, d, n_leaves, saved_tokens) of every node."""
    zero = F.lit(0).cast("long")
    top = nodes.where("d = 0").select("conv", "weight").first()
    if top is None:
        return nodes.select("conv", "d", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    state = nodes.select(
        "conv", "d", "pconv", F.lit(top["conv"]).cast("long").alias("tc"), zero.alias("td"), "weight", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"), zero.alias("s_leaf"), zero.alias("s_save"))
    limit = max(block, top["weight"] // MOST)
    if top["weight"] > limit:
        state = cut(state)
    whole, settled, ready = 2 * top["weight"], [], []
    while True:
        # Components lie apart, so at most MOST weigh over 1 / MOST of the
        # whole: that bounds each broadcast below.
        large = state.where("conv = tc and d = td").select("tc", "td", F.col("weight").alias("total")).where(F.col("total") > limit)
        left = large.agg(F.sum("total").alias("w")).first()["w"]
        if left is None:
            ready.append(state)
            break
        state = state.join(F.broadcast(large), ["tc", "td"], "left")
        ready.append(state.where("total is null").select(*COLS))
        state = state.where("total is not null")
        if 2 * left <= whole:  # only members that still name a node are looked up
            whole, passes = left, cut(passes.join(state.select(F.col("conv").alias("c")).distinct(), "c", "left_semi"))
        centre = F.max_by(F.struct("conv", "d", "weight"), "d").alias("k")
        centres = state.where("2 * weight > total").groupBy("tc", "td").agg(centre).select(
            "tc", "td", F.col("k.conv").alias("kc"), F.col("k.d").alias("kd"), F.col("k.weight").alias("kw"))
        state = state.join(F.broadcast(centres), ["tc", "td"]).withColumn("ahead", F.when(F.col("d") > F.col("kd"), F.col("kd") + 1))
        side = passes.select(F.col("c").alias("conv"), F.col("d").alias("ahead"), F.col("conv").alias("cc"), F.col("pconv").alias("cp"))
        state = cut(state.join(side, ["conv", "ahead"], "left").withColumn(
            "under", F.when((F.col("d") == F.col("kd")) & (F.col("conv") == F.col("kc")), 2)
            .when(F.col("cp") == F.col("kc"), 1).otherwise(0)))
        totals = state.where("under > 0").groupBy("tc", "td").agg(F.sum("leaf").alias("t_leaf"), F.sum("save").alias("t_save"))
        path = F.expr("2 * weight > total")
        state = cut(state.join(F.broadcast(totals), ["tc", "td"]).select(
            "conv", "d", "pconv", "under",
            F.when(F.col("under") == 1, F.col("cc")).otherwise(F.col("tc")).alias("tc"),
            F.when(F.col("under") == 1, F.col("kd") + 1).otherwise(F.col("td")).alias("td"),
            F.when(path, F.col("weight") - F.col("kw")).otherwise(F.col("weight")).alias("weight"), "leaf", "save",
            *[(F.col(f"s_{v}") + F.when(path, F.col(f"t_{v}")).otherwise(0)).alias(f"s_{v}") for v in ("leaf", "save")]))
        settled.append(state.where("under = 2").select("conv", "d", F.col("s_leaf").alias("n_leaves"), F.col("s_save").alias("saved_tokens")))
        state = state.where("under < 2").select(*COLS)
    parts = ready[0]
    for p in ready[1:]:
        parts = parts.unionByName(p)
    out = (parts.select(*COLS).repartition("tc", "td").sortWithinPartitions("tc", "td", "d", "conv")
           .mapInArrow(_solve, "conv long, d long, n_leaves long, saved_tokens long"))
    for s in settled:
        out = out.unionByName(s)
    return out


# --- digests of the conversations that end at a node ---------------------------

def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, d, c): the digest of every node that lies inside
    the task, and the text, in chunks, of its first and last node."""
    part, first, at, chunks, seq = TaskContext.get().partitionId(), True, None, [], 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        out.clear()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv", "d", "part", "seq", "text", "sha"])

    sha = None
    for b in batches:
        conv, d, c = (b.column(x).to_numpy() for x in ("conv", "d", "c"))
        if not len(conv):
            continue
        edge = [0, *(np.flatnonzero((conv[1:] != conv[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(conv)]
        ids = c.tolist()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            node = (int(conv[s]), int(d[s]))
            if at != node:
                if at is not None and not first:  # an inner node: whole in this task
                    out.append((*at, part, 0, None, sha.hexdigest()))
                    del chunks[:]
                elif at is not None:
                    out.extend((*at, part, k, t, None) for k, t in chunks)
                    del chunks[:]
                first = at is None
                at, sha, seq = node, hashlib.sha256(), 0
            for i in range(s, e, CHUNK_IDS):
                text = ",".join(map(str, ids[i:min(i + CHUNK_IDS, e)]))
                sha.update(f",{text}".encode() if seq else text.encode())
                chunks.append((seq, text))
                seq += 1
                if first:  # the first node's text need not wait
                    out.extend((*at, part, k, t, None) for k, t in chunks)
                    del chunks[:]
            if len(out) > 4096:
                yield batch()
    if at is not None and not first:
        out.extend((*at, part, k, t, None) for k, t in chunks)
    yield batch()


def _hash_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, d, part, seq): one digest a node."""
    at, sha, out = None, None, []
    for b in batches:
        for conv, d, text in zip(*(b.column(x).to_pylist() for x in ("conv", "d", "text")), strict=True):
            if at != (conv, d):
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (conv, d), hashlib.sha256(text.encode())
            else:
                sha.update(f",{text}".encode())
    if at:
        out.append((*at, sha.hexdigest()))
    cols = list(zip(*out, strict=True)) if out else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["conv", "d", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, d, ends_sha256) of the nodes at which conversations end
    (conv, d, c). A node's ids are joined where they lie sorted; only nodes at
    the edges of a partition meet again, as chunks of text."""
    done = cut(ends.repartitionByRange("conv", "d", "c").sortWithinPartitions("conv", "d", "c").mapInArrow(
        _join_ids, "conv long, d long, part int, seq long, text string, sha string"))
    rest = (done.where("sha is null").repartition("conv", "d").sortWithinPartitions("conv", "d", "part", "seq")
            .mapInArrow(_hash_text, "conv long, d long, ends_sha256 string"))
    return done.where("sha is not null").select("conv", "d", F.col("sha").alias("ends_sha256")).unionByName(rest)


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    rows, convs = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    nodes, passes = trie(cut(prefixes(rows)), convs)
    nodes, passes = cut(nodes), cut(passes)
    sums = subtree_sums(nodes, passes, block)
    first = nodes.agg(F.min("conv")).first()[0]  # the root's, as every conversation is its member
    ends = passes.where("d = len").select("conv", "d", "c").unionByName(
        convs.where("len = 0").select(F.lit(first).cast("long").alias("conv"), F.col("len").alias("d"), "c"))
    return (nodes.join(sums, ["conv", "d"]).join(end_digests(ends), ["conv", "d"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("pconv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
