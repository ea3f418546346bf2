"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from berth.session import ensure_checkpoint_dir, ship_package

# Rows of a batch are worked on in slices of about so many bytes of text, so
# that a Python worker's memory does not follow the batch size.
SLICE_BYTES = 1 << 21


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder set, package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batch: pa.RecordBatch, col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch by rows so that each part holds about ``max_bytes`` of
    ``col`` (a longer single text stays whole)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate(([0], np.cumsum(size)[:-1])) // max_bytes
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [n]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (null: empty)."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def match_ends(df: DataFrame, found: str, gaps: str, out: str, step: int = 256) -> DataFrame:
    """``df`` with the end offset of every match, from the matches of a
    pattern and the gaps that splitting by it leaves. Sums run over parts of
    ``step`` matches, then inside them, as an array grows by copying."""
    def scan(a, zero):
        return F.aggregate(a, F.array(zero), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    n = F.size(found)
    size = lambda i: F.length(F.get(gaps, i)) + F.length(F.get(found, i))
    part = lambda c: F.transform(F.sequence(c * step, F.least(c * step + step - 1, n - 1)), size)
    df = df.withColumn("_parts", F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), part)))
    df = df.withColumn("_bases", scan(F.transform("_parts", lambda p: F.aggregate(p, F.lit(0), lambda x, v: x + v)), F.lit(0)))
    return df.withColumn(out, F.flatten(F.transform(
        "_parts", lambda p, i: F.slice(scan(p, F.get("_bases", i)), F.lit(2), F.size(p))))).drop("_parts", "_bases")


_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _P, np.uint64))))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    Returns lower-cased bytes, word starts, word ends (exclusive), the row of
    each word and its 64-bit hash. Bytes of UTF-8 sequences are all >= 0x80.
    """
    low = _LOWER[raw]
    is_w = _WORD[low]
    n = len(low)
    if not n or not is_w.any():
        z = np.zeros(0, np.int64)
        return low, z, z, z, np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.concatenate(([False], is_w[:-1]))
    nxt = np.concatenate((is_w[1:], [False]))
    start = np.flatnonzero(is_w & (~prev | edge[:-1]))
    end = np.flatnonzero(is_w & (~nxt | edge[1:])) + 1
    row = np.searchsorted(off, start, side="right") - 1
    size = end - start
    at = np.flatnonzero(is_w)
    with np.errstate(over="ignore"):
        val = (low[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at - np.repeat(start, size)]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        h = mix64(np.add.reduceat(val, first))
    return low, start, end, row, h


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (length len(h)-n+1)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, p in enumerate(powers(n)):
            out += h[j:len(h) - n + 1 + j] * p
    return mix64(out)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(src, dst)``: (id, comp), comp being the
    smallest id. Alternating large-star / small-star rounds; only edge tables
    are shuffled, three times a round (once a star, once for distinct edges),
    and each round ends in a checkpoint. Null ends and self loops are ignored;
    nodes without an edge do not appear."""
    e = cut(edges.select("src", "dst").where("src <> dst")
            .select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct())
    lowest = F.min("u").over(Window.partitionBy("v"))
    last = None
    for _ in range(max_rounds):
        both = e.select("v", "u").union(e.select(F.col("u"), F.col("v")))
        # large star: every larger neighbour is linked to the node's minimum
        large = (both.withColumn("m", F.least(lowest, F.col("v"))).where("u > v")
                 .select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u"))
        # small star: the node and its smaller neighbours are linked to the minimum
        e = cut(large.withColumn("m", lowest).select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u"))
                .where("v <> u").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    out = e.select(F.col("v").alias("id"), F.col("u").alias("comp"))
    return out.union(e.select(F.col("u"), F.col("u")).distinct())
