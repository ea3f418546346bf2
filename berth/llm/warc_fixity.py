"""WARC fixity audit with Merkle trees (operator 7).

Records (file, pos, record) of an archive replica are hashed with their offset
range in the file; ``FAN`` neighbouring nodes at a time are hashed into a
parent, up to one root per file and on over the files to one root of the
archive. Two replicas are compared from the root: only children of nodes that
differ are looked at, down to the records that differ.

The level tables are aggregates over at most ``FAN`` children a group; the
descent joins the few differing nodes to the next level.

Defined results: equal replicas give no row; a record that only one replica
has is ``missing`` or ``extra``; a null record is hashed as an empty one;
records that share (file, pos) are taken in the order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import cut, prepare

FAN, PER_FILE = 16, 256


def warc_record(uri: str = "url", record_id: str = "page_id", body: str = "html"):
    """One WARC/1.1 resource record as text."""
    payload = F.coalesce(F.col(body), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(record_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(uri), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def layout(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, pos, page_id, url, record, copies): the pages as records of
    files of about ``per_file``. Equal rows are one record; a file is drawn by
    a hash of the whole row, so no id or address can fill one."""
    rec = pages.select("page_id", "url", warc_record().alias("record")).withColumn("digest", F.md5("record"))
    one = rec.groupBy("page_id", "url", "digest").agg(F.count("*").alias("copies"))
    files = F.lit(max(1, -(-one.count() // per_file)))
    draw = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), files).cast("int")
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest")
    at = one.withColumn("file", draw).withColumn("pos", F.row_number().over(order) - 1)
    # bodies are joined by content, without the copies
    body = rec.dropDuplicates(["digest"]).select("digest", "record")
    return at.join(body, "digest").select("file", "pos", "page_id", "url", "record", "copies", "digest")


def leaves(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, pos, start, end, hash): offset range and hash of each record."""
    rec = F.coalesce(F.col("record"), F.lit(""))
    h = records.select("file", "pos", *keep, F.octet_length(rec).alias("size"), F.sha2(rec, 256).alias("own"))
    w = Window.partitionBy("file").orderBy("pos", "own")
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("seq", F.row_number().over(
        Window.partitionBy("file", "pos").orderBy("own")))
    return h.select("file", "pos", "seq", *keep, "start", "end",
                    F.sha2(F.concat_ws(":", "start", "end", "own"), 256).alias("hash"), "own")


def _parents(level: DataFrame, by: list[str]) -> DataFrame:
    got = level.groupBy(*by, F.floor(F.col("idx") / FAN).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
    text = F.concat_ws(",", F.transform("kids", lambda k: F.concat_ws(":", k["idx"], k["hash"])))
    return got.select(*by, F.col("up").alias("idx"), F.sha2(text, 256).alias("hash"))


def _depth(n: int) -> int:
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def tree(leaf: DataFrame, pos_depth: int, file_depth: int) -> list[DataFrame]:
    """Level tables (file, idx, hash) from records up to the archive's root;
    in the levels over files, file is 0."""
    same = leaf.groupBy("file", "pos").agg(F.sort_array(F.collect_list("hash")).alias("h"))
    cur = same.select("file", F.col("pos").alias("idx"), F.concat_ws("+", "h").alias("hash"))
    out = [cut(cur)]
    for _ in range(pos_depth):
        out.append(cut(_parents(out[-1], ["file"])))
    cur = out[-1].select(F.lit(0).alias("file"), F.col("file").alias("idx"), "hash")
    for _ in range(file_depth):
        out.append(cut(_parents(cur, ["file"])))
        cur = out[-1]
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    return (a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["file", "idx"], "full")
            .where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "idx"))


def audit(left: DataFrame, right: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records in which ``right`` differs from ``left``: file, pos, the
    ``keep`` columns, status (changed, missing, extra), offsets and hashes in
    both replicas. A record that only moved (an earlier one changed its
    length) is ``moved``."""
    prepare(left.sparkSession)
    la, lb = cut(leaves(left, keep)), cut(leaves(right, keep))
    # the trees need the same shape: the larger number of positions and files
    top = la.select("file", "pos").union(lb.select("file", "pos")).agg(F.max("pos").alias("p"), F.max("file").alias("f")).first()
    pd, fd = _depth((top["p"] or 0) + 1), _depth((top["f"] or 0) + 1)
    ta, tb = tree(la, pd, fd), tree(lb, pd, fd)
    bad = cut(_differ(ta[-1], tb[-1]))
    for lv in range(len(ta) - 2, -1, -1):
        # one level down, below differing nodes only
        if lv >= pd:  # a level over files; the file roots carry their file as index
            shape = (lambda t: t.select(F.lit(0).alias("file"), F.col("file").alias("idx"), "hash")) if lv == pd else (lambda t: t)
            below = lambda t, s=shape: s(t).withColumn("up", F.floor(F.col("idx") / FAN)).join(
                bad.select("file", F.col("idx").alias("up")), ["file", "up"], "left_semi").drop("up")
        else:
            if lv == pd - 1 and fd:
                bad = bad.select(F.col("idx").alias("file"), F.lit(0).cast("long").alias("idx"))
            below = lambda t: t.withColumn("up", F.floor(F.col("idx") / FAN)).join(
                bad.select("file", F.col("idx").alias("up")), ["file", "up"], "left_semi").drop("up")
        bad = cut(_differ(below(ta[lv]), below(tb[lv])))
    if not pd and fd:
        bad = bad.select(F.col("idx").alias("file"), F.lit(0).alias("idx"))
    at = bad.select("file", F.col("idx").cast("int").alias("pos"))
    side = lambda t, s: t.join(at, ["file", "pos"], "left_semi").select(
        "file", "pos", "seq", *[F.col(c).alias(f"{c}_{s}") for c in (*keep, "start", "end", "own", "hash")])
    both = side(la, "a").join(side(lb, "b"), ["file", "pos", "seq"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    status = (F.when(F.col("own_b").isNull(), "missing").when(F.col("own_a").isNull(), "extra")
              .when(F.col("own_a") == F.col("own_b"), "moved").otherwise("changed"))
    return both.select(
        "file", "pos", *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in keep], status.alias("status"),
        *[F.col(f"{c}_{s}").alias(f"{c}_{s}") for s in "ab" for c in ("start", "end")], F.col("own_a").alias("sha256_a"), F.col("own_b").alias("sha256_b"))


def damaged_replica(records: DataFrame) -> DataFrame:
    """A replica of laid-out records with faults drawn from their digests: one
    of 128 has a changed byte, one of 512 is gone, one of 512 has lost its
    tail. Lengths of lost tails move the records behind them in the file."""
    draw = F.conv(F.substring("digest", 9, 6), 16, 10).cast("long")
    size = F.length("record")
    mid = F.floor(size / 2).cast("int")
    flipped = F.concat(F.substring("record", F.lit(1), mid), F.lit("\u0001"), F.substring("record", mid + 2, size))
    rec = (F.when(F.pmod(draw, F.lit(128)) == 5, flipped)
           .when(F.pmod(draw, F.lit(512)) == 7, F.substring("record", F.lit(1), mid)).otherwise(F.col("record")))
    return records.where(F.pmod(draw, F.lit(512)) != 9).withColumn("record", rec)
