"""Sinks of the streaming operators: replays, new keys, an empty start."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from berth.functions.expr import json_object_ok
from berth.operators.answers import IDENTITY, META, resolve_attempts
from berth.operators.ratelimit import rate_limit
from berth.session import shared_dir
from berth.streaming import streams as ST

CONTENT = ["document_type"]
SCHEMA = ("session_id string, file_hash string, version int, id string, file_name string, mime_type string, "
          "created_at timestamp, status string, error_code string, error_message string, retry_count int, "
          "prompt_version string, raw_text string, document_type string")


def _rows(spark, *rows):
    cols = ["session_id", "file_hash", "version", *IDENTITY, *META, *CONTENT]
    return spark.createDataFrame([tuple(dict(r).get(c) for c in cols) for r in rows], SCHEMA)


def _row(h, version, status, doc=None, id=None):
    return {"session_id": "s-1", "file_hash": h, "version": version, "id": id, "status": status, "document_type": doc,
            "error_code": None if status == "COMPLETE" else "LLM_ERROR"}


def _state(table):
    return {r.file_hash: (r.id, r.status, r.document_type, r.version) for r in table.read().collect()}


def _files(path):
    """Data files by bucket, with their times."""
    out = {}
    for d in sorted(glob.glob(f"{path}/_bucket=*")):
        out[int(d.rsplit("=", 1)[1])] = sorted((f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{d}/part-*"))
    return out


def test_upsert_keeps_content_over_three_batches_from_an_empty_table(spark):
    schema = _rows(spark).schema
    table = ST.extraction_table(spark, shared_dir(spark, "t/empty"), schema)
    sink = ST.upsert_stream(table, CONTENT)
    assert _state(table) == {}
    sink(_rows(spark, _row("a", 1, "COMPLETE", "COC")), 0)
    sink(_rows(spark, _row("a", 2, "FAILED")), 1)
    sink(_rows(spark), 2)
    sink(_rows(spark, _row("b", 1, "FAILED")), 3)
    got = _state(table)
    assert got["a"][1:] == ("FAILED", "COC", 2) and len(got["a"][0]) == 64
    assert got["b"][1:] == ("FAILED", None, 1)
    assert got["a"][0] != got["b"][0]


def test_upsert_on_a_stored_table_inserts_and_replays(spark):
    base = _rows(spark, _row("a", 1, "COMPLETE", "COC", id="s-1-1"))
    table = ST.extraction_table(spark, shared_dir(spark, "t/stored"), base.schema, base)
    sink = ST.upsert_stream(table, CONTENT)
    batch = _rows(spark, _row("a", 2, "COMPLETE", "PEME"), _row("new", 1, "COMPLETE", "SIRB"))
    for _ in range(2):  # the same batch id twice
        sink(batch, 0)
        got = _state(table)
        assert got["a"] == ("s-1-1", "COMPLETE", "PEME", 2)
        assert got["new"][1:] == ("COMPLETE", "SIRB", 1)
    assert table.read().count() == 2


def _counts(spark, ids, n=1):
    return spark.createDataFrame([(i, n) for i in ids], "k long, n long")


def _add(stored, rows):
    return stored.unionByName(rows).groupBy("k").agg(F.sum("n").alias("n"))


def test_untouched_buckets_stay_and_reads_do_not_grow(spark):
    path = shared_dir(spark, "t/buckets")
    table = ST.BucketTable(spark, path, _counts(spark, []).schema, ["k"], _counts(spark, range(500)), buckets=8)
    before = _files(path)
    assert sorted(before) == list(range(8))
    for batch_id in range(6):
        table.merge(_counts(spark, [3, 4, 5000]), batch_id, _add)
    after = _files(path)
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 3  # the buckets of three keys
    assert sum(map(len, after.values())) == sum(map(len, before.values()))  # six batches, no more files
    got = {r.k: r.n for r in table.read().collect()}
    assert got[3] == got[4] == 7 and got[5000] == 6 and got[5] == 1 and len(got) == 501


def test_replay_after_a_driver_lost_amid_the_overwrite(spark):
    """The merged buckets are stored, one was removed, none installed: the
    replay installs them and counts nothing twice."""
    path = shared_dir(spark, "t/lost")
    table = ST.BucketTable(spark, path, _counts(spark, []).schema, ["k"], _counts(spark, range(100)), buckets=4)
    install = table._install
    table._install = lambda rows: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError, match="driver lost"):
        table.merge(_counts(spark, range(50, 150)), 7, _add)
    for f, _ in _files(path)[2]:
        os.remove(f)
    table._install = install
    table.merge(_counts(spark, range(50, 150)), 7, _add)
    table.merge(_counts(spark, range(50, 150)), 7, _add)
    assert {r.k: r.n for r in table.read().collect()} == {k: 1 + (50 <= k < 100) for k in range(150)}


def test_large_batch_replayed(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("job_id"), F.lit("QUEUED").alias("status"))
    table = ST.BucketTable(spark, shared_dir(spark, "t/jobs"), df.schema, ["job_id"])
    table.merge(df, 0, table.latest)
    late = df.filter("job_id < 10").withColumn("status", F.lit("COMPLETE"))
    table.merge(late, 1, table.latest)
    table.merge(late, 1, table.latest)
    got = table.read().groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"QUEUED": n - 10, "COMPLETE": 10}


def test_first_row_wins_in_a_batch_and_over_batches(spark):
    """Two rows of a key in one batch, a later batch with a later row, and one
    with an earlier row."""
    schema = "s string, h string, seq long, name string"
    src = shared_dir(spark, "t/first-src")
    batches = [[("a", "x", 5, "five"), ("a", "x", 3, "three"), ("b", "x", 9, "nine")], [("a", "x", 4, "four"), ("c", None, 2, "two"), ("c", None, 1, "one")],
               [("b", "x", 8, "eight"), ("a", "x", 3, "other three"), ("c", None, 0, "zero")]]
    for rows in batches:  # one file each, in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = ST.intake_stream(spark, src, spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    ST.use_rocksdb(spark)
    first = ST.first_wins_stream(stream, ["s", "h"], ["seq"])
    table = ST.BucketTable(spark, shared_dir(spark, "t/first"), first.schema, ["s", "h"], buckets=4)
    seen = []

    def sink(batch, batch_id):
        table.merge(batch, batch_id, table.latest)
        seen.append({(r.s, r.h): (r.seq, r.name) for r in table.read().collect()})
    ST.drain(first, "t_first", output_mode="update", foreach_batch=sink)
    assert [x for x in seen if x] == [
        {("a", "x"): (3, "three"), ("b", "x"): (9, "nine")},
        {("a", "x"): (3, "three"), ("b", "x"): (9, "nine"), ("c", None): (1, "one")},
        {("a", "x"): (3, "other three"), ("b", "x"): (8, "eight"), ("c", None): (0, "zero")}]


def test_a_table_of_runs_is_not_written_whole_for_each_batch(spark):
    """T3 and T4's sink: 16 batches of new keys, a null key in each. Rows are
    written a logarithm of the batches' number of times, the newest batch of a
    key holds, and replays change nothing."""
    path = shared_dir(spark, "t/runs")
    schema = "k long, n long"
    table = ST.RunTable(spark, path, spark.createDataFrame([], schema).schema, ["k"])
    assert table.read().count() == 0
    write, written = table._write, []
    table._write = lambda rows, run: (write(rows, run), written.append(spark.read.parquet(table._folder(run)).count()))
    n, per = 16, 200

    def batch(i):
        rows = [(k, i) for k in range(per * i, per * (i + 1))] + [(None, i), (0, i)][:1 if i == 0 else 2]
        return spark.createDataFrame(rows, schema).coalesce(1)
    for i in range(n):
        table.sink(batch(i), i)
    want = {**{k: k // per for k in range(per * n)}, None: n - 1, 0: n - 1}
    assert {r.k: r.n for r in table.read().collect()} == want
    assert len(table._runs()[0]) <= 6
    assert sum(written) < n * per * 6 < sum(per * i for i in range(1, n + 1))  # the last: a table a batch
    table.sink(batch(n - 1), n - 1)
    table.sink(batch(n - 1), n - 1)
    assert table.read().count() == len(want) and {r.k: r.n for r in table.read().collect()} == want


def test_a_table_of_runs_after_a_driver_lost_amid_a_merge(spark):
    """A merged run without its _SUCCESS is none; one with it hides its parts."""
    path = shared_dir(spark, "t/runs-lost")
    table = ST.RunTable(spark, path, _counts(spark, []).schema, ["k"])
    table.sink(_counts(spark, range(100), 1), 0)
    table._merge = lambda: None
    table.sink(_counts(spark, range(50, 150), 2), 1)
    want = {k: 1 + (k >= 50) for k in range(150)}
    runs = table._runs()[0]
    assert runs == [(0, 0), (1, 1)]
    merged = table._folder((0, 1))
    table._newest(runs).limit(7).write.parquet(merged)
    os.remove(f"{merged.removeprefix('file://')}/_SUCCESS")
    assert {r.k: r.n for r in table.read().collect()} == want
    del table._merge
    table.sink(_counts(spark, range(50, 150), 2), 1)  # the replay
    assert table._runs()[0] == [(0, 1)]
    assert table.read().count() == 150 and {r.k: r.n for r in table.read().collect()} == want


def test_failed_repair_keeps_the_first_answer(spark):
    df = spark.createDataFrame(
        [("s", 1, 1, "INITIAL", "{ broken", None), ("s", 1, 2, "REPAIR", None, "LLM API error 500: upstream")],
        "session_id string, fid int, attempt_no int, stage string, raw_text string, error_message string")
    r = resolve_attempts(df).first()
    assert (r.status, r.raw_text) == ("FAILED", "{ broken")


def test_duplicate_keys_are_valid_json(spark):
    import __spark_entry__ as E
    E._prepare(spark)
    df = spark.createDataFrame([('{"a":1,"a":2}',), ("{'a':1}",)], "t string")
    assert [r.ok for r in df.select(json_object_ok("t").alias("ok")).collect()] == [True, False]


def test_idle_limiter_state_is_evicted_and_verdicts_stay(spark):
    """Runs over one checkpoint; after each the state store is read back. A
    client's state goes two windows after its window began."""
    window, limit = 400, 3
    src, out, ckpt = (shared_dir(spark, f"t/limit-{x}") for x in ("src", "out", "ckpt"))
    runs = [[("a", i, i) for i in range(5)] + [("b", 10 + i, 50 * i) for i in range(6)],
            [("c", 20 + i, 5_000 + i) for i in range(5)],
            [("a", 30 + i, 10_000 + 60 * i) for i in range(9)], [("d", 40, 20_000)]]
    runs = [[(c, i, ms + 1_000_000) for c, i, ms in rows] for rows in runs]  # nothing is before the first watermark, 1970
    schema = "client string, request_id long, ms long"
    kept = []
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ST.intake_stream(spark, src, spark.createDataFrame([], schema).schema)
        q = (ST.rate_limit_stream(stream, limit, window, evict=True).writeStream.option("checkpointLocation", ckpt)
             .format("parquet").option("path", out).trigger(availableNow=True).start())
        assert q.awaitTermination(60), q.stop()
        assert q.exception() is None
        state = spark.read.format("statestore").option("stateVarName", "window").load(ckpt)
        kept.append({r[0] for r in state.selectExpr("key.client").collect()})
    assert kept == [{"a", "b"}, {"c"}, {"a"}, {"d"}]
    every = spark.createDataFrame([r for rows in runs for r in rows], schema)
    want = sorted(map(tuple, rate_limit(every, limit, window).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
    assert {w[3] for w in want} == {True, False}


def test_a_merge_shuffles_a_bounded_part_of_the_table_at_a_time(spark):
    """T5's table: a batch that touches every bucket is merged some buckets at
    a time; a driver lost amid the moves loses and repeats nothing."""
    path = shared_dir(spark, "t/parts")
    table = ST.BucketTable(spark, path, _counts(spark, []).schema, ["k"], _counts(spark, range(400)), buckets=8)
    table.MERGE_ROWS = 200
    seen = []

    def add(stored, rows):
        seen.append(stored.count() + rows.count())
        return _add(stored, rows)
    real, moved = table._fs, []

    def fs(p):
        if "/_bucket=" in p:
            if len(moved) == 3:
                raise RuntimeError("driver lost")
            moved.append(p)
        return real(p)
    table._fs = fs
    with pytest.raises(RuntimeError, match="driver lost"):
        table.merge(_counts(spark, range(300, 500)), 0, add)
    del table._fs
    assert len(seen) == 4 and max(seen) <= 300 and sum(seen) == 600
    for _ in range(2):
        table.merge(_counts(spark, range(300, 500)), 0, add)
    assert len(seen) == 4  # nothing is folded again
    assert {r.k: r.n for r in table.read().collect()} == {k: 1 + (300 <= k < 400) for k in range(500)}


def test_runs_and_landed_files_are_zstd(spark):
    path = shared_dir(spark, "t/runs-zstd")
    table = ST.RunTable(spark, path, _counts(spark, []).schema, ["k"])
    for i in range(3):
        table.sink(_counts(spark, range(100)), i)
    landed = shared_dir(spark, "t/landed-zstd")
    ST.land_in_order(_counts(spark, range(10)), landed, "k", 2)
    files = glob.glob(f"{path}/run-*/part-*") + glob.glob(f"{landed}/part-*")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
