"""Sources and sinks on real files: S2's landed files, S4's rewrites."""
import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from berth.operators import validation as V
from berth.plans.queries import REGISTRY
from berth.session import shared_dir
from berth.sources import fixtures as fx
from berth.sources import tables as S

from conftest import SF001


def test_files_of_every_kind(spark, tmp_path):
    files = [("a.JPG", b"\xff\xd8"), ("b.jpeg", b""), ("noend", b"x" * 300), ("c.tar.PNG", b"\x00" * 5), ("d.pdf ", b"1"), (".pdf", b"2"),
             ("e.exe", None), ("sp ace+%41.pdf", "ü".encode())]
    df = spark.createDataFrame(files, "file_name string, content binary").repartition(3)
    for _ in range(2):  # a second landing of the same files changes nothing
        S.land_files(df, str(tmp_path))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.png").write_bytes(b"deep")
    got = {r.file_name: r for r in S.read_binary_files(spark, str(tmp_path)).collect()}
    mime = {"a.JPG": "image/jpeg", "b.jpeg": "image/jpeg", "noend": S.MIME_OTHER, "c.tar.PNG": "image/png", "d.pdf ": S.MIME_OTHER,
            "e.exe": S.MIME_OTHER, "sp ace+%41.pdf": "application/pdf", "deep.png": "image/png"}
    assert {n: r.mime_type for n, r in got.items()} == mime  # hidden names (.pdf) are no uploads
    for name, content in files:
        if name != ".pdf":
            r = got[name]
            assert (r.size_bytes, r.file_hash) == (len(content or b""), hashlib.sha256(content or b"").hexdigest())
    assert got["noend"].content_b64 and "\n" not in got["noend"].content_b64
    assert {r.file_name for r in S.read_binary_files(spark, str(tmp_path), "*.pdf").collect()} == {"sp ace+%41.pdf"}


def test_empty_folder(spark, tmp_path):
    assert S.read_binary_files(spark, str(tmp_path)).count() == 0


def test_files_are_listed_and_read_in_tasks(spark, tmp_path):
    """1,500 files: no file's status comes to the driver (no file scan in the
    plan), they lie in subfolders, nothing depends on how many there are."""
    df = spark.range(1500).select(F.format_string("f%d.png", "id").alias("file_name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    S.land_files(df, str(tmp_path))
    folders = [d for d in os.listdir(tmp_path) if os.path.isdir(tmp_path / d)]
    assert len(folders) == S.SHARDS and max(len(os.listdir(tmp_path / d)) for d in folders) < 30
    (tmp_path / "flat.png").write_bytes(b"flat")
    (tmp_path / "_x=1").mkdir()
    (tmp_path / "_x=1" / "kept.png").write_bytes(b"")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "hidden.png").write_bytes(b"h")
    rows = S.read_binary_files(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "InMemoryFileIndex" not in plan
    got = {r.file_name: bytes(r.content) for r in rows.collect()}
    assert got == {**{f"f{i}.png": str(i).encode() for i in range(1500)}, "flat.png": b"flat", "kept.png": b""}


def _bytes(path):
    out = {}
    for f in glob.glob(f"{path}/date=*/part-*"):
        with open(f, "rb") as h:
            out[os.path.relpath(f, path)] = h.read()
    return out


def test_second_write_leaves_other_dates_alone_and_reads_prune(spark):
    rows = fx.validations(spark, SF001).withColumn("date", F.to_date("created_at"))
    path = S.snapshot_path(spark, "t-validations")
    S.write_snapshot(rows, path, ["date"], ["session_id"])
    before = _bytes(path)
    assert len({f.split("/")[0] for f in before}) > 20
    again = rows.where("date = DATE '2024-01-10'").withColumn("overall_status", F.lit("AGAIN"))
    n = again.count()
    S.write_snapshot(again, path, ["date"], ["session_id"])
    after = _bytes(path)
    same = {f: b for f, b in before.items() if not f.startswith("date=2024-01-10/")}
    assert {f: b for f, b in after.items() if not f.startswith("date=2024-01-10/")} == same
    back = spark.read.parquet(path)
    assert back.count() == rows.count() and back.where("overall_status = 'AGAIN'").count() == n > 0
    one = back.where("date = DATE '2024-01-10' and session_id > 5")
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters: ["):]
    assert "date" in scan[:scan.index("]")] and "PushedFilters: [IsNotNull(session_id), GreaterThan(session_id,5)]" in plan
    assert len(one.inputFiles()) >= 1 and one.where("overall_status <> 'AGAIN'").count() == 0


def test_registered_file_query_reads_every_document(spark):
    got = REGISTRY["s2_binary_files"](spark, SF001)
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert got.count() == n and got.where("size_bytes = 0").count() >= n // 20
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def _tables_with_repeats(spark, tmp_path):
    """The smoke tables, where some customers and events come twice (one under
    another name or score), and one of each has no key."""
    for name in os.listdir(SF001):
        if name not in ("customer.parquet", "events.parquet"):
            os.symlink(f"{SF001}/{name}", tmp_path / name)
    c = spark.read.parquet(f"{SF001}/customer.parquet")
    more = c.where("c_custkey % 7 = 0").unionByName(c.where("c_custkey % 14 = 0").withColumn("c_name", F.lit("Other Name")))
    c.unionByName(more).unionByName(c.limit(1).withColumn("c_custkey", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "customer.parquet"))
    e = spark.read.parquet(f"{SF001}/events.parquet").limit(60)
    more = e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    e.unionByName(more).unionByName(e.limit(1).withColumn("event_id", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", list(fx.PAIRED))
def test_texts_are_made_beside_their_rows(spark, tmp_path, name):
    """No join sends the texts through the driver, and the rows, those of
    repeated and absent keys too, are those of the view's SQL."""
    sf = _tables_with_repeats(spark, tmp_path)
    got = fx.view(spark, sf, name)
    want = fx.view_inline(spark, sf, name)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    table, key, _ = fx.PAIRED[name]
    assert fx.view(spark, sf, table).groupBy(key).count().where(f"count > 1 and {key} is not null").count() > 0
    plan = fx._built(spark, sf, name)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for x in plan[i + 1:]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            assert below and not any("AS js#" in x for x in below)


def test_extractions_of_a_session_lie_together(spark):
    """The files of a session's uploads are told apart without a shuffle by
    file, and the wide rows are not sorted: so a session lies in one file, and
    aggregates by session are combined before they are shuffled."""
    wide = fx._extractions(fx._built(spark, SF001, "fx_ext"))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in wide
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = fx._built(spark, SF001, "fx_extractions").select("session_id", F.spark_partition_id().alias("part")).distinct().persist()
        assert at.select("part").distinct().count() > 1
        assert at.count() == at.select("session_id").distinct().count()
        at.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(90)
    docs.repartition(20).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    os.mkdir(tmp_path / "single")
    os.rename(glob.glob(str(tmp_path / "one" / "*.parquet"))[0], tmp_path / "single" / "documents.parquet")
    got = [sorted(REGISTRY["s3_intake_stream"](spark, str(tmp_path / d)).collect()) for d in ("many", "single")]
    assert len(got[0]) == 90 and got[0] == got[1]
    assert {r.upload_id for r in got[0]} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_parsed_results_are_not_broadcast(spark):
    plan = REGISTRY["r9_latest_validation_full"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_prompts_are_gathered_from_rows_not_shuffled_texts(spark, monkeypatch):
    """The shuffle by session carries columns, not texts, to as many
    partitions as the documents ask for; no other shuffle follows, and the
    prompts don't depend on their number."""
    ext = fx.extractions(spark, SF001)
    want = V.validation_requests(ext, "2024-06-30").collect()
    monkeypatch.setattr(V, "DOCS_PER_TASK", 20)
    more = V.validation_requests(ext, "2024-06-30")
    plan = more._jdf.queryExecution().executedPlan().toString().split("\n")
    shuffles = [x for x in plan if "Exchange" in x]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]
    n = ext.where("status = 'COMPLETE'").count()
    assert n > 20 * 8 and f", {-(-n // 20)}), REPARTITION_BY_NUM" in shuffles[0]
    below = "\n".join(plan[plan.index(shuffles[0]):])
    assert "createdAt" not in below
    assert sorted(more.collect()) == sorted(want) and len(want) > 0


def test_shuffle_files_of_finished_steps_go(spark):
    import time

    from berth.session import release
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = list(env.blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    release(spark)
    time.sleep(2)
    before = files()
    spark.range(10_000).repartition(3, "id").write.parquet(shared_dir(spark, "t/released"))
    made = files() - before
    assert made
    until = time.time() + 30
    while made & files() and time.time() < until:
        release(spark)  # the step's last events may still hold its plan
        time.sleep(0.5)
    assert not made & files()


@pytest.mark.parametrize("name", ["fx_llm_attempts", "fx_envelopes"])
def test_stored_tables_are_zstd_and_their_shuffles_released(spark, monkeypatch, name):
    """X3 reads the attempts, X2 and X13 the envelopes."""
    calls = []
    monkeypatch.setattr(fx, "release", lambda s: calls.append(s))
    monkeypatch.setattr(fx, "_STORED", {})
    fx.view(spark, SF001, name)
    for path in fx._STORED.values():
        files = glob.glob(f"{path.removeprefix('file://')}/part-*")
        assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert len(calls) == len(fx._STORED) > 4
