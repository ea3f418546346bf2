"""Operator 11 against brute force, and its rollup against plain sums."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from berth.llm import prefix_trie
from berth.llm.oracle import ORACLE
from berth.llm.queries import REGISTRY

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(t[3], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=lambda r: r[:2])


def talk(seed, n=60, deep=0):
    """Conversations over few texts, so that prefixes are shared; some copies,
    some long."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        size = rng.choice([0, 1, 2, 3, 9, 12, deep]) if deep else rng.randrange(1, 14)
        seq = [(rng.choice(["user", "bot"]), rng.choice("abß")) for _ in range(size)]
        if c % 3 == 0:
            seq = [("user", "a")] * len(seq)
        rows += [(c * 2 - 20, t, *x) for t, x in enumerate(seq)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [25, 1 << 15])
def test_shared_prefixes(spark, block):
    rows = talk(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.prefix_trie(df, block)) == brute(rows)


def test_deep_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STEP", 16)
    rows = talk(3, 24, deep=150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.prefix_trie(df, 300)) == brute(rows)


def test_odd_turns(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (1, 3, "", ""), (None, 1, "user", "lost"),
            (5, 0, "user", "y" * 70_000), (6, 0, "user", "z"), (6, 0, "user", "z"), (-3, 7, "a", "b"), (9_000_000_000, 1, "a", "b"),
            (7, 1, "1:user", "q"), (8, 1, "1", ":userq")] + [(10, 0, "user", "same")] * 6 + [(0, -1, "a", "b"), (0, 2, "a", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("d", "c", "conv", "depth", "h", "len", "part"):
        df = df.withColumn(c, F.lit("x"))
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)


def test_empty(spark):
    df = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert df.columns == FIELDS and df.count() == 0


def test_rollup_equals_plain_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        for shape in ("chain", "star", "random"):
            up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(max(0, i - 9), i))}[shape]
            parent = np.array([-1] + [up(i) for i in range(1, n)])
            level = np.zeros(n, np.int64)
            own = rng.integers(1, 9, n)
            value = rng.integers(-5, 1 << 40, n)
            weight, want = own.copy(), value.copy()
            for i in range(1, n):
                level[i] = level[parent[i]] + 1
            for i in range(n - 1, 0, -1):
                weight[parent[i]] += weight[i]
                want[parent[i]] += want[i]
            assert (prefix_trie.rollup(np.zeros(n, np.int64), level, parent, weight, [value])[0] == want).all()


def test_ids_of_a_node_over_many_partitions(spark, monkeypatch):
    rows = [(1, 0, c) for c in range(900)] + [(2, 5, 7)] + [(3, d, d) for d in range(40)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {(r["conv"], r["d"]): r["ends_sha256"] for r in prefix_trie.end_digests(spark.createDataFrame(rows, "conv long, d long, c long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert out == {(1, 0): sha(range(900)), (2, 5): sha([7])} | {(3, d): sha([d]) for d in range(40)}


def test_chunks_of_ids(monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    monkeypatch.setattr(prefix_trie.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 4})()))
    b = pa.RecordBatch.from_arrays([pa.array([1] * 7 + [2] * 8 + [3]), pa.array([0] * 16), pa.array(range(16))], names=["conv", "d", "c"])
    rows = [r for x in prefix_trie._join_ids([b.slice(0, 5), b.slice(5, 6), b.slice(11)]) for r in x.to_pylist()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv"]].append(r)
    assert [r["text"] for r in sorted(by[1], key=lambda r: r["seq"])] == ["0,1,2", "3,4", "5,6"]
    assert [r["sha"] for r in by[2]] == [hashlib.sha256(b"7,8,9,10,11,12,13,14").hexdigest()]
    assert [r["text"] for r in by[3]] == ["15"] and all(r["part"] == 4 for r in rows)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]
    want = brute(rows)
    assert got(REGISTRY["op11_prefix_trie"](spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({ORACLE['op11_prefix_trie']})").fetchall()
    assert sorted(sql, key=lambda r: r[:2]) == want
