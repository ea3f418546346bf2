"""Operator 12 against the tokenizer itself."""

import collections
import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from berth.llm import packing
from berth.llm.queries import REGISTRY

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "<|startoftext|> a<|endoftext|>b <|ENDOFTEXT|> x", " \x1c x\x1fy z w é ́a  ΑΣ Σ ΑΣ. İ don't 'S ﬁ 你好 🙂\x0b\x0c q\x85r",
       "x" * 9000, "word, word. (word) wörd! 'tis it's 12 a1b2", "\n\t  ", "İstanbul ŉ ǅ ÿ ß Å", "a " * 9000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expect(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(pieces, texts, tokenizer, length):
    """Pieces hold every id once, windows are gapless and full but the last."""
    want = collections.Counter()
    for t in texts:
        want[tuple(expect(tokenizer, t))] += 1
    docs = {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
    windows = collections.defaultdict(list)
    for r in pieces:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["offset"] + r["length"] <= length
    for k, w in windows.items():
        at = 0
        for off, n in sorted(w):
            assert off == at
            at += n
        assert at == length or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    return docs


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces(spark, tokenizer, length):
    rng = random.Random(length)
    texts = ODD + [" ".join(rng.choice(["Alpha", "beta,", "Γάμμα", "don't", "été", "7x"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("length", F.lit(1)).withColumn("_ids", F.lit(2)).repartition(5)
    got = packing.pack(spark, df, PATH, length=length).collect()
    docs = check(got, texts, tokenizer, length)
    for i, t in enumerate(texts):
        ids, at = expect(tokenizer, t), 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)


def test_sequences(spark, tokenizer):
    texts = [f"eins zwei drei {i} " * (i % 17) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    stored = packing.tokenised(df, PATH)
    pieces = packing.pieces(stored, length=128).collect()
    want = collections.defaultdict(dict)
    for r in pieces:
        want[r["sequence_id"]][r["offset"]] = expect(tokenizer, texts[r["doc_id"]])[r["start"]:r["start"] + r["length"]]
    got = packing.sequences(stored, length=128, pad_id=-1).collect()
    assert len(got) == len(want)
    for r in got:
        ids = [i for _, x in sorted(want[r["sequence_id"]].items()) for i in x]
        n = len(ids)
        pad = 0 if n & (n - 1) == 0 else 128 - n
        assert list(r["ids"]) == ids + [-1] * pad and r["n_ids"] == n


def test_power_of_two_tail_is_not_padded(spark):
    df = spark.createDataFrame([(1, None)] * 4, "doc_id long, text string")
    got = packing.sequences(packing.tokenised(df, PATH)).collect()
    assert [list(r["ids"]) for r in got] == [[2, 2, 2, 2]]


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (None, None)], "doc_id long, text string")
    got = packing.pack(spark, df, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got) == [(0, 1), (0, 2), (1, 2), (1, 2)]
    none = packing.pack(spark, df.where("false"), PATH)
    assert none.count() == 0 and none.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_forgetting_changes_nothing(spark, monkeypatch, tokenizer):
    tok = packing.PartTokenizer(PATH)
    import pyarrow as pa
    texts = [f"w{i} x{i}y" for i in range(50)]
    monkeypatch.setattr(packing, "MAX_PARTS", 10)
    for t in texts:
        ids, _ = tok.encode(pa.array([t]), 2)
        assert ids.tolist() == expect(tokenizer, t)


def test_query_on_whole_table(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = REGISTRY["op12_packing"](spark, "/root/testdata/sf0.001").collect()
    by = check(got, docs.values(), tokenizer, 4096)
    assert set(by) == set(docs)
    assert all(by[d][0]["doc_tokens"] == len(expect(tokenizer, t)) for d, t in docs.items())
