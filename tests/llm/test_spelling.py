"""Operator 13 against brute force."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from berth.llm import spelling
from berth.llm.queries import REGISTRY


def brute(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in count:
        for i in range(len(w)):
            gone = w[:i] + w[i + 1:]
            holes[i, gone].add(w)
            if gone in count:
                near[w].add(gone)
                near[gone].add(w)
    for group in holes.values():
        for a, b in itertools.combinations(group, 2):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in count:
        if near[w]:
            f = min(near[w], key=lambda x: (-count[x], x))
            if count[f] >= 10 * count[w]:
                form[w] = f

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), count[form[w]] if w in form else -1) for w, n in count.items())


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def planted(seed):
    """Common words, their variants of the first and second order, and
    anagrams."""
    rng = random.Random(seed)
    letters = "abcdeghinorstuÀéßÿ×"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(25)]
    words = []
    for b in bases:
        words += [b] * 220
        for _ in range(12):
            v = list(b)
            i = rng.randrange(len(v))
            kind = rng.randrange(4)
            if kind == 0:
                v[i] = rng.choice(letters)
            elif kind == 1:
                v.insert(i, rng.choice(letters))
            elif kind == 2:
                del v[i]
            else:
                rng.shuffle(v)
            words += ["".join(v)] * rng.choice([2, 15, 22])
            v[rng.randrange(len(v))] = rng.choice(letters)
            words += ["".join(v)] * 2
    rng.shuffle(words)
    return [(i, rng.choice([" ", "\n", ", ", "-", "1"]).join(words[k:k + 40])) for i, k in enumerate(range(0, len(words), 40))]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_planted_variants(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "VISITORS", chunk)
    rows = planted(chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert sum(w[1] != "" for w in want) > 30 and any(w[1] not in ("", w[2]) for w in want)
    assert got(spelling.variants(df)) == want


def test_shared_keys_are_drawn_anew(spark, monkeypatch):
    real = spelling._key
    monkeypatch.setattr(spelling, "_key", lambda sig, seed: F.pmod(real(sig, seed), F.lit(3)) if seed == 0 else real(sig, seed))
    rows = planted(5)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(df)) == brute(rows)


def test_odd_texts(spark):
    long = "wortspiel" * 700
    rows = [(1, None), (2, ""), (None, "Buchstabe buchstabe BUCHSTABE"), (3, f"{long} {long} {long[:-1]}x {long[:-1]}x"), (4, "kurz kurz"),
            (5, "ÉCOUTER Écouter écouter écoute écoute"), (5, "ÉCOUTER Écouter écouter écoute écoute"), (6, "日本語abcdefgh日本語abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "form", "root", "sig", "key"):
        df = df.withColumn(c, F.lit("x"))
    assert got(spelling.variants(df)) == brute(rows)


def test_empty(spark):
    df = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(REGISTRY["op13_spelling"](spark, sf)) == brute(rows)
