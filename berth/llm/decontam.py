"""Benchmark decontamination by hashed word windows (operator 2).

A window is ``n`` consecutive words of a benchmark item (a shorter, not empty
item is one window). The windows' 64-bit hashes are broadcast in chunks of at
most ``max_windows``; each chunk is one pass over the documents' token
windows, hits are verified word by word, and a document's hits are carried
from pass to pass, so a larger benchmark costs more passes and never a larger
broadcast. No shuffle, one task never sees more than its own documents.

Defined results: null or wordless text has 0 words and is clean; an item
without words is ignored; a null item id is written as an empty string;
repeated documents and items each count by themselves (an id counts once);
other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.llm.common import gram_hash, prepare, slices, utf8, words

HITS = "array<struct<w:int,n:int,item:string>>"


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        low, s, e, row, h = words(*utf8(b.column(1)))
        raw = low.tobytes()
        out = {"h": [], "n": [], "body": [], "item": []}
        for r in range(b.num_rows):
            at = np.flatnonzero(row == r)
            if not len(at):
                continue
            size = min(n, len(at))
            grams = gram_hash(h[at], size)
            for j, g in enumerate(grams.view(np.int64).tolist()):
                out["h"].append(g)
                out["n"].append(size)
                out["body"].append(b" ".join(raw[s[k]:e[k]] for k in at[j:j + size]))
                out["item"].append(ids[r] or "")
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["h"], pa.int64()), pa.array(out["n"], pa.int32()),
             pa.array(out["body"], pa.binary()), pa.array(out["item"], pa.string())],
            names=["h", "n", "body", "item"])


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(h, n, body, item): the windows of every benchmark item."""
    src = benchmark.select(F.col("item_id").cast("string"), F.col("text"))
    return src.mapInArrow(lambda it: _windows(it, n), "h long, n int, body binary, item string")


def _lookup(chunk: list) -> dict:
    """length -> (sorted hashes, {hash: {body: items}})"""
    by: dict[int, dict] = {}
    for h, n, body, item in chunk:
        by.setdefault(n, {}).setdefault(h, {}).setdefault(bytes(body), set()).add(item)
    return {n: (np.sort(np.array(list(d), np.int64).view(np.uint64)), d) for n, d in by.items()}


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions of ``h`` that are in sorted ``known``; a small bit table is
    looked up first, as nearly all windows miss."""
    bits = max(10, int(np.ceil(np.log2(len(known) * 16 + 1))))
    table = np.zeros(1 << bits, bool)
    mask = np.uint64((1 << bits) - 1)
    table[known & mask] = True
    maybe = np.flatnonzero(table[h & mask])
    at = np.searchsorted(known, h[maybe])
    at[at == len(known)] = 0
    return maybe[known[at] == h[maybe]]


def _scan(batches: Iterator[pa.RecordBatch], col: str, first: bool, last: bool, lookup, want_text: bool):
    look = _lookup(lookup.value)
    for whole in batches:
        for b in slices(whole, col):
            low, s, e, row, h = words(*utf8(b.column(col)))
            raw = low.tobytes()
            n_rows = b.num_rows
            hits: list[list] = [[] for _ in range(n_rows)] if first else [
                [(x["w"], x["n"], x["item"]) for x in r or ()] for r in b.column("_hits").to_pylist()]
            base = np.searchsorted(row, np.arange(n_rows + 1))
            for n, (known, bodies) in look.items():
                g = gram_hash(h, n)
                for i in _is_in(g, known):
                    if row[i] != row[i + n - 1]:
                        continue
                    body = b" ".join(raw[s[k]:e[k]] for k in range(i, i + n))
                    for item in bodies[int(g[i:i + 1].view(np.int64)[0])].get(body, ()):
                        hits[row[i]].append((int(i - base[row[i]]), n, item))
            keep = [c for c in b.schema.names if c != "_hits"]
            arrays = [b.column(c) for c in keep]
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array([[{"w": w, "n": n, "item": i} for w, n, i in r] for r in hits],
                                       pa.list_(pa.struct([("w", pa.int32()), ("n", pa.int32()), ("item", pa.string())])))],
                    names=[*keep, "_hits"])
                continue
            out = {"n_words": np.diff(base), "n_hit": [], "n_items": [], "items_sha256": [], "spans": [], "clean": []}
            texts = b.column(col)
            off = utf8(texts)[1] if any(hits) else None
            for r, own in enumerate(hits):
                mark = np.zeros(base[r + 1] - base[r] + 1, np.int64)
                for w, n, _ in own:
                    mark[w] += 1
                    mark[w + n] -= 1
                hit = np.cumsum(mark[:-1]) > 0
                ids = sorted({i for _, _, i in own})
                out["n_hit"].append(int(hit.sum()))
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                spans, text = [], texts[r].as_py()
                if own:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    body, clean, done = text.encode(), [], 0
                    for a, z in zip(edge[::2], edge[1::2], strict=True):
                        p, q = int(s[base[r] + a] - off[r]), int(e[base[r] + z - 1] - off[r])
                        clean.append(body[done:p])
                        done = q
                        spans.append({"start": len(body[:p].decode()), "end": len(body[:q].decode())})
                    text = (b"".join([*clean, body[done:]])).decode()
                out["spans"].append(spans)
                out["clean"].append(text)
            cols = [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()),
                    pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string()),
                    pa.array([x > 0 for x in out["n_hit"]], pa.bool_()),
                    pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
            if want_text:
                cols.append(pa.array(out["clean"], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays([*arrays, *cols], names=[*keep, *names])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text",
                  want_text: bool = True, max_windows: int = 1_000_000) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated,
    hit_spans (code points, end exclusive) and, if wanted, clean_text (the hit
    words and what stands between them removed). Columns of ``docs`` with one
    of these names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", *(["clean_text"] if want_text else [])]
    cur = docs.drop(*added, "_hits")
    win = benchmark_windows(benchmark, n)
    total = win.count()
    chunks = max(1, -(-total // max_windows))
    for k in range(chunks):
        part = win.where(F.pmod(F.col("h"), F.lit(chunks)) == k) if chunks > 1 else win
        look = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])
        first, last = k == 0, k == chunks - 1
        base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cur.schema if f.name != "_hits")
        schema = f"{base}, _hits {HITS}" if not last else (
            f"{base}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
            "hit_spans array<struct<start:long,end:long>>" + (", clean_text string" if want_text else ""))
        cur = cur.mapInArrow(
            lambda it, a=first, z=last, lk=look: _scan(it, text, a, z, lk, want_text), schema)
    return cur
