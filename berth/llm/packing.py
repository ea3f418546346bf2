"""Concatenate and cut: sequences of a fixed length over a corpus (operator 12).

All documents, in stored order, are one stream of token ids, each document
ending with an end id; sequence k is the stream's window [k * length, (k + 1)
* length). Nothing is padded but the last window of the whole corpus.

First pass: every task tokenises its documents and stores their ids, each with
its place in the task's own stream. The totals of the tasks (one number each)
are summed into the global offset of every task. Second pass: each task cuts
its documents at the windows' edges, which it now knows, without a shuffle. A
window that lies in more than one task is put together from its boundary
records (at most ``length`` ids); every other window is complete in its task.

Tokenising: the tokenizer drops white space and never joins across it, so the
ids of a text are those of its parts between ASCII white space; a part's ids
are looked up once and kept until ``MAX_PARTS`` are known, then learnt anew.

Defined results: a null or empty text is its end id alone; repeated rows and
rows with a null id are documents of their own; long texts are read whole and
cut as often as needed; only the named id columns of the input are kept, so
further columns, also of the same names as results, play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.llm.common import _LOWER, prepare, slices, utf8
from berth.session import shared_dir

LENGTH = 4096
END_ID = 2
MAX_PARTS = 1_000_000
SLICE = 1 << 23
PLAIN = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FE]+([.,;:!?]*)")  # a word, and a mark's run


class PartTokenizer:
    """Ids of many texts by one look-up per distinct part."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        mark = made["model"].get("end_of_word_suffix")
        self.lowers = '"Lowercase"' in json.dumps(made.get("normalizer"))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a word
        self.closes[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        self.joins = bool(mark)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.edge = np.zeros(1 << 12, np.int64)  # ids of part k: edge[k] to edge[k + 1]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, parts: list[str]) -> None:
        if self.joins and (plain := [m for m in map(PLAIN.fullmatch, parts) if m]):
            # many at a time: one closing id for the word and one for its marks
            words = [m[0] for m in plain]
            texts = [" ".join(words[i:i + 256]) for i in range(0, len(words), 256)]
            ids = np.fromiter((i for x in self._encode(texts) for i in x), np.uint32)
            closed = np.flatnonzero(self.closes[ids])
            last = np.cumsum([1 + bool(m[1]) for m in plain]) - 1
            if last[-1] != len(closed) - 1:
                raise RuntimeError("the tokenizer cuts words of letters")
            self._keep(words, ids, np.diff(closed[last], prepend=-1))
        if rest := [w for w in parts if w not in self.code]:
            got = self._encode(rest)
            size = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(rest, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size)

    def _keep(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.code)
        end = self.edge[first] + np.cumsum(size)
        while len(self.ids) < end[-1]:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.edge) < first + len(parts) + 1:
            self.edge = np.concatenate((self.edge, np.zeros_like(self.edge)))
        self.ids[self.edge[first]:end[-1]] = ids
        self.edge[first + 1:first + 1 + len(parts)] = end
        self.code.update(zip(parts, range(first, first + len(parts)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``end_id``, and the
        texts' offsets in them."""
        raw, edge = utf8(texts)
        if self.lowers and b"<|" not in raw.tobytes():  # fewer distinct parts; not where a special token may stand
            raw = _LOWER[raw]
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(edge), pa.py_buffer(raw)])
        split = pc.ascii_split_whitespace(texts)
        n_docs = len(split)
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.code) > MAX_PARTS:
            self.forget()
        if new := [w for w in names if w not in self.code]:
            self._add(new)
        code = np.fromiter(map(self.code.__getitem__, names), np.int64, len(names))[
            words.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
        size = self.edge[code + 1] - self.edge[code]
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n_words)]  # ids up to each text's end
        off = np.concatenate(([0], upto + np.arange(1, n_docs + 1)))
        out = np.full(off[-1], end_id, np.uint32)
        total = int(size.sum())
        before = np.cumsum(size) - size
        at = np.arange(total) + np.repeat(self.edge[code] - before, size)
        inside = np.ones(off[-1], bool)
        inside[off[1:] - 1] = False
        out[inside] = self.ids[at]
        return out, off


_LOADED: dict[str, PartTokenizer] = {}


def _tokenise(batches: Iterator[pa.RecordBatch], keys: list[str], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids and place of every document in the task's stream."""
    tok = _LOADED.get(path) or _LOADED.setdefault(path, PartTokenizer(path))
    task, first = TaskContext.get().partitionId(), 0
    for whole in batches:
        for b in slices(whole, "_text", SLICE):
            ids, off = tok.encode(b.column("_text"), end_id)
            n = b.num_rows
            blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keys), pa.array(np.full(n, task), pa.int32()), pa.array(first + off[:-1], pa.int64()),
                 pa.array(np.diff(off), pa.int64()), blob.cast(pa.binary())],
                names=[*keys, "_task", "_first", "_n", "_ids"])
            first += int(off[-1])


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """First pass: (keys, _task, _first, _n, _ids), stored in the shared
    folder, so that the places hold whatever runs again later."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(*[F.col(k) for k in keys], F.col(text).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "_text")
    at = shared_dir(spark, "packing")
    src.mapInArrow(lambda it: _tokenise(it, list(keys), path, end_id), f"{fields}_task int, _first long, _n long, _ids binary"
                   ).write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def task_offsets(stored: DataFrame) -> dict[int, int]:
    """Global place of each task's stream: one number a task."""
    total = {r["_task"]: r["n"] for r in stored.groupBy("_task").agg(F.sum("_n").alias("n")).collect()}
    out, place = {}, 0
    for task in sorted(total):
        out[task], place = place, place + total[task]
    return out


def _cut(b: pa.RecordBatch, offsets: dict[int, int], length: int):
    """Pieces of a batch's documents: row, start in the document, size,
    place in the whole stream."""
    n = b.column("_n").to_numpy()
    place = b.column("_first").to_numpy() + np.fromiter((offsets[t] for t in b.column("_task").to_pylist()), np.int64, b.num_rows)
    count = (place + n - 1) // length - place // length + 1
    row = np.repeat(np.arange(b.num_rows), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.maximum(place[row], (place[row] // length + k) * length)
    hi = np.minimum(place[row] + n[row], (place[row] // length + k + 1) * length)
    return row, lo - place[row], hi - lo, lo


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str], offsets, length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, start, size, place = _cut(b, offsets.value, length)
        blobs = [memoryview(x) for x in b.column("_ids").to_pylist()]
        crc = [zlib.crc32(blobs[r][4 * s:4 * (s + z)]) for r, s, z in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(take) for c in keys), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
             b.column("_n").take(take), pa.array(place // length), pa.array(place % length)],
            names=[*keys, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pieces(stored: DataFrame, keys: Sequence[str] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """Second pass: one row per piece, with the CRC-32 of its ids."""
    offsets = stored.sparkSession.sparkContext.broadcast(task_offsets(stored))
    fields = "".join(f"`{k}` {stored.schema[k].dataType.simpleString()}, " for k in keys)
    return stored.mapInArrow(
        lambda it: _pieces(it, list(keys), offsets, length),
        f"{fields}start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _windows(batches: Iterator[pa.RecordBatch], offsets, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of ids inside one window, joined as far as a batch reaches."""
    for b in batches:
        row, start, size, place = _cut(b, offsets.value, length)
        blobs = b.column("_ids").to_pylist()
        part = [np.frombuffer(blobs[r], "<u4", z, 4 * s) for r, s, z in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
        # a run ends where the window ends or the next piece is not its neighbour
        new = np.ones(len(row), bool)
        new[1:] = (place[1:] != place[:-1] + size[:-1]) | (place[1:] % length == 0)
        edge = [*np.flatnonzero(new), len(row)]
        ids = [np.concatenate(part[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        head = place[new]
        yield pa.RecordBatch.from_arrays(
            [pa.array(head // length), pa.array(head % length), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))],
            names=["sequence_id", "offset", "ids"])


def sequences(stored: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids): the sequences themselves, padded to
    ``length`` unless their size is a power of two. Only boundary records, of
    windows that no batch holds whole, are shuffled."""
    offsets = stored.sparkSession.sparkContext.broadcast(task_offsets(stored))
    runs = stored.mapInArrow(lambda it: _windows(it, offsets, length), "sequence_id long, offset long, ids array<bigint>")
    whole = runs.where(F.size("ids") == length).select("sequence_id", "ids")
    boundary = (runs.where(F.size("ids") < length).groupBy("sequence_id")
                .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("r"))
                .select("sequence_id", F.flatten(F.col("r.ids")).alias("ids")))
    n = F.size("ids")
    pad = F.when((n == length) | (n.bitwiseAND(n - 1) == 0), 0).otherwise(F.lit(length) - n)
    return whole.union(boundary).select(
        "sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("ids"), n.cast("long").alias("n_ids"))


def pack(spark: SparkSession, docs: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text",
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: keys, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    return pieces(tokenised(docs, path, end_id, keys, text), keys, length)
