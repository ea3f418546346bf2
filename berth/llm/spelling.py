"""Spelling variants by blocked Gram matrices (operator 13).

Words are the runs of letters of all texts. Two words one edit apart have
letter counts at a squared distance of one (inserted or deleted letter) or two
(replaced letter). Those distances come from NumPy products of blocks of
letter-count vectors; pairs at a distance of at most two in blocks of the same
or the next length are verified letter by letter.

Blocks: the alphabet is cut into k sets of like frequency (k grows with the
logarithm of the vocabulary), and a block holds the words of one length and one
count per set. An edit moves a word to a known neighbour: one set up by one
and the length by one, or one set down and another up. So a block is compared
with itself and at most k(k + 1) / 2 others. Words travel to the blocks that
they are compared with (only to such as exist), where the block's own words
wait in chunks of at most about ``CHUNK`` words; visitors stream past them.
Every pair of blocks meets once, so no pair is met twice; a task keeps counts
and best partners, not pairs.

Defined results: null and empty texts have no words; a null id reads as the
empty string before the colon; repeated rows count as often as they occur; of
equal n the word first in code-point order is the form; long texts and words
are used whole; an empty table gives an empty result; other columns of the
input, also of the results' names, play no part.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import cut, prepare, slices, utf8

MIN_LETTERS, MIN_COUNT, DROP_EVERY, RATIO = 7, 2, 31, 10
CHUNK = 2048  # words of a block's chunk
CHUNK_BYTES = 1 << 20
VISITORS = 2048  # visitors compared at a time
FLUSH = 200_000  # distinct words that a task counts before it passes them on

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _runs(raw: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of every maximal run of a-z
    and U+00C0 to U+00FF (in UTF-8: 0xC3 and its follower) of ``least`` code
    points or more."""
    low = _SMALL[raw]
    lead = low == 0xC3
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(letter & (~np.concatenate(([False], letter[:-1])) | edge[:-1]))
    end = np.flatnonzero(letter & (~np.concatenate((letter[1:], [False])) | edge[1:])) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    keep = end - start - (leads[end] - leads[start]) >= least
    start, end = start[keep], end[keep]
    return low, start, end, np.searchsorted(off, start, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with their counts."""
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    crc32 = zlib.crc32
    for whole in batches:
        for b in slices(whole, "text"):
            low, start, end, row = _runs(*utf8(b.column("text")), MIN_LETTERS)
            if not len(start):
                continue
            seed = [crc32(f"{'' if d is None else d}:".encode()) for d in b.column("doc_id").to_pylist()]
            data = low.tobytes()
            words = []
            for s, e, r in zip(start.tolist(), end.tolist(), row.tolist(), strict=True):
                w = data[s:e]
                h = crc32(w, seed[r])
                w = w.decode()
                if h % DROP_EVERY == 0:
                    k = h % len(w)
                    w = w[:k] + w[k + 1:]
                    if len(w) < MIN_LETTERS:
                        continue
                words.append(w)
            counts.update(words)
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur at least ``MIN_COUNT`` times."""
    found = docs.select("doc_id", "text").where(F.length("text") >= MIN_LETTERS).mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def letter_sets(words: DataFrame, k: int) -> list[str]:
    """The letters of all words in ``k`` sets of like total frequency. The
    alphabet has at most 90 letters."""
    freq = (words.select(F.explode(F.split("word", "")).alias("c"), "word").where("c <> ''")
            .groupBy("c").count().orderBy(F.desc("count"), "c").collect())
    sets, load = [""] * k, [0] * k
    for r in freq:
        i = load.index(min(load))
        sets[i] += r["c"]
        load[i] += r["count"]
    return sets


def _neighbours(sig: Column, k: int) -> Column:
    """Blocks that a block's words visit besides their own."""
    def moved(size: int, up: int, down: int | None = None) -> Column:
        step = {0: size, up + 1: 1}
        if down is not None:
            step[down + 1] = -1
        return F.array(*[F.get(sig, i) + step.get(i, 0) for i in range(k + 1)])

    return F.array(*[moved(1, i) for i in range(k)], *[moved(0, j, i) for i in range(k) for j in range(i + 1, k)])


def _key(sig: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), sig)


def _routes(words: DataFrame, k: int) -> DataFrame:
    """(sig, own, visits): for every block its number of chunks and the
    (key, chunks) of the blocks that its words visit."""
    size = F.length("word").cast("long")
    found = cut(words.groupBy("sig").agg(F.count("*").alias("c"), F.sum(size).alias("b")).select(
        "sig", F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("b") / CHUNK_BYTES)).cast("int").alias("chunks")))
    for seed in itertools.count():  # keys must differ; two of 64 bits hardly ever agree
        blocks = found.select("sig", _key(F.col("sig"), seed).alias("key"), "chunks")
        if blocks.groupBy("key").count().where("count > 1").limit(1).count() == 0:
            break
    out = blocks.select("sig", "key", "chunks", F.explode(_neighbours(F.col("sig"), k)).alias("to"))
    there = blocks.select(F.col("sig").alias("to"), F.struct("key", "chunks").alias("t"))
    met = out.join(there, "to").groupBy("sig").agg(F.collect_list("t").alias("visits"))
    return blocks.join(met, "sig", "left").select("sig", "key", F.col("chunks").alias("own"), "visits")


def _dealt(words: DataFrame, k: int) -> DataFrame:
    """(key, chunk, kind, word, n): every word at home (kind 0), as a visitor
    of its own block's chunks (1) and of its neighbours' (2)."""
    each = words.join(_routes(words, k), "sig")
    own = F.struct("key", F.pmod(F.xxhash64("word"), F.col("own")).cast("int").alias("chunk"), F.lit(0).cast("byte").alias("kind"))

    def chunks(key: Column, n: Column, kind: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(key.alias("key"), c.alias("chunk"), kind.alias("kind")))

    visits = F.flatten(F.transform("visits", lambda t: chunks(t["key"], t["chunks"], F.lit(2).cast("byte"))))
    to = F.concat(F.array(own), chunks(F.col("key"), F.col("own"), F.lit(1).cast("byte")), F.coalesce(visits, F.array()))
    return each.select(F.explode(to).alias("t"), "word", "n").select("t.*", "word", "n")


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters (one byte each, 0 behind the end) and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return out, size


def _letters(codes: np.ndarray, used: np.ndarray, real: type) -> np.ndarray:
    """Counts of the ``used`` letters, one row a word."""
    n, width = codes.shape
    place = np.zeros(256, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    col = place[codes] + np.arange(n)[:, None] * (len(used) + 1)
    return np.bincount(col.ravel(), minlength=n * (len(used) + 1)).reshape(n, -1)[:, 1:].astype(real)


def _one_edit(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether a is b with one letter replaced (same length) or inserted."""
    diff = a != b
    same = a_size == b_size
    out = same & (diff.sum(axis=1) == 1)
    longer = np.flatnonzero(a_size == b_size + 1)
    if len(longer):
        first = diff[longer].argmax(axis=1)
        behind = np.arange(a.shape[1] - 1) >= first[:, None]
        out[longer] = ~((a[longer, 1:] != b[longer, :-1]) & behind).any(axis=1)
    return out


class _Chunk:
    """The words at home in a chunk, their counts of near words and the best
    of those."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.width = max(map(len, words)) + 1
        self.codes, self.size = _codes(words, self.width)
        self.used = np.unique(self.codes)
        self.used = self.used[self.used > 0]
        self.real = np.float32 if self.width < 2000 else np.float64  # squares stay exact
        self.gram = _letters(self.codes, self.used, self.real)
        self.norm = (self.gram * self.gram).sum(axis=1)
        self.near = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def meet(self, words: list[str], n: list[int], own: bool) -> tuple[list, list, list, list]:
        """Compare visitors with the chunk; (word, near, best n, best word) of
        those that have a near word here."""
        codes, size = _codes(words, self.width)
        seen = _letters(codes, self.used, self.real)
        # letters that no word here has count by themselves
        strange = np.zeros(256, bool)
        strange[self.used] = True
        rest = np.where(strange[codes] | (codes == 0), 0, codes)
        norm = (seen * seen).sum(axis=1)
        if rest.any():
            extra = np.unique(rest)[1:]
            more = _letters(rest, extra, self.real)
            norm += (more * more).sum(axis=1)
        gap = self.gram @ seen.T
        gap *= -2
        gap += self.norm[:, None]
        gap += norm[None, :]
        i, j = np.nonzero((gap > 0.5) & (gap < 2.5))
        edits = []
        for s in range(0, len(i), 1 << 16):
            x, y = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            edits.append(_one_edit(self.codes[x], self.size[x], codes[y], size[y]))
        ok = np.concatenate(edits) if edits else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if own and len(i):  # each pair of the block once
            first = np.fromiter((self.words[x] < words[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = i[first], j[first]
        if not len(i):
            return [], [], [], []
        np.add.at(self.near, i, 1)
        back: dict[int, list] = {}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            b = (-n[y], words[y])
            if x not in self.best or b < self.best[x]:
                self.best[x] = b
            h = (-self.n[x], self.words[x])
            if (v := back.get(y)) is None:
                back[y] = [1, h]
            else:
                v[0] += 1
                if h < v[1]:
                    v[1] = h
        return [words[y] for y in back], [v[0] for v in back.values()], [-v[1][0] for v in back.values()], [v[1][1] for v in back.values()]

    def report(self) -> tuple[list, list, list, list]:
        at = sorted(self.best)
        return ([self.words[x] for x in at], [int(self.near[x]) for x in at],
                [-self.best[x][0] for x in at], [self.best[x][1] for x in at])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, chunk, kind): near words of homes and visitors."""
    def made(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(r, pa.int64()) for r in rows[1:3]), pa.array(rows[3], pa.string())],
                                          names=["word", "near", "best_n", "best"])

    at, homes, counts, chunk = None, [], [], None
    for b in batches:
        key, sub, kind = (b.column(c).to_numpy() for c in ("key", "chunk", "kind"))
        new = np.ones(b.num_rows, bool)
        new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (kind[1:] != kind[:-1])
        edge = [*np.flatnonzero(new).tolist(), b.num_rows]
        words, n = b.column("word").to_pylist(), b.column("n").to_pylist()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if at != (int(key[s]), int(sub[s])):
                if chunk:
                    yield made(chunk.report())
                at, homes, counts, chunk = (int(key[s]), int(sub[s])), [], [], None
            if kind[s] == 0:
                homes += words[s:e]
                counts += n[s:e]
                continue
            if not homes:  # no word fell to this chunk
                continue
            chunk = chunk or _Chunk(homes, counts)
            step = max(1, min(VISITORS, (1 << 23) // chunk.width))
            for p in range(s, e, step):
                got = chunk.meet(words[p:min(p + step, e)], n[p:min(p + step, e)], kind[s] == 1)
                if got[0]:
                    yield made(got)
    if chunk:
        yield made(chunk.report())


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)`` with n_near and the best near word and its n. The
    words must be distinct."""
    vocabulary = words.count()
    k = max(3, round(math.log2(max(vocabulary, 1)) / 3))
    sets = letter_sets(words, k)
    size = F.length("word")
    each = words.withColumn("sig", F.array(size, *[
        size - F.length(F.translate("word", s, "")) if s else F.lit(0) for s in sets]))
    found = (_dealt(each, k).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind")
             .mapInArrow(_compare, "word string, near long, best_n long, best string"))
    none = F.lit(None)
    return (words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("long").alias("best_n"), none.cast("string").alias("best"))
            .unionByName(found.withColumn("n", none.cast("long")))
            .groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"),
                                 F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("b"))
            .select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) by doubling the followed paths. A form's
    n is ten times its word's or more, so no path has more than 18 steps."""
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = ahead.select(F.col("word").alias("root"), F.col("root").alias("r"))
        step = cut(ahead.join(nxt, "root", "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        ahead = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return ahead


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs(doc_id,
    text)``."""
    prepare(docs.sparkSession)
    near = cut(near_words(cut(word_counts(docs))))
    good = F.col("best_n") >= RATIO * F.col("n")
    out = near.select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n"))
    return out.join(_roots(out.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
