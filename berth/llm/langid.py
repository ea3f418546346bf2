"""Hierarchical language identification (operator 6).

Character uni-, bi- and trigrams of the whole text, letters only and lower
case, are hashed into ``DIM`` square-rooted, length-normalised features. A
linear support vector machine per pair of language families picks the family;
one-versus-one linear machines among the languages of that family pick the
language. The models are fitted on a bounded, hash-chosen sample of labelled
rows (``fit_rows`` in all); every text is predicted from its text alone.

``und`` with score 0 for a null text or one without a letter, and for every
text when there is nothing to learn from. With one learned language that one
is predicted. A row with a null id counts as held out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.llm.common import prepare, slices

DIM = 2048
FIT_ROWS = 2000

# Languages by family; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and whether the text has a letter at all."""
    n = len(texts)
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in low])
    row = np.repeat(np.arange(n), size).astype(np.int64)
    ok = _letters()[code]
    c = np.where(ok, code, 0).astype(np.uint64)
    keep = np.ones(len(c), bool)  # runs of other characters count as one gap
    keep[1:] = ok[1:] | ok[:-1]
    c, row, ok = c[keep], row[keep], ok[keep]
    base = row * DIM
    out = np.zeros(n * DIM)
    with np.errstate(over="ignore"):
        for k, mult in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
            g = c.copy() if k == 1 else c[:len(c) - k + 1].copy()
            for j in range(1, k):
                g = g * np.uint64(0x100000001B3) + c[j:len(c) - k + 1 + j]
            m = len(g)
            same = ok[:m] if k == 1 else (row[:m] == row[k - 1:]) & ok[k // 2:k // 2 + m]
            slot = ((g * np.uint64(mult)) >> np.uint64(64 - 11)).astype(np.int64)
            out += np.bincount((base[:m] + slot)[same], minlength=n * DIM)
    x = np.sqrt(out.reshape(n, DIM))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    has = np.zeros(n, bool)
    has[np.unique(row[ok])] = True
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32), has


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 15) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by dual coordinate descent; y is +1 / -1."""
    w, b, a = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    d = np.einsum("ij,ij->i", x, x) + 1 + 1 / (2 * c)  # the bias is a constant feature
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w + b) - 1 + a[i] / (2 * c)
            new = max(a[i] - g / d[i], 0.0)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += step * x[i]
                b += step
                a[i] = new
    return w.astype(np.float32), float(b)


def family_of(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), lang)


def fit(x: np.ndarray, lang: np.ndarray) -> dict:
    """Pairwise machines between families, then between languages of one."""
    fams = defaultdict(list)
    for v in sorted(set(lang.tolist())):
        fams[family_of(v)].append(v)
    fam = np.array([family_of(v) for v in lang.tolist()])

    def pairs(labels: np.ndarray, names: list[str]) -> list:
        out = []
        for p, q in combinations(names, 2):
            use = (labels == p) | (labels == q)
            out.append((p, q, *fit_svm(x[use], np.where(labels[use] == p, 1.0, -1.0))))
        return out

    return {"families": dict(fams), "top": pairs(fam, sorted(fams)),
            "within": {f: pairs(lang, ls) for f, ls in fams.items()}}


def _vote(x: np.ndarray, names: list[str], machines: list) -> tuple[np.ndarray, np.ndarray]:
    """Most pairwise wins, then the larger sum of margins; the score is the
    least logistic margin of the winner."""
    at = {v: k for k, v in enumerate(names)}
    win, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    least = np.ones((len(x), len(names)))
    for p, q, w, b in machines:
        m = x @ w + b
        s = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        for k, v, z in ((at[p], m, s), (at[q], -m, 1 - s)):
            win[:, k] += v > 0 if k == at[p] else v >= 0
            total[:, k] += v
            least[:, k] = np.minimum(least[:, k], z)
    best = np.lexsort((np.broadcast_to(-np.arange(len(names)), win.shape), total, win), axis=1)[:, -1]
    return best, least[np.arange(len(x)), best]


def predict(x: np.ndarray, has: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    pred, score = np.full(len(x), "und", object), np.zeros(len(x))
    fams = sorted(model["families"])
    if not fams:
        return pred.tolist(), score
    f, fs = _vote(x, fams, model["top"])
    for k, name in enumerate(fams):
        at = np.flatnonzero(has & (f == k))
        if len(at):
            langs = model["families"][name]
            best, s = _vote(x[at], langs, model["within"][name])
            pred[at] = np.array(langs, object)[best]
            score[at] = fs[at] * s
    return pred.tolist(), score


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 1 << 19):
            x, has = features(b.column("text").to_pylist())
            at = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())],
                names=["lang", "x"])


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on about ``fit_rows`` rows in all, alike for each language, chosen
    by a hash of the id among rows with crc32(id) mod 5 <> 0."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null "
                      "and crc32(cast(doc_id as string)) % 5 <> 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {"families": {}, "top": [], "within": {}}
    each = max(1, fit_rows // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / v))) for k, v in sorted(counts.items())])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    got = (rows.where(draw < share).select("text", "lang")
           .mapInArrow(_feature_rows, "lang string, x binary").toArrow())
    if not got.num_rows:
        return {"families": {}, "top": [], "within": {}}
    lang = np.array(got.column("lang").to_pylist(), object)
    x = np.empty((got.num_rows, DIM), np.float32)
    for i, v in enumerate(got.column("x")):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    del got
    order = np.lexsort((x[:, 1], x[:, 0], x.sum(1), lang.astype(str)))  # not the order of tasks
    return fit(x[order], lang[order])


def _predict_rows(batches: Iterator[pa.RecordBatch], col: str, model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for whole in batches:
        for b in slices(whole, col, 1 << 19):
            pred, score = predict(*features(b.column(col).to_pylist()), m)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names replaced).
    The model is a few weight vectors of ``DIM`` floats per pair of labels."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(lambda it: _predict_rows(it, text, shared), f"{schema}, lang_pred string, score double")
