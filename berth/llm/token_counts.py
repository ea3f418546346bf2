"""Token counts by dynamic programming shared over a trie (operator 8).

Pre-tokens are the white-space separated words of a text, each with the word
mark in front. A unigram model splits a pre-token into the pieces with the
highest sum of scores (of equal sums, the fewest pieces). The distinct
pre-tokens of a slice of documents, taken in sorted order, are a depth-first
walk of their trie: the forward scores of a prefix are computed once and kept
on the walk's stack for every pre-token below it; the count at a pre-token's
end is stored and looked up by the documents. Stored counts live as long as a
task and are dropped after ``MAX_TERMINALS``.

The vocabulary is that of a public SentencePiece file (path is a parameter,
nothing is trained). Its pieces are ranked, so a piece of rank r gets the
score -ln(r + 2), as word frequencies fall with rank. A character outside the
vocabulary costs one byte piece per UTF-8 byte.

Null and empty texts have 0 pre-tokens and 0 tokens; repeated rows each count;
long texts are read whole; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from berth.llm.common import prepare, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_TERMINALS = 300_000


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of the ordinary pieces of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class TrieCounter:
    """Piece counts of pre-tokens, one forward pass per distinct prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - 10.0
        by_end: dict[str, set[int]] = {}
        for p in scores:
            by_end.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(s) for c, s in by_end.items()}
        self.terminals: dict[str, int] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Walk the trie of the pre-tokens not known yet."""
        if len(self.terminals) > MAX_TERMINALS:
            self.terminals.clear()
        scores, lengths, byte, terminals = self.scores, self.lengths, self.byte, self.terminals
        best, count = [0.0], [0]  # forward score and pieces, by depth
        last = ""
        for word in sorted(pre_tokens - terminals.keys()):
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1:], count[depth + 1:]
            for j in range(depth + 1, len(word) + 1):
                c = word[j - 1]
                top, n = -math.inf, 0
                for k in lengths.get(c, ()):
                    if k > j:
                        break
                    s = scores.get(word[j - k:j])
                    if s is not None:
                        s += best[j - k]
                        if s > top or (s == top and count[j - k] + 1 < n):
                            top, n = s, count[j - k] + 1
                if c not in scores:  # bytes of an unknown character
                    size = len(c.encode("utf-8", "surrogatepass"))
                    s = best[j - 1] + size * byte
                    if s > top or (s == top and count[j - 1] + size < n):
                        top, n = s, count[j - 1] + size
                best.append(top)
                count.append(n)
            terminals[word] = count[-1]
            last = word

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        split = [[MARK + w for w in t.split()] if t else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        get = self.terminals.__getitem__
        return [len(ws) for ws in split], [sum(map(get, ws)) for ws in split]


def _count(batches: Iterator[pa.RecordBatch], col: str, vocabulary) -> Iterator[pa.RecordBatch]:
    counter = TrieCounter(vocabulary.value)
    for whole in batches:
        for b in slices(whole, col):
            pre, tok = counter.count(b.column(col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names if c != col), pa.array(pre, pa.int64()), pa.array(tok, pa.int64())],
                names=[*(c for c in b.schema.names if c != col), "n_pretokens", "n_tokens"])


def count_tokens(docs: DataFrame, scores: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_pretokens and n_tokens (columns of
    these names replaced). ``scores`` is broadcast: a vocabulary file."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.drop("n_pretokens", "n_tokens")
    shared = spark.sparkContext.broadcast(scores)
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != text)
    return src.mapInArrow(lambda it: _count(it, text, shared), f"{rest}n_pretokens long, n_tokens long")
