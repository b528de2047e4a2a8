"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text: statistics of its
characters, words and lines, and the frequencies of its words by hash.  It is
learned from preference pairs (a document marked good over one marked bad):
logistic loss on the pairs' feature differences.  Documents are then cut at a
quantile of the labelled scores: the share of labelled documents that are bad.
The logistic curve that carries raw scores to (0, 1) puts that cut at ``CUT``.

Features are computed for all documents of a batch in NumPy passes.  The fit
takes every labelled row and every pair of them (``tessera.llm.ranking``), and
the features' means and spreads and the cut are those of all labelled rows; a
document counts as often as it is labelled.  Every document is scored, over
its whole text, however long.  Null and empty texts have features (zeros) and
so a score; without labels of both kinds every score is the share of good
labels (1 if there are none).  Repeated rows get repeated scores, an empty
table none.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ranking
from tessera.llm import text as tx
from tessera.llm.runtime import discard, map_arrow, materialize
from tessera.plans.skew import join_unique

#: Where the quantile cut lies in (0, 1).
CUT = 0.3

_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_STOP = np.frombuffer(b".,;:'\"-()", np.uint8)
_SYMBOL = np.setdiff1d(np.r_[33:48, 58:65, 91:97, 123:127], _STOP)
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[np.r_[_UPPER, _LOWER, 128:256]] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[_UPPER] = True

STATISTICS = "length word_bytes upper digits symbols top_symbol stops distinct richness repeats trigrams lines distinct_lines letters lower".split()
#: Buckets that words are hashed to.
BUCKETS = 32
FEATURES = [*STATISTICS, *(f"words_{i}" for i in range(BUCKETS))]
#: Documents that one pass works on: each takes a row of 256 byte counts.
ROWS = 1024
#: Labelled rows up to this number are learned from in the driver (8 MB), the same way.
DRIVER_ROWS = 20_000


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has; owners ascend."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off)
    starts, ends, first = tx.word_spans(data, off)
    k = np.diff(first)
    owner = np.repeat(np.arange(n), k)
    counts = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256)
    words = tx.RangeHash(data)(starts, ends)
    total = np.maximum(1, k)
    letters = counts[:, _IS_LETTER].sum(1)
    symbols = counts[:, _SYMBOL]
    distinct = _distinct(owner, words, n)
    pair = owner[1:] == owner[:-1]
    repeats = np.bincount(owner[1:][pair & (words[1:] == words[:-1])], minlength=n)
    three = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    runs = _distinct(owner[three], tx.combine([words[three], words[three + 1], words[three + 2]]), n) if len(three) else np.zeros(n, np.int64)
    begins, stops, lines_first = tx.line_spans(data, off)
    line_owner = np.repeat(np.arange(n), np.diff(lines_first))
    filled = stops > begins
    lines = np.bincount(line_owner[filled], minlength=n)
    own_lines = _distinct(line_owner[filled], tx.RangeHash(data)(begins[filled], stops[filled]), n)
    upto = lambda flag: np.concatenate([[0], np.cumsum(flag[data])])
    upper, letter = upto(_IS_UPPER), upto(_IS_LETTER)
    lower = np.bincount(owner[(upper[ends] == upper[starts]) & (letter[ends] > letter[starts])], minlength=n)
    bytes_ = np.maximum(1, size)
    out = np.empty((n, len(FEATURES)))
    out[:, : len(STATISTICS)] = np.column_stack([
        np.log1p(k),
        np.log(bytes_ / total),
        counts[:, _UPPER].sum(1) / np.maximum(1, letters),
        counts[:, _DIGIT].sum(1) / bytes_,
        symbols.sum(1) / total,
        symbols.max(1, initial=0) / total,
        counts[:, _STOP].sum(1) / total,
        distinct / total,
        np.log(np.maximum(1, distinct)) / np.log1p(total),
        repeats / total,
        np.where(k > 2, runs / np.maximum(1, k - 2), 1.0),
        lines / total,
        own_lines / np.maximum(1, lines),
        letters / bytes_,
        lower / total,
    ])
    folded = tx.RangeHash(data, fold=True)(starts, ends) % tx.U64(BUCKETS)
    hashed = np.bincount(owner * BUCKETS + folded.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, len(STATISTICS) :] = np.sqrt(hashed / total[:, None])
    out[k == 0] = 0.0
    return out


def features(column: pa.Array) -> np.ndarray:
    """(documents, features) of a column of whole texts."""
    data, off = tx.flat(column)
    out = [np.zeros((0, len(FEATURES)))]
    for i, j in tx.pieces(off):
        for a in range(i, j, ROWS):
            z = min(j, a + ROWS)
            out.append(_features(data[off[a] : off[z]], off[a : z + 1] - off[a]))
    return np.vstack(out)


@dataclass(frozen=True)
class Fit:
    shrink: float = 1e-4
    shrink_words: float = 1e-2  #: the same for words by hash
    steps: int = 50  #: Newton steps at most; ``close`` ends them long before
    close: float = 1e-7  #: a step that promises less of the loss is the last


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    share_good: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.share_good)
        z = (self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, and of the statistics their squares and whether they are far out."""
    z = np.clip(z, -6, 6)
    s = z[:, : len(STATISTICS)]
    return np.hstack([z, s * s / 4, np.tanh(2 * s)])


def fit_rows(rows: list[ranking.Block] | DataFrame, fit: Fit) -> Ranker:
    """Learn from all preference pairs of the rows (blocks of features, times marked good and bad)."""
    good, bad, mean, variance = ranking.moments(rows) or (0.0, 0.0, np.zeros(1), np.ones(1))
    share = float(good / (good + bad)) if good + bad else 1.0
    if not good or not bad:
        return Ranker(np.zeros(1), np.ones(1), np.zeros(0), 0.0, 1.0, share)
    scale = np.maximum(np.sqrt(variance), 1e-6)
    z = lambda x: expand((x - mean) / scale)
    shrink = np.full(len(FEATURES) + 2 * len(STATISTICS), fit.shrink)
    shrink[len(STATISTICS) : len(FEATURES)] = fit.shrink_words
    w = ranking.learn(rows, z, shrink, fit.steps, fit.close)
    raw = lambda x: z(x) @ w
    spread = np.sqrt(ranking.moments(rows, raw)[3])
    # between the two neighbours of the quantile, so that a tie doesn't decide
    at = int(min(good + bad - 1, max(1, bad)))
    cut = sum(ranking.order_statistics(rows, raw, [at - 1, at])) / 2
    return Ranker(mean, scale, w, float(cut), float(max(spread / 4, 1e-6)), share)


def fit_pairs(x: np.ndarray, good: np.ndarray, fit: Fit) -> Ranker:
    """Learn from the rows' preference pairs."""
    return fit_rows([(x, good.astype(float), (~good).astype(float))] if len(x) else [], fit)


def text_features(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """(id, features array<double>, the other columns)."""

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))), *batch.columns[2:]], names)

    kept = docs.select(id_col, text_col, *others)
    names = [id_col, "features", *others]
    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others]
    return map_arrow(kept, run, ", ".join([f"`{id_col}` {kept.schema[0].dataType.simpleString()}", "features array<double>", *kinds]))


def fit_features(known: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit = Fit(), id_col: str = "doc_id", label_col: str = "quality") -> Ranker:
    """Learn from ``labels`` (id, label 0 or 1), of the rows where ``may_learn`` holds; null labels are no labels.  ``known``: a written table of (id, features)."""
    marked = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(may_learn & F.col("label").isNotNull())
    good = F.col("label") == 1
    votes = marked.groupBy(id_col).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    rows = materialize(ranking.pack(join_unique(known, votes, id_col).select("features", "good", "bad")), "quality-labelled")
    if (rows.agg(F.sum("n")).first()[0] or 0) > DRIVER_ROWS:
        ranker = fit_rows(rows, fit)
    else:
        ranker = fit_rows([ranking.block(**r.asDict()) for r in rows.collect()], fit)
    discard(rows)
    return ranker


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """``fit_features`` of the documents' texts."""
    known = materialize(text_features(docs, id_col, text_col), "quality-features")
    ranker = fit_features(known, labels, may_learn, fit, id_col, label_col)
    discard(known)
    return ranker


def _scored(kept: DataFrame, ranker: Ranker, matrix) -> DataFrame:
    def run(batches):
        for batch in batches:
            s = ranker.score(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32)), *batch.columns[2:]], names)

    id_col, _, *others = kept.columns
    names = [id_col, "score", "predicted", *others]
    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others]
    return map_arrow(kept, run, ", ".join([f"`{id_col}` {kept.schema[0].dataType.simpleString()}", "score double", "predicted int", *kinds]))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """(id, score, predicted, the other columns): score in (0, 1), predicted 1 from CUT on."""
    return _scored(docs.select(id_col, text_col, *others), ranker, features)


def score_features(known: DataFrame, ranker: Ranker, id_col: str = "doc_id") -> DataFrame:
    """``score`` from a table of (id, features)."""
    return _scored(known.select(id_col, "features"), ranker, ranking.stacked)


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The documents (all columns) with a score of CUT or more."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            s = ranker.score(features(batch.column(at)))
            yield batch.filter(pa.array(s >= CUT))

    return map_arrow(docs, run, docs.schema)
