"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else of the training
folds is unlabelled, toxic documents among it.  With class prior pi the risk

    pi * R+(positives)  +  max(0, R-(unlabelled) - pi * R-(positives))

is minimised by gradient descent; where the second term falls below zero the
step goes the other way, which keeps the estimate from overfitting below it.

Features are the presence, anywhere in the text, of hashed words, word starts
and word ends.  Those that differ most between positives and unlabelled text
are kept (``Fit.kept``).  The samples of the fit are bounded parameters; every
document is scored over its whole text.  Null and empty texts get the score of
a text with no feature; without a positive every score is the prior (0).
Repeated rows get repeated scores.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.merging import IntMap
from tessera.llm.runtime import bounded_sample, map_arrow, materialize

#: From this score on a document is predicted toxic.
CUT = 0.3

#: Of a feature's hash; a false hit on one of a model's features is then a matter of one document in a thousand.
BITS = 31
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[np.r_[48:58, 65:91, 97:123, 128:256]] = True


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every feature of the documents: for each run of letters and digits the run, its first 4 to 6 and its last 5 bytes."""
    other = np.where(_ASCII_LETTERS[data], np.uint8(97), np.uint8(32))
    starts, ends, first = tx.word_spans(other, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashed = tx.RangeHash(data, fold=True)
    size = ends - starts
    out = [hashed(starts, ends)]
    for n in (4, 5, 6):
        out.append(np.where(size > n, hashed(starts, np.minimum(ends, starts + n)) + tx.U64(n), out[0]))
    out.append(np.where(size > 5, hashed(np.maximum(starts, ends - 5), ends) + tx.U64(99), out[0]))
    return np.concatenate(out) >> tx.U64(64 - BITS), np.tile(doc, len(out))


@dataclass(frozen=True)
class Fit:
    max_positive: int = 2500  #: positives that the fit sees at most, about
    max_unlabelled: int = 5000  #: unlabelled documents, about
    kept: int = 600
    lift: float = 4.0  #: how many times as frequent among positives a feature must be
    rounds: int = 400
    rate: float = 0.05
    shrink: float = 3e-3


@dataclass(frozen=True)
class Model:
    index: np.ndarray  #: features, ascending
    weights: np.ndarray
    bias: float
    prior: float


def _presence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(positive, terms): the distinct features of each sampled document."""

    def run(batches):
        for batch in batches:
            data, off = tx.flat(batch.column(1))
            for i, j in tx.pieces(off):
                h, d = feature_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                key = np.unique(d.astype(np.int64) << BITS | h.astype(np.int64))
                ends = np.searchsorted(key >> BITS, np.arange(j - i + 1))
                terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), batch.column(0).slice(i, j - i), terms], ["positive", id_col, "terms"])

    kept = docs.select(id_col, text_col, "positive")
    return map_arrow(kept, run, f"positive boolean, `{id_col}` {kept.schema[0].dataType.simpleString()}, terms array<int>")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, fit: Fit) -> Model:
    """Learn from the term lists of positives and unlabelled documents."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0, prior)
    terms_p, terms_u = np.concatenate(positive), np.concatenate(unlabelled)
    seen, which = np.unique(np.concatenate([terms_p, terms_u]), return_inverse=True)
    p = np.bincount(which[: len(terms_p)], minlength=len(seen)) / len(positive)
    u = np.bincount(which[len(terms_p) :], minlength=len(seen)) / len(unlabelled)
    pooled = (p * len(positive) + u * len(unlabelled)) / (len(positive) + len(unlabelled))
    z = (p - u) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / len(positive) + 1 / len(unlabelled)))
    # toxic documents are among the unlabelled, so even a sure sign is at most 1 / prior times as frequent among positives
    z[p < min(fit.lift, 1 / prior / 2) * u] = 0
    keep = np.sort(np.argsort(-z, kind="stable")[: fit.kept])
    keep = keep[z[keep] > 4]
    index = seen[keep]
    at = np.full(len(seen), -1)
    at[keep] = np.arange(len(keep))

    def matrix(lists, offset):
        x = np.zeros((len(lists), len(keep)), np.float32)
        row = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        col = at[which[offset : offset + len(row)]]
        x[row[col >= 0], col[col >= 0]] = 1
        return x

    xp, xu = matrix(positive, 0), matrix(unlabelled, len(terms_p))
    w, b = np.zeros(len(keep), np.float32), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, fit.rounds + 1):
        fp, fu = xp @ w + b, xu @ w + b
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # logistic loss: l+ = log(1 + e^-f), l- = log(1 + e^f)
        risk_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        dp_negative, du = -prior * sp / len(sp), su / len(su)
        if risk_negative < 0:
            gp, gu = -dp_negative, -du
        else:
            gp, gu = prior * (sp - 1) / len(sp) + dp_negative, du
        g = xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + fit.shrink * prior * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        k = fit.rate / (1 - 0.9**step)
        w -= k * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= k * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(index.astype(np.int64), w.astype(np.float64), float(b), prior)


def telling(rows: DataFrame, prior: float, fit: Fit) -> list[int]:
    """The features that ``fit_nnpu`` can keep, by their counts in whole texts; twice as many as it keeps at most."""
    n = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    np_, nu = n.get(True, 0), n.get(False, 0)
    if not np_ or not nu:
        return []
    counts = rows.select("positive", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    pooled = (F.col("p") + F.col("u")) / (np_ + nu)
    z = (F.col("p") / np_ - F.col("u") / nu) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / np_ + 1 / nu))
    # a little below fit_nnpu's own bounds, which decide
    lifted = F.col("p") / np_ >= min(fit.lift, 1 / min(prior, 0.99) / 2) * F.col("u") / nu * (1 - 1e-9)
    best = counts.withColumn("z", z).filter((F.col("z") > 4 - 1e-6) & lifted).orderBy(F.desc("z"), "term").limit(2 * fit.kept)
    return [r["term"] for r in best.select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the ids marked 1 in ``labels`` and from documents whatever their marks, both only where ``may_learn`` holds.

    The class prior is the share of 1 among the labelled rows where it holds.
    """
    marked = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(may_learn & F.col("label").isNotNull())
    counted = marked.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    prior = (counted["ones"] or 0) / counted["n"] if counted["n"] else 0.0
    if not prior:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0, 0.0)
    toxic = bounded_sample(marked.filter("label = 1").select(id_col).distinct(), id_col, fit.max_positive)
    texts = docs.select(id_col, text_col)
    # ids may repeat: the rows that meet are bounded again
    met = texts.join(F.broadcast(toxic), id_col).withColumn("__row", F.xxhash64(id_col, text_col))
    positives = bounded_sample(met, "__row", fit.max_positive, seed=2).drop("__row").withColumn("positive", F.lit(True))
    unlabelled = bounded_sample(texts.filter(may_learn), id_col, fit.max_unlabelled, seed=1).withColumn("positive", F.lit(False))
    rows = materialize(_presence(positives.unionByName(unlabelled), id_col, text_col), "toxicity-terms")
    terms = F.array(*[F.lit(t) for t in telling(rows, prior, fit)]).cast("array<int>")
    rows = rows.withColumn("whole", F.hash("terms")).withColumn("terms", F.array_intersect("terms", terms))
    # as Arrow: a list of Python integers would take ten times the memory at the driver
    found = rows.orderBy("positive", F.xxhash64(id_col), id_col, "whole").select("positive", "terms").toArrow().combine_chunks()
    groups = []
    for flag in (True, False):
        lists = found.filter(pc.equal(found.column("positive"), flag)).column("terms")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[:-1]
        flat = pc.list_flatten(lists).to_numpy()
        groups.append(np.split(flat, ends) if len(lists) else [])
    return fit_nnpu(*groups, min(prior, 0.99), fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """(id, score, predicted, the other columns): score in (0, 1), predicted 1 from CUT on."""

    def run(batches):
        at = IntMap(model.index, np.arange(len(model.index)))
        for batch in batches:
            data, off = tx.flat(batch.column(1))
            found = np.full(batch.num_rows, model.bias)
            for i, j in tx.pieces(off):
                h, d = feature_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                col = at.get(h.astype(np.int64))
                hit = col >= 0
                key = np.unique(d[hit].astype(np.int64) * len(model.index) + col[hit])
                np.add.at(found, i + key // max(1, len(model.index)), model.weights[key % max(1, len(model.index))] if len(key) else 0.0)
            s = 1 / (1 + np.exp(-np.clip(found, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32)), *batch.columns[2:]], names)

    kept = docs.select(id_col, text_col, *others)
    names = [id_col, "score", "predicted", *others]
    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others]
    return map_arrow(kept, run, ", ".join([f"`{id_col}` {kept.schema[0].dataType.simpleString()}", "score double", "predicted int", *kinds]))
