"""Language identification: a byte convolutional network.

A text is cut into windows of a fixed number of bytes.  Filters of several
widths slide over a window's bytes; each keeps its maximum over the window;
a softmax over these maxima gives the window's language probabilities, and the
windows' mean log probabilities give the document's.  The network is trained
here, in NumPy, on a bounded, stratified sample of labelled documents
(``Fit``), whose windows are drawn from the whole text where they lie.
Prediction goes over all windows of the whole text.

A filter over w bytes is a sum of w table entries.  For prediction the tables
of neighbouring positions are summed beforehand, two bytes at a time, so that
a filter costs one or two look-ups a byte.

Null texts and texts without a letter are ``und`` with score 0.  A text
shorter than a window is padded with a byte class that no text has.  Without
labelled documents everything is ``und``.  Repeated rows get repeated results,
an empty table gives none.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.runtime import map_arrow

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")

#: Byte classes: 0 is padding, letters go without case, other ASCII by kind, and each byte of a longer character has its own.
CLASSES = 164
_CLASS = np.zeros(256, np.uint8)
_CLASS[0:128] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[48:58] = 3
_CLASS[33:48] = 4
_CLASS[97:123] = np.arange(5, 31)
_CLASS[65:91] = np.arange(5, 31)
_CLASS[128:256] = np.arange(36, 164)


@dataclass(frozen=True)
class Fit:
    documents: int = 6000  #: labelled documents that the fit sees at most, about; as many of each language as there are
    windows: int = 12  #: of each of these documents at most, drawn from all windows of its whole text
    window: int = 192  #: bytes
    filters: int = 16  #: of each width
    rounds: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass(frozen=True)
class Network:
    languages: list[str]
    window: int
    tables: list[np.ndarray]  #: per width: (width, class, filter)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(data: np.ndarray, size: int) -> np.ndarray:
    """(n, size) byte classes covering all bytes; the last window is padded."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = _CLASS[data]
    return out.reshape(n, size)


def train(x: np.ndarray, languages: list[str], fit: Fit) -> Network | None:
    """Learn from windows of byte classes, a row each, and their languages."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(fit.seed)
    y = np.searchsorted(names, languages)
    f, k = fit.filters, len(names)
    tables = [rng.normal(0, 0.1, (w, CLASSES, f)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(f, np.float32) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.1, (f * len(WIDTHS), k)).astype(np.float32), np.zeros(k, np.float32)
    weight = (len(y) / (k * np.bincount(y, minlength=k))).astype(np.float32)
    params = [*tables, *biases, out, out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(fit.rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(order), fit.batch):
            b = order[at : at + fit.batch]
            xb, yb, wb = x[b], y[b], weight[y[b]]
            pooled, best = [], []
            for w, table, bias in zip(WIDTHS, tables, biases, strict=True):
                n = fit.window - w + 1
                a = table[0][xb[:, :n]]
                for j in range(1, w):
                    a = a + table[j][xb[:, j : n + j]]
                top = a.argmax(1)
                best.append(top)
                pooled.append(np.maximum(np.take_along_axis(a, top[:, None], 1)[:, 0] + bias, 0))
            h = np.hstack(pooled)
            z = h @ out + out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), yb] -= 1
            p *= wb[:, None] / len(b)
            dh = (p @ out.T) * (h > 0)
            grads_t, grads_b = [], []
            for i, (w, top) in enumerate(zip(WIDTHS, best, strict=True)):
                d = dh[:, i * f : (i + 1) * f]
                g = np.zeros_like(tables[i])
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, top + j, 1), np.arange(f)[None]), d)
                grads_t.append(g)
                grads_b.append(d.sum(0))
            step += 1
            for p_, g, (m, v) in zip(params, [*grads_t, *grads_b, h.T @ p, p.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Network(names, fit.window, tables, biases, out, out_bias)


class Predictor:
    """A network with its tables summed for pairs of neighbouring bytes."""

    #: Windows that one pass works on.
    BLOCK = 64

    def __init__(self, net: Network):
        self.net = net
        t2, t3, t4 = net.tables
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(CLASSES * CLASSES, -1))
        # only the classes that occur in text this far matter for the cache; rows are 64 bytes
        self.two, self.three, self.four_a, self.four_b = pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3])
        self.last3 = np.ascontiguousarray(t3[2])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages)."""
        net, rows = self.net, []
        for at in range(0, len(x), self.BLOCK):
            w = x[at : at + self.BLOCK].astype(np.int32)
            pairs = w[:, :-1] * CLASSES + w[:, 1:]
            h = [self.two.take(pairs, 0).max(1)]
            a = self.three.take(pairs[:, :-1], 0)
            a += self.last3.take(w[:, 2:], 0)
            h.append(a.max(1))
            a = self.four_a.take(pairs[:, :-2], 0)
            a += self.four_b.take(pairs[:, 2:], 0)
            h.append(a.max(1))
            z = np.maximum(np.hstack([v + b for v, b in zip(h, net.biases, strict=True)]), 0) @ net.out + net.out_bias
            z = z - z.max(1, keepdims=True)
            rows.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.vstack(rows)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of each document."""
        size = self.net.window
        lengths = np.diff(offsets)
        n = np.maximum(1, -(-lengths // size))
        first = np.concatenate([[0], np.cumsum(n)])
        x = np.zeros(int(first[-1]) * size, np.uint8)
        # a document's bytes go to the start of its first window
        to = np.arange(len(data)) + np.repeat(first[:-1] * size - offsets[:-1], lengths)
        x[to] = _CLASS[data]
        logs = self.log_probabilities(x.reshape(-1, size))
        # a padded window counts by its share of bytes
        weight = np.ones(len(logs))
        weight[first[1:] - 1] = np.maximum(lengths - (n - 1) * size, 1) / size
        total = np.add.reduceat(logs * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit(docs: DataFrame, may_learn: Column, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learn from the documents where ``may_learn`` holds and text and language are not null."""
    labelled = docs.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, fit.documents // len(counts))
    scale = 1 << 30
    shares = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(scale, int(each / n * scale) + 1))])
    drawn = labelled.filter(F.pmod(F.xxhash64(id_col), F.lit(scale)) < shares[F.col("lang")])
    size = fit.window

    def cut(batches):
        """The drawn windows of each text; the draw depends on the row's hash alone."""
        for batch in batches:
            order, found = batch.column(0).to_pylist(), []
            for o, t in zip(order, batch.column(2).to_pylist(), strict=True):
                w = windows_of(np.frombuffer(t.encode(), np.uint8), size)
                pick = np.random.default_rng([fit.seed, o & ((1 << 63) - 1)]).permutation(len(w))[: fit.windows]
                found.append(w[np.sort(pick)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["o", "lang", "windows"])

    rows = map_arrow(drawn.select(F.xxhash64(id_col, "text").alias("o"), "lang", "text"), cut, "o long, lang string, windows binary")
    found = rows.orderBy("o", "lang", "windows").toArrow()
    each_x = [np.frombuffer(w, np.uint8).reshape(-1, size) for w in found.column("windows").to_pylist()]
    langs = [lang for lang, w in zip(found.column("lang").to_pylist(), each_x, strict=True) for _ in w]
    return train(np.vstack(each_x) if each_x else np.zeros((0, size), np.uint8), langs, fit)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """(id, lang_pred, score, the other columns)."""

    def run(batches):
        predictor = Predictor(net) if net else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lettered = np.array([bool(_LETTER.search(t)) for t in texts], bool)
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if predictor:
                data, off = tx.flat(batch.column(1))
                for i, j in tx.pieces(off):
                    which, s = predictor.documents(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    langs[i:j] = np.array(net.languages, object)[which]
                    scores[i:j] = s
                langs[~lettered] = UNKNOWN
                scores[~lettered] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores), *batch.columns[2:]], names)

    kept = docs.select(id_col, text_col, *others)
    names = [id_col, "lang_pred", "score", *others]
    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others]
    return map_arrow(kept, run, ", ".join([f"`{id_col}` {kept.schema[0].dataType.simpleString()}", "lang_pred string", "score double", *kinds]))
