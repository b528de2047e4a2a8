"""Benchmark decontamination by spaced-seed hashing.

A window of ``Params.window`` words is hashed under fixed masks, each of which
ignores some positions.  The positions are dealt to ``substitutions + 2``
groups, and a mask keeps two of them: at most ``substitutions`` replaced words
spoil as many groups, so one mask at least sees only equal words, and a window
within the tolerance is never missed.  An item shorter than a window is one
window of its own length, with masks of that length and a tolerance in
proportion (one replaced word of 7 to 12, none of 5 or 6).

The hashes of benchmark windows and of document windows are joined, and each
hit is verified word by word.  What meets in the join are distinct windows: a
passage that a third of all documents hold is compared once, and its holders
meet the verdict afterwards.  A bitmap built from the benchmark's hashes goes
to all executors and drops nearly all document windows before; it drops no
true hit.  It has ``seed_bits`` bits for each hash up to 2**``most_bits`` in
all (32 MB); beyond that it lets more windows through to the join, and results
are the same.

Words are runs of non-white-space, A-Z folded, as hashes; punctuation belongs
to its word.  An item of fewer than ``least_item`` words is no evidence and
matches nothing.  Null and empty texts contain nothing and match nothing; very
long ones are searched whole; a null id is reported like any other; rows that
repeat an id count together, identical rows once; repeated items each count.
Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.runtime import discard, drop_rows, map_arrow, materialize, small, version


@dataclass(frozen=True)
class Params:
    window: int = 13  #: words
    substitutions: int = 2  #: replaced words that a window may have
    least_item: int = 5  #: words; a shorter item is no evidence and matches nothing
    seed_bits: int = 128
    most_bits: int = 28

    def tolerance(self, words: int) -> int:
        """Replaced words that a window of so many words may have."""
        return self.substitutions * min(words, self.window) // self.window

    def masks(self, words: int | None = None) -> list[list[int]]:
        """The positions that each mask of a window of so many words keeps."""
        words = words or self.window
        spare = self.tolerance(words)
        groups = spare + 2 if spare else 1
        return [[p for p in range(words) if p % groups in kept] for kept in combinations(range(groups), min(2, groups))]


def seeds(words: np.ndarray, length: int, params: Params) -> np.ndarray:
    """(masks, positions): the hashes of all windows of so many words."""
    n = max(0, len(words) - length + 1)
    out = np.empty((len(params.masks(length)), n), tx.U64)
    for i, mask in enumerate(params.masks(length)):
        h = np.full(n, tx.U64(length << 8 | i))
        for p in mask:
            h = h * tx.U64(0xD6E8FEB86659FD93) + words[p : p + n]
        out[i] = tx.mix64(h)
    return out


def window_key(words: np.ndarray, length: int) -> np.ndarray:
    """One hash of all words of each window."""
    n = max(0, len(words) - length + 1)
    h = np.full(n, tx.U64(length))
    for p in range(length):
        h = h * tx.U64(0xA0761D6478BD642F) + words[p : p + n]
    return tx.mix64(h)


def _words(batch: pa.RecordBatch):
    """(first row, words, first) of some documents at a time."""
    data, off = tx.flat(batch.column(1))
    for i, j in tx.pieces(off):
        raw, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = tx.word_spans(raw, o)
        yield i, tx.RangeHash(raw, fold=True)(starts, ends), first


def _windows(words: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The words of the windows that start at these places, as bytes."""
    held = np.lib.stride_tricks.sliding_window_view(words, length)[at] if len(at) else np.zeros((0, length), tx.U64)
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int64) * 8 * length)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(held).tobytes())]).cast(pa.binary())


def benchmark_windows(benchmark: DataFrame, params: Params, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, words, hashes): the windows of each item, or a short item as one."""

    def run(batches):
        for batch in batches:
            for i, words, first in _words(batch):
                size = np.diff(first)
                for length in sorted({min(n, params.window) for n in size.tolist() if n >= params.least_item}):
                    own = np.flatnonzero(size >= length if length == params.window else size == length)
                    count = size[own] - length + 1
                    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[own], count)
                    hashes = seeds(words, length, params)[:, at].T
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * hashes.shape[1])
                    columns = [
                        batch.column(0).take(pa.array(i + np.repeat(own, count))),
                        pa.array(window_key(words, length)[at].view(np.int64)),
                        _windows(words, at, length),
                        pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(hashes).reshape(-1).view(np.int64))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "window", "words", "hashes"])

    kept = benchmark.select(item_col, text_col)
    return map_arrow(kept, run, f"item {kept.schema[0].dataType.simpleString()}, window long, words binary, hashes array<long>")


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's two places in the bitmap."""
    return (h >> tx.U64(64 - bits)).astype(np.int64), (h & tx.U64((1 << bits) - 1)).astype(np.int64)


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """The bits of all hashes, each at two places, in 2**bits bits: what meets at the driver are its bytes that are not zero."""
    places = F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND((1 << bits) - 1))
    bytes_ = hashes.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(7 - (at & 7) as int))")).alias("bits"))
    packed = np.zeros(1 << (bits - 3), np.uint8)
    found = bytes_.toArrow()
    packed[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return packed.tobytes()


def document_hits(docs: DataFrame, bitmap, bits: int, lengths: list[int], params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, position, window, words, hashes): document windows with a hash whose bits are set."""

    def run(batches):
        packed = np.frombuffer(bitmap.value, np.uint8)

        def hit(h):
            a, b = _bits(h, bits)
            out = (packed[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(out)
            b = b[at]
            out[at] = (packed[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)
            return out

        for batch in batches:
            for i, words, first in _words(batch):
                for length in lengths:
                    if len(words) < length:
                        continue
                    hashes = seeds(words, length, params)
                    inside = np.ones(hashes.shape[1], bool)
                    for edge in first[1:-1]:  # windows that reach over a document's end
                        inside[max(0, edge - length + 1) : edge] = False
                    near = np.array([hit(h) for h in hashes]) & inside
                    at = np.flatnonzero(near.any(0))
                    d = np.searchsorted(first, at, side="right") - 1
                    near = near[:, at].T
                    ends = pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32))
                    row = pa.array(i + d)
                    columns = [
                        batch.column(0).take(row),
                        batch.column(2).take(row),
                        pa.array(at - first[d], pa.int64()),
                        pa.array(window_key(words, length)[at].view(np.int64)),
                        _windows(words, at, length),
                        pa.ListArray.from_arrays(ends, pa.array(hashes[:, at].T[near].view(np.int64))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "version", "position", "window", "words", "hashes"])

    kept = docs.select(id_col, text_col, version(text_col))
    return map_arrow(kept, run, f"id {kept.schema[0].dataType.simpleString()}, version long, position long, window long, words binary, hashes array<long>")


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, version, item, position, words): the verified document windows, with the most equal words of the item's windows."""
    spark = docs.sparkSession
    wanted = materialize(benchmark_windows(benchmark, params, item_col, item_text_col), "decontam-windows")
    distinct = wanted.dropDuplicates(["window"])
    hashed = distinct.select(F.col("window").alias("item_window"), F.col("words").alias("item_words"), F.explode("hashes").alias("hash"))
    n = hashed.agg(F.count("*"), F.collect_set(F.length("item_words"))).first()
    bits = min(params.most_bits, max(16, (params.seed_bits * n[0]).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bitmap(hashed, bits))
    hits = materialize(document_hits(docs, bitmap, bits, sorted(x // 8 for x in n[1]), params, id_col, text_col), "decontam-hits")
    met = hits.select("window", "words", "hashes").dropDuplicates(["window"]).select("window", "words", F.explode("hashes").alias("hash")).join(hashed, "hash")
    met = met.select("window", "words", "item_window", "item_words")

    def verify(batches):
        for batch in batches:
            equal = []
            for a, b in zip(batch.column(1), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), tx.U64), np.frombuffer(b.as_buffer(), tx.U64)
                same = int((x == y).sum()) if len(x) == len(y) else 0
                equal.append(same if same >= len(y) - params.tolerance(len(y)) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(equal, pa.int32())], ["window", "item_window", "words"])

    verified = map_arrow(met, verify, "window long, item_window long, words int").filter("words > 0").distinct()
    verified = materialize(verified, "decontam-verified")
    found = hits.select("id", "version", "position", "window").join(small(verified), "window").groupBy("id", "version", "position", "item_window").agg(F.max("words").alias("words"))
    items = wanted.select(F.col("window").alias("item_window"), "item").distinct()
    out = found.join(small(items), "item_window").groupBy("id", "version", "item", "position").agg(F.max("words").alias("words"))
    out = materialize(out, "decontam-matches")
    discard(wanted, hits, verified)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, words, position, windows): one row for each document and item that overlap.

    words: most equal words in one verified window; position: the word at
    which the first such window starts; windows: how many windows overlap.
    """
    found = matches(docs, benchmark, params, id_col, text_col, item_col, item_text_col)
    return found.groupBy(F.col("id").alias(id_col), "item").agg(F.max("words").alias("words"), F.min("position").alias("position"), F.count("*").alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (all columns) whose own text overlaps no item, whatever other rows of their id hold."""
    found = materialize(matches(docs, benchmark, params, id_col, text_col).select("id", "version").distinct(), "decontam-found")
    return drop_rows(docs, found, id_col, text_col)


#: What ``op3_decontamination`` gives for tables ``documents`` and ``benchmark`` whose items have 13 words or more, in DuckDB.
OVERLAPS_SQL = r"""
WITH masks(m, kept) AS (
    SELECT row_number() OVER (), [p for p in range(1, 14) if (p - 1) % 4 IN (a, b)] FROM range(4) x(a), range(4) y(b) WHERE a < b
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM benchmark
), doc_windows AS (
    SELECT doc_id, p, w[p:p + 12] AS v FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 11)) AS p FROM doc_words)
), item_windows AS (
    SELECT item_id, w[p:p + 12] AS v FROM (SELECT item_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 11)) AS p FROM item_words)
), doc_seeds AS (
    SELECT doc_id, p, v, m, [v[k] for k in kept] AS seed FROM doc_windows, masks
), item_seeds AS (
    SELECT item_id, v, m, [v[k] for k in kept] AS seed FROM item_windows, masks
), verified AS (
    SELECT d.doc_id, i.item_id, d.p, max(list_sum([CAST(d.v[k] = i.v[k] AS INT) for k in range(1, 14)])) AS same
    FROM doc_seeds d JOIN item_seeds i ON d.m = i.m AND d.seed = i.seed GROUP BY ALL
)
SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items,
       CAST(max(same) AS INT) AS matched_words, count(*) AS n_windows
FROM verified WHERE same >= 11 GROUP BY doc_id
"""
