"""Line deduplication: documents that overlap are aligned, and the later one loses the common blocks.

Overlapping documents are found through rare line hashes.  A single short line
is no evidence, so what is hashed is the shortest run of neighbouring lines
from each line onwards, and from each backwards, that has ``Params.words``
words.  A document is paired with the first holder of each of its hashes, so
with as many documents as it has lines at most, however many hold the same:
no pairs are made within a group.

Each pair is aligned by patience diff over the hashes that led to it: hashes
that are unique in both documents are put into the longest increasing order,
and the gaps between them are filled with the other common hashes (the k-th
occurrence meets the k-th; further ones start over).  What that leaves, blocks
that have moved, is laid out in further increasing orders.  Aligned runs that
follow one another in both documents make up blocks, and blocks are deleted
from the later document.  So a document loses every run of neighbouring lines
of ``Params.words`` words or more that stands in some earlier document (one
with a smaller id) as neighbouring lines too; and the first holder keeps it.

Lines are compared without the white space at their ends; lines of nothing
else are never compared nor deleted, and don't part a block.  A null or empty
text has no lines; a very long one is hashed whole.  Rows that repeat an id
lose nothing to each other, and each row loses what its own text shares; rows
with a null id take no part.  An empty table stays empty.  All columns of the
input are kept; one named like an added column is a ValueError.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.llm import text as tx
from tessera.llm.runtime import discard, map_arrow, materialize, version
from tessera.plans.skew import HOT_KEYS, LEAST_ROWS, join_unique


@dataclass(frozen=True)
class Params:
    words: int = 8  #: of a block, at least


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line hashes, rows of the batch, words) of the lines with a word, some documents at a time."""
    data, off = tx.flat(batch.column(1))
    for i, j in tx.pieces(off):
        raw, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = tx.word_spans(raw, o)
        n = len(starts)
        if not n:
            continue
        doc = np.repeat(np.arange(j - i), np.diff(first))
        breaks = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        opens = np.ones(n, bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]])
        at = np.flatnonzero(opens)
        after = np.append(at[1:], n)
        yield tx.RangeHash(raw)(starts[at], ends[after - 1]), i + doc[at], after - at


def shortest_runs(line: np.ndarray, d: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first lines, last lines) of the shortest runs of ``least`` words from each line onwards and backwards, in its document."""
    n = len(line)
    total = np.concatenate([[0], np.cumsum(words)])
    onwards = np.searchsorted(total, total[:-1] + least) - 1
    there = np.flatnonzero((onwards < n) & (d[np.minimum(onwards, n - 1)] == d))
    backwards = np.searchsorted(total, total[1:] - least, side="right") - 1
    other = np.flatnonzero((backwards >= 0) & (d[np.maximum(backwards, 0)] == d))
    other = other[onwards[backwards[other]] != other]
    a, b = np.concatenate([there, backwards[other]]), np.concatenate([onwards[there], other])
    h = (b - a).astype(tx.U64)
    for k in range(int((b - a).max(initial=-1)) + 1):
        on = np.flatnonzero(a + k <= b)
        h[on] = tx.mix64(h[on] * tx.U64(0xD6E8FEB86659FD93) + line[a[on] + k])
    return h, a, b


def run_table(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """(run, doc, version, start, stop, nth, alone): the shortest runs of each text; start and stop count its lines with a word, nth the run's occurrences in it."""

    def run(batches):
        for batch in batches:
            for line, d, words in _lines(batch):
                h, a, b = shortest_runs(line, d, words, params.words)
                owner = d[a]
                order = np.lexsort((a, h, owner))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                head = np.flatnonzero(new)
                which = np.cumsum(new) - 1
                nth, alone = np.empty(len(h), np.int32), np.empty(len(h), bool)
                nth[order] = np.arange(len(h)) - head[which]
                alone[order] = (np.diff(np.append(head, len(h))) == 1)[which]
                zero = np.searchsorted(d, d)[a]
                row = pa.array(owner)
                columns = [pa.array(h.view(np.int64)), batch.column(0).take(row), batch.column(2).take(row), pa.array((a - zero).astype(np.int32)), pa.array((b - zero).astype(np.int32)), pa.array(nth), pa.array(alone)]
                yield pa.RecordBatch.from_arrays(columns, ["run", "doc", "version", "start", "stop", "nth", "alone"])

    kept = docs.select(id_col, text_col, version(text_col)).filter(F.col(id_col).isNotNull())
    return map_arrow(kept, run, f"run long, doc {kept.schema[0].dataType.simpleString()}, version long, start int, stop int, nth int, alone boolean")


def increasing(pairs: list[tuple]) -> list[tuple]:
    """A longest run of pairs, sorted by their first parts, whose second parts increase."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, p in enumerate(pairs):
        at = bisect_left(tops, p[1])
        if at == len(tops):
            tops.append(p[1])
            last.append(i)
        else:
            tops[at], last[at] = p[1], i
        back[i] = last[at - 1] if at else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(matches: list[tuple]) -> list[tuple]:
    """Patience alignment of (position, position in the other, unique, ...) matches."""
    matches = sorted(matches)
    anchors = increasing([m for m in matches if m[2]])
    rest = [m for m in matches if not m[2]]
    if not rest:
        return anchors
    out, at = [], 0
    low = -1
    for anchor in [*anchors, None]:
        gap = []
        while at < len(rest) and (anchor is None or rest[at][0] < anchor[0]):
            if rest[at][1] > low and (anchor is None or rest[at][1] < anchor[1]):
                gap.append(rest[at])
            at += 1
        out += increasing(gap)
        if anchor:
            out.append(anchor)
            low = anchor[1]
    return out


def orders(matches: list[tuple]) -> list[list[tuple]]:
    """All of the sorted matches, dealt to increasing orders: each goes behind the largest end that it follows."""
    ends: list[int] = []  # descending
    out: list[list[tuple]] = []
    for m in matches:
        at = bisect_left(ends, 1 - m[1], key=lambda e: -e)
        if at == len(ends):
            ends.append(m[1])
            out.append([m])
        else:
            ends[at] = m[1]
            out[at].append(m)
    return out


def blocks(matches: list[tuple]) -> list[tuple[int, int, int]]:
    """(start, stop, other's start) of the blocks that (start, other's start, unique, stop) matches of two documents align to."""
    longest: dict[tuple[int, int], tuple] = {}
    for start, other, unique, stop in matches:
        held = longest.get((start, other), (0, 0, False, 0))
        longest[start, other] = (start, other, unique or held[2], max(stop, held[3]))
    matches = sorted(longest.values())
    aligned = patience(matches)
    there = set(aligned)
    out: list[tuple[int, int, int]] = []
    for order in [aligned, *orders([m for m in matches if m not in there])]:
        fresh = True
        for start, other, _, stop in order:
            if not fresh and start <= out[-1][1] + 1 and start - other == out[-1][0] - out[-1][2]:
                out[-1] = (out[-1][0], max(out[-1][1], stop), out[-1][2])
            else:
                out.append((start, stop, other))
                fresh = False
    return out


def aligned_blocks(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, other, start, stop, other_start): the blocks that each text shares with earlier documents, in lines with a word."""
    every = materialize(run_table(docs, params, id_col, text_col), "line-runs")
    shared = every.groupBy("run").agg(F.min("doc").alias("other"), F.max("doc").alias("last"), F.count("*").alias("rows")).filter("other < last")
    shared = materialize(shared.select("run", "other", "rows"), "line-first-holders")
    # a run that a good part of all documents hold meets its first holder by broadcast
    bound = max(LEAST_ROWS, (shared.agg(F.sum("rows")).first()[0] or 0) // HOT_KEYS)
    hot = [r["run"] for r in shared.filter(F.col("rows") > bound).select("run").collect()]
    met = materialize(join_unique(every, shared.drop("rows"), "run", hot=hot), "line-holders")
    first = met.filter("doc = other").groupBy("run", "nth").agg(F.min("start").alias("other_start"))
    times = first.groupBy("run").agg(F.count("*").cast("int").alias("times"))
    later = join_unique(met.filter("doc > other"), times, "run", hot=hot)
    later = later.withColumn("k", F.expr("nth % times")).withColumn("place", F.xxhash64("run", "k"))
    later = materialize(later.withColumnRenamed("run", "own_run"), "line-later-holders")
    placed = join_unique(later, first.withColumn("place", F.xxhash64("run", "nth")).drop("nth"), "place").filter("own_run = run")
    # a text's own runs at most
    pairs = placed.groupBy("doc", "version", "other").agg(F.collect_set(F.struct("start", "other_start", (F.col("alone") & (F.col("times") == 1)).alias("unique"), "stop")).alias("found"))

    def run(batches):
        for batch in batches:
            which, found = [], []
            for i, matches in enumerate(batch.column(3).to_pylist()):
                for block in blocks([(m["start"], m["other_start"], m["unique"], m["stop"]) for m in matches]):
                    which.append(i)
                    found.append(block)
            at = pa.array(which, pa.int64())
            columns = [pa.array([f[c] for f in found], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *columns], ["doc", "version", "other", "start", "stop", "other_start"])

    kind = pairs.schema[0].dataType.simpleString()
    out = materialize(map_arrow(pairs, run, f"doc {kind}, version long, other {kind}, start int, stop int, other_start int"), "line-blocks")
    discard(every, shared, met, later)
    return out


def without_lines(text: str, positions: list[int]) -> str:
    """The text without its lines at these positions, counted among the lines with a word."""
    gone, kept, at = set(positions), [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            if at not in gone:
                kept.append(line)
            at += 1
        else:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", added: str = "lines_removed") -> DataFrame:
    """All rows and columns, the texts without the deleted blocks; ``added``: how many lines a text has lost."""
    if taken := {added, "__doc", "__version", "__positions"}.intersection(docs.columns):
        raise ValueError(f"the input has a column {sorted(taken)[0]} already")
    found = aligned_blocks(docs, params, id_col, text_col).groupBy("doc", "version").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    lost = F.expr("array_sort(array_distinct(flatten(transform(found, r -> sequence(r.start, r.stop)))))")
    gone = found.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), lost.alias("__positions"))
    # deletions grow with the texts, so they are never broadcast: texts are dealt once
    same = (F.col(id_col) == F.col("__doc")) & (version(text_col) == F.col("__version"))
    joined = docs.join(gone.hint("merge"), same, "left").select(*docs.columns, "__positions")

    at, names = docs.columns.index(text_col), [*docs.columns, added]

    def cut(batches):
        for batch in batches:
            text, found = batch.column(at), batch.column(batch.num_columns - 1)
            changed = found.is_valid()
            # only texts that lose lines become Python's
            pairs = zip(text.filter(changed).to_pylist(), found.filter(changed).to_pylist(), strict=True)
            left = pa.array([t if t is None else without_lines(t, p) for t, p in pairs], text.type)
            gone = pc.fill_null(pc.list_value_length(found), 0).cast(pa.int32())
            columns = [*batch.columns[:-1], gone]
            columns[at] = pc.replace_with_mask(text, changed, left)
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = StructType([StructField(f.name, f.dataType) for f in docs.schema.fields] + [StructField(added, IntegerType())])
    return map_arrow(joined, cut, kinds)


#: What ``op5_line_dedup`` gives for a table ``documents`` of unique ids, in DuckDB: runs are compared as text, without hashes or alignment.
LINES_SQL = r"""
WITH parts AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
), lines AS (
    SELECT doc_id, k, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
           len(regexp_extract_all(line, '[^ 	-
]+')) AS words FROM parts
), worded AS (
    SELECT doc_id, k, bare, words, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p,
           sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto
    FROM lines WHERE words > 0 AND doc_id IS NOT NULL
), runs AS (
    SELECT x.doc_id, x.p AS a, y.p AS b
    FROM worded x JOIN worded y ON x.doc_id = y.doc_id AND y.p BETWEEN x.p AND x.p + 7
    WHERE y.upto - x.upto + x.words >= 8 AND (y.upto - y.words - x.upto + x.words < 8 OR y.upto - x.upto < 8)
), held AS (
    SELECT r.doc_id, r.a, r.b, string_agg(w.bare, chr(10) ORDER BY w.p) AS held
    FROM runs r JOIN worded w ON w.doc_id = r.doc_id AND w.p BETWEEN r.a AND r.b GROUP BY ALL
), later AS (
    SELECT doc_id, a, b FROM (SELECT *, min(doc_id) OVER (PARTITION BY held) AS first FROM held) WHERE first < doc_id
), gone AS (
    SELECT DISTINCT w.doc_id, w.k FROM later l JOIN worded w ON w.doc_id = l.doc_id AND w.p BETWEEN l.a AND l.b
), kept AS (
    SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.k) FILTER (g.k IS NULL) AS left_text, count(g.k) AS n
    FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_lines_removed,
       CAST(length(coalesce(d.text, '')) - length(coalesce(k.left_text, '')) AS BIGINT) AS n_chars_removed,
       sha256(coalesce(k.left_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
