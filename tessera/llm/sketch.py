"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines; a long line is cut further, behind words
whose hash is divisible by ``Params.cut``, so that a change moves no cut but
those next to it.  A fingerprint is a table of cells; each paragraph digest is
added to one cell in each of three parts of the table: count, sum of digests,
sum of check values.  The difference of two texts' tables holds only what
differs, and peeling recovers these digests one after the other: a cell with
count 1 or -1 whose check fits its digest gives it away and is taken out of
the other cells.  If peeling gets stuck, both tables are made again, larger.

Many pairs are subtracted and peeled side by side in NumPy.

A null text is an empty one.  An empty text has no paragraphs; two of them are
alike (1.0).  Paragraphs count once, however often a text repeats them.  Texts
of any length are read whole.  Rows that repeat an id, or have none, are rows
like others: next to each other, ordered by their texts' hashes, null ids
last.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.runtime import map_arrow


@dataclass(frozen=True)
class Params:
    cells: int = 24  #: of a stored fingerprint; a multiple of three
    growth: int = 4  #: how many times as large the next table is
    cut: int = 8


def paragraphs(data: np.ndarray, offsets: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(digests, first): the sorted distinct paragraph digests of each document."""
    starts, ends, first = tx.word_spans(data, offsets)
    n = len(starts)
    hashed = tx.RangeHash(data)
    if not n:
        return np.zeros(0, tx.U64), np.zeros(len(offsets), np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    opens = np.ones(n, bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]]) | (hashed(starts[:-1], ends[:-1]) % tx.U64(params.cut) == 0)
    at = np.flatnonzero(opens)
    last = np.append(at[1:], n) - 1
    digest, owner = hashed(starts[at], ends[last]), doc[at]
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
    return digest[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """(3, n): a cell in each part of the table, each by a hash of its own."""
    part = cells // 3
    return np.array([(tx.mix64(digests ^ tx.U64(0xA5A5A5A5F00DBEEF * (i + 1) % (1 << 64))) % tx.U64(part)).astype(np.int64) + i * part for i in range(3)])


def _checks(digests: np.ndarray) -> np.ndarray:
    return (tx.mix64(digests + tx.U64(0x1234567)) >> tx.U64(32)).astype(np.uint32)


class Tables:
    """One table for each of n documents."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros(n * cells, np.int32)
        self.digest = np.zeros(n * cells, tx.U64)
        self.check = np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> None:
        signs = np.broadcast_to(np.asarray(sign, np.int64), owner.shape)
        signed, checks = digests * signs.astype(tx.U64), _checks(digests) * signs.astype(np.uint32)
        for place in _places(digests, self.cells):
            at = owner * self.cells + place
            np.add.at(self.count, at, signs.astype(np.int32))
            np.add.at(self.digest, at, signed)
            np.add.at(self.check, at, checks)

    def packed(self, i: int) -> bytes:
        a, b = i * self.cells, (i + 1) * self.cells
        return self.count[a:b].astype("<i4").tobytes() + self.digest[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign, done): what peeling recovers, and which tables came out empty."""
        n = len(self.count) // self.cells
        owners, digests, signs = [], [], []
        active = np.flatnonzero(self.count)
        while len(active):
            sign = self.count[active]
            one = np.abs(sign) == 1
            at, sign = active[one], sign[one].astype(np.int64)
            d = self.digest[at] * sign.astype(tx.U64)
            fits = (_checks(d) * sign.astype(np.uint32)) == self.check[at]
            at, d, sign = at[fits], d[fits], sign[fits]
            if not len(at):
                break
            owner = at // self.cells
            # two or three cells of one table can give away the same digest in the same round
            key = np.lexsort((d, owner))
            owner, d, sign = owner[key], d[key], sign[key]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (owner[1:] != owner[:-1])
            owner, d, sign = owner[new], d[new], sign[new]
            self.add(owner, d, -sign)
            owners.append(owner)
            digests.append(d)
            signs.append(sign)
            touched = np.unique((_places(d, self.cells) + owner * self.cells).reshape(-1))
            active = touched[self.count[touched] != 0]
        stuck = (self.count != 0) | (self.digest != 0)
        done = ~stuck.reshape(n, self.cells).any(1)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(owners, np.int64), join(digests, tx.U64), join(signs, np.int64), done


def _owners(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, at): the items of the chosen rows, owner counting among these rows."""
    n = first[rows + 1] - first[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[rows][owner]
    return owner, at


def differences(a, b, params: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of every digest that only one of two rows has, 1 where it is the first's, by pair; a and b are (digests, first, rows)."""
    (da, fa, ra), (db, fb, rb) = a, b
    todo, cells = np.arange(len(ra)), params.cells
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, tx.U64), np.zeros(0, np.int64))]
    while len(todo):
        tables = Tables(len(todo), cells)
        owner, at = _owners(fa, ra[todo])
        tables.add(owner, da[at])
        owner, at = _owners(fb, rb[todo])
        tables.add(owner, db[at], -1)
        owner, digest, sign, done = tables.peel()
        whole = done[owner]
        found.append((todo[owner[whole]], digest[whole], sign[whole]))
        todo, cells = todo[~done], cells * params.growth
    pair, digest, sign = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(pair, kind="stable")
    return pair[order], digest[order], sign[order]


def likeness(size_a: np.ndarray, size_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    """Shared digests over all digests; 1 for two empty sets."""
    both = size_a - only_a
    return np.where(both + only_a + only_b > 0, both / np.maximum(1, both + only_a + only_b), 1.0)


def _fingerprints(digests, first, params) -> list[str]:
    n = len(first) - 1
    tables = Tables(n, params.cells)
    tables.add(np.repeat(np.arange(n), np.diff(first)), digests)
    sizes = np.diff(first).tolist()
    return [f"{sizes[i]}:{base64.b64encode(tables.packed(i)).decode()}" for i in range(n)]


def fingerprint(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, fingerprint) of every whole text."""

    def run(batches):
        for batch in batches:
            data, off = tx.flat(batch.column(1))
            for i, j in tx.pieces(off):
                digests, first = paragraphs(data[off[i] : off[j]], off[i : j + 1] - off[i], params)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(_fingerprints(digests, first, params), pa.string())], [id_col, "n_paragraphs", "fingerprint"])

    kept = docs.select(id_col, text_col)
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_paragraphs long, fingerprint string")


def recovered(old: DataFrame, new: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, removed, added): the digests of the paragraphs that only the old, and only the new, version of a document has; null versions are empty."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            (xa, fa), (xb, fb) = (paragraphs(*tx.flat(batch.column(c)), params) for c in (1, 2))
            pair, digest, sign = differences((xa, fa, np.arange(n)), (xb, fb, np.arange(n)), params)
            columns = []
            for side in (1, -1):
                ends = np.searchsorted(pair[sign == side], np.arange(n + 1))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(digest[sign == side].view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "removed", "added"])

    both = old.select(id_col, F.col(text_col).alias("old")).join(new.select(id_col, F.col(text_col).alias("new")), id_col)
    return map_arrow(both, run, f"`{id_col}` {both.schema[0].dataType.simpleString()}, removed array<long>, added array<long>")


#: Bytes of text that one range of ids holds, about, and how many ranges there are at most: their first keys meet at the driver, so beyond 400 GB ranges grow instead.
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000


@dataclass(frozen=True)
class Ranges:
    """Ranges of descending ids, a number for each; an id with more rows than a range is split by its texts' hashes."""

    above: list[int]  #: ascending; a range ends behind each of these ids
    splits: list[int]  #: numbers of a range, by ascending ids; the last entry is for null ids

    def number(self, ids: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
        splits = np.array(self.splits, np.int64)
        segment = np.where(null, len(splits) - 1, np.searchsorted(np.array(self.above, np.int64), ids, side="left"))
        last = splits[:-1]
        offset = np.append(last.sum() - np.cumsum(last), last.sum())
        return offset[segment] + ((tie >> 31) * splits[segment] >> 32)


def ranges(keys: DataFrame, bytes_: Column, least: int) -> Ranges:
    """Ranges of about RANGE_BYTES for (id) rows, ``least`` of them at least."""
    size = keys.agg(F.count("*").alias("rows"), F.sum(bytes_).alias("bytes"), F.count_if(F.col("id").isNull()).alias("none")).first()
    n = max(least, min(MOST_RANGES, -(-(size["bytes"] or 0) // RANGE_BYTES)))
    each = max(1, size["rows"] // n)
    # a quantile is off by a quarter of a range at most
    cuts = keys.select(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] or [] if n > 1 else []
    # fewer than n / 2 ids
    many = {r["id"]: -(-r["rows"] // each) for r in keys.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * each).collect()}
    above = sorted({*cuts, *many, *(i - 1 for i in many)})
    splits = [many.get(i, 1) for i in above] + [1, max(1, -(-size["none"] // each))]
    return Ranges(above, splits)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, part, halo), dealt and sorted so that each row is followed by the next in descending id.

    Ids are cut into ranges by bytes, each of them one partition; a range's
    last row is followed by a copy of the next range's first, marked halo, and
    the very last by a copy of the very first.  Only the ranges' first keys
    meet at the driver.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    cut = ranges(kept, F.octet_length("text"), 2 * spark.sparkContext.defaultParallelism)

    @F.pandas_udf("int")
    def number(ids: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(cut.number(ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(), tie.to_numpy(np.int64)))

    # equal ids are ordered by their texts' hashes, which are not negative here
    keyed = kept.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    ranged = keyed.withColumn("part", number("id", "tie"))
    top = F.max(F.struct("id", (-F.col("tie")).alias("tie"))).alias("top")
    tops = ranged.groupBy("part").agg(top).select("part", "top.id", (-F.col("top.tie")).alias("tie")).orderBy("part").collect()
    if not tops:
        return kept.select("id", "text", F.lit(0).alias("part"), F.lit(False).alias("halo"))
    before = [(t["part"], tops[i - 1]["part"], t["id"], t["tie"]) for i, t in enumerate(tops)]  # of the first range: the last
    firsts = F.broadcast(spark.createDataFrame(before, "top_part int, previous int, top_id long, top_tie long"))
    copies = keyed.join(firsts, F.expr("id <=> top_id and tie = top_tie")).groupBy("previous", "id", "tie").agg(F.min("text").alias("text"))
    dealt = ranged.select("id", "text", "tie", "part", F.lit(False).alias("halo")).unionByName(copies.select("id", "text", "tie", F.col("previous").alias("part"), F.lit(True).alias("halo")))
    return dealt.repartitionById(sum(cut.splits), "part").sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), "tie", "text").select("id", "text", "part", "halo")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_edits(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against its edited text and the next document."""
    columns = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(ids, texts, following):
        """texts[i] is followed by following[i]."""
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        raw = [t.encode() for t in [*texts, *changed, *following[-1:]]]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        digests, first = paragraphs(np.frombuffer(b"".join(raw), np.uint8), off, params)
        n = len(texts)
        own, other = np.arange(n), np.arange(n) + n
        # the next document is the next row, and the last row's next is at the very end
        after = np.append(own[1:], 2 * n)
        rows = {r: (digests, first, r_rows) for r, r_rows in (("own", own), ("edit", other), ("next", after))}
        size = np.diff(first)
        near = []
        for r, r_rows in (("edit", other), ("next", after)):
            pair, _, sign = differences(rows["own"], rows[r], params)
            a, b = (np.bincount(pair[sign == side], minlength=n) for side in (1, -1))
            near.append(likeness(size[own], size[r_rows], a, b))
        prints = _fingerprints(digests[: first[2 * n]], first[: 2 * n + 1], params)
        arrays = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw[n : 2 * n]]), pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()), pa.array(near[0]), pa.array(near[1])]
        return pa.RecordBatch.from_arrays(arrays, columns)

    def run(batches):
        ids, texts, parts, size = [], [], [], 0
        ended = None  # the part whose halo has been used

        def flush(following):
            # all but the rows without a successor yet
            return finish(ids, texts, [*texts[1:], following])

        for batch in batches:
            for i, t, part, halo in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if halo:
                    if part != ended and ids:
                        yield flush(t)
                        ids, texts, parts, size = [], [], [], 0
                    ended = part
                    continue
                if size > 1 << 20:
                    yield flush(t)
                    ids, texts, parts, size = [], [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)

    return map_arrow(with_next(docs, id_col, text_col), run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
