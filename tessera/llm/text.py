"""Byte-level text kernels shared by the operators of this subpackage.

An Arrow string column is a byte buffer with offsets.  The kernels below find
words, lines and their 64-bit hashes for all documents of a batch with a
handful of NumPy passes, without making a Python object per document or word.

Hashes are polynomials modulo 2**64 over a random value per byte, finished by
a bijective mixer.  Prefix sums give the hash of any byte range in O(1), and
equal ranges have equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes of text that one kernel call works on (a longer document goes alone).
CHUNK_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_VALUE_FOLDED = _BYTE_VALUE[_FOLD]

#: ASCII white space: 0x20 and 0x09 to 0x0D, as in ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        tables = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 4 * CHUNK_BYTES:  # made for one huge document: not kept
            return tables
        _powers = tables
    return _powers


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        up, self._down = _power_tables(len(data) + 1)
        table = _BYTE_VALUE_FOLDED if fold else _BYTE_VALUE
        self._sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(table[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix64(h + (ends - starts).astype(U64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges (first, last+1) of at most ``limit`` bytes, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all documents; those of document d are first[d]:first[d+1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[data]
    rises = inside[1:] & ~inside[:-1]
    falls = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    touching = cuts[inside[cuts] & inside[cuts + 1]]  # a word ends where its document does
    rises[touching] = True
    falls[touching] = True
    starts, ends = np.flatnonzero(rises), np.flatnonzero(falls)
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the lines (split at 0x0A) of all documents; a document of no bytes has none."""
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    cuts = offsets[1:-1]
    starts = np.unique(np.concatenate([offsets[:1], breaks + 1, cuts]))
    starts = starts[starts < n]
    # a line break at the very end of a document opens one more, empty, line there: it holds nothing and is left out
    ends = np.append(starts[1:], n)
    closed = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A) if n else np.zeros(0, bool)
    return starts, ends - closed, np.searchsorted(starts, offsets)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """An order-sensitive hash of aligned columns of hashes."""
    out = hashes[0] * U64(0xD6E8FEB86659FD93)
    for h in hashes[1:]:
        out = (out ^ (out >> U64(32))) * U64(0xD6E8FEB86659FD93) + h * U64(0xA0761D6478BD642F)
    return mix64(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence as one."""
    out = []
    grams = combine([words[i : len(words) - k + 1 + i] for i in range(k)]) if len(words) >= k else np.zeros(0, U64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            # other lengths take another start, so that "x y" differs from any three words
            out.append(combine([np.array([b - a], U64), *words[a:b, None]]))
        else:
            out.append(np.zeros(0, U64))
    return out
