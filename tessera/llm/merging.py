"""Vectorised tables and merging for byte-pair encodings."""

from __future__ import annotations

import numpy as np

#: The rank of a pair that doesn't merge.
NEVER = np.int32(2**31 - 1)


class IntMap:
    """A fixed map from non-negative 64-bit integers to non-negative 32-bit ones, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, -1, np.int32)
        left, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self._slot(left)
        while len(left):  # of those that want one free slot, one gets it; the others go on to the next
            free = self._keys[slot] < 0
            self._keys[slot[free]] = left[free]
            placed = self._keys[slot] == left
            self._values[slot[placed]] = values[placed]
            left, values, slot = left[~placed], values[~placed], (slot[~placed] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._values[slot], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot_r = slot[rest] = (slot[rest] + 1) & self._mask
            held = self._keys[slot_r]
            found = held == keys[rest]
            out[rest[found]] = self._values[slot_r[found]]
            rest = rest[~found & (held >= 0)]
        return out


class RowMerger:
    """Exact BPE merging of many short words at once, one merge of each word a round."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        """pairs: left << 32 | right; a lower rank merges first, and of equal ranks the leftmost."""
        self._index = IntMap(pairs, np.arange(len(pairs)))
        self._pairs = pairs
        self._rank = np.append(np.asarray(ranks, np.int32), NEVER)  # index -1: no such pair
        self._made = np.append(np.asarray(made, np.int32), -1)

    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, made) of each pair."""
        return dict(zip(self._pairs.tolist(), zip(self._rank.tolist(), self._made.tolist())))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._index.get(left.astype(np.int64) << 32 | right.astype(np.int64))
        return self._rank[at], self._made[at]

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, counts) of the words after merging; the input has the words' symbols one after the other."""
        counts = np.asarray(counts, np.int64)
        starts = np.cumsum(counts) - counts
        done_at, done_row, done_count = [], [], counts.copy()
        by_length = np.argsort(counts, kind="stable")
        for group in np.array_split(by_length, max(1, len(by_length) // 4096)):
            for at, rows in self._merge_group(symbols, starts[group], counts[group]):
                lengths = (rows >= 0).sum(1)
                done_count[group[at]] = lengths
                done_at.append(np.repeat(group[at], lengths))
                done_row.append(rows[rows >= 0])
        if not done_at:
            return np.zeros(0, np.int32), done_count
        owner = np.concatenate(done_at)
        return np.concatenate(done_row)[np.argsort(owner, kind="stable")], done_count

    def _merge_group(self, symbols, starts, counts):
        if not len(starts) or not counts[-1]:
            return
        width = int(counts[-1])
        cell = np.arange(width)
        real = cell < counts[:, None]
        rows = np.where(real, symbols[np.where(real, starts[:, None] + cell, 0)], np.int32(-1)).astype(np.int32)
        rank = np.full((len(rows), width), NEVER, np.int32)
        made = np.full((len(rows), width), -1, np.int32)
        both = real[:, 1:] if width > 1 else real[:, :0]
        rank[:, :-1][both], made[:, :-1][both] = self._look(rows[:, :-1][both], rows[:, 1:][both])
        at = np.arange(len(rows))
        while len(at):
            best = rank.argmin(1)
            line = np.arange(len(at))
            over = rank[line, best] == NEVER
            if over.any():
                yield at[over], rows[over]
                at, rows, rank, made, best = at[~over], rows[~over], rank[~over], made[~over], best[~over]
                line = line[: len(at)]
                if not len(at):
                    return
            rows[line, best] = made[line, best]
            keep = np.ones(rows.shape, bool)
            keep[line, best + 1] = False
            shape = (len(at), rows.shape[1] - 1)
            rows, rank, made = rows[keep].reshape(shape), rank[keep].reshape(shape), made[keep].reshape(shape)
            for side in (best - 1, best):  # the pairs on the left and on the right of the new symbol
                inside = (side >= 0) & (side + 1 < shape[1])
                line_i, side_i = line[inside], side[inside]
                left, right = rows[line_i, side_i], rows[line_i, side_i + 1]
                real_i = right >= 0
                r, m = np.full(len(left), NEVER, np.int32), np.full(len(left), -1, np.int32)
                r[real_i], m[real_i] = self._look(left[real_i], right[real_i])
                rank[line_i, side_i], made[line_i, side_i] = r, m
            at_end = best == shape[1] - 1
            rank[line[at_end], best[at_end]] = NEVER
