"""Bradley-Terry ranking learned from every pair of a good and a bad row, in passes over the rows.

The loss is the mean over all pairs of log(1 + exp(bad row's score - good
row's)), scores being linear in the features.  A pair enters only through its
two scores: so a pass sums the rows by score, in bins of ``1 / FINE``, and the
next one gives each row its slope against all rows of the other kind, whose
bins stand at their mean score.  That costs less than 1e-5 of a pair's
probability; no row and no pair is left out.  Newton steps take the curvature
from bins of ``COARSE / FINE``, which affects only how fast they converge.

Rows are blocks (features, times marked good, times marked bad): a list of
them, or a table made by ``pack``, over which a pass is one Spark job.  What
a task returns is bounded by the numbers of features and bins.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.runtime import map_arrow

#: Bins of a score's unit, and how many of them one bin of the curvature holds.
FINE, COARSE = 64, 16
#: Score bins that are compared with all others at a time.
AT_ONCE = 256

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def stacked(column: pa.Array) -> np.ndarray:
    """(rows, features) of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack(rows: DataFrame) -> DataFrame:
    """(features array<double>, good, bad) as a row of bytes for each Arrow batch, and its count ``n``."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = stacked(batch.column(0))
                good, bad = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in (x, good, bad)), pa.array([len(x)], pa.int64())], ["x", "good", "bad", "n"])

    return map_arrow(rows, run, "x binary, good binary, bad binary, n long")


def block(x: bytes, good: bytes, bad: bytes, n: int) -> Block:
    return np.frombuffer(x).reshape(n, -1), np.frombuffer(good), np.frombuffer(bad)


def over(rows: list[Block] | DataFrame, part: Callable, merge: Callable):
    """``part`` of every block, merged in their order; None without blocks."""
    if isinstance(rows, list):
        return functools.reduce(merge, (part(*b) for b in rows)) if rows else None

    def run(batches):
        found = None
        for batch in batches:
            for r in batch.to_pylist():
                p = part(*block(**r))
                found = p if found is None else merge(found, p)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    parts = [pickle.loads(r["part"]) for r in map_arrow(rows, run, "part binary").collect()]
    return functools.reduce(merge, parts) if parts else None


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, sums of their rows of ``values``)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(values[order], first, axis=0)


def _joined(a, b):
    return by_key(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def moments(rows: list[Block] | DataFrame, of: Callable[[np.ndarray], np.ndarray] = lambda x: x):
    """(times marked good, times marked bad, mean, variance) of ``of(features)``, a row counted as often as it is marked; None without rows."""

    def part(x, good, bad):
        y, m = of(x), good + bad
        mean = m @ y / m.sum()
        return good.sum(), bad.sum(), mean, m @ (y - mean) ** 2

    def merge(a, b):
        n, k = a[0] + a[1], b[0] + b[1]
        d = b[2] - a[2]
        return a[0] + b[0], a[1] + b[1], a[2] + d * (k / (n + k)), a[3] + b[3] + d * d * (n * k / (n + k))

    found = over(rows, part, merge)
    return found and (found[0], found[1], found[2], found[3] / (found[0] + found[1]))


def order_statistics(rows: list[Block] | DataFrame, of: Callable[[np.ndarray], np.ndarray], ranks: list[int]) -> list[float]:
    """The values of ``of(features)`` at these ranks (from 0, a row counted as often as it is marked): exact, by 16 bits a pass."""

    def ordered(v):
        bits = (v + 0.0).view(np.uint64)
        return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))

    sixteen = np.uint64(16)
    found = [(np.uint64(0), r) for r in ranks]
    for shift in (48, 32, 16, 0):
        open_ = np.unique([p for p, _ in found])

        def part(x, good, bad, shift=np.uint64(shift), open_=open_):
            k = ordered(of(x)) >> shift
            mine = np.isin(k >> sixteen, open_)
            return by_key(k[mine], (good + bad)[mine])

        keys, counts = over(rows, part, _joined)
        deeper = []
        for p, r in found:
            mine = keys >> sixteen == p
            upto = np.cumsum(counts[mine])
            i = int(np.searchsorted(upto, r, side="right"))
            deeper.append((keys[mine][i], r - (upto[i - 1] if i else 0)))
        found = deeper
    bits = np.array([p for p, _ in found], np.uint64)
    return np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(float).tolist()


def _logistic(d: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(d))
    return np.where(d >= 0, 1, e) / (1 + e)


def _bend(d: np.ndarray) -> np.ndarray:
    """The logistic function's slope."""
    e = np.exp(-np.abs(d))
    return e / (1 + e) ** 2


def _against(at: np.ndarray, others: tuple[np.ndarray, np.ndarray], kernel: Callable) -> np.ndarray:
    """For each score the sum of kernel(other score - score) over the others (scores, counts)."""
    m, n = others
    return np.concatenate([kernel(m - at[i : i + AT_ONCE, None]) @ n for i in range(0, len(at), AT_ONCE)])


def _bins(s: np.ndarray) -> np.ndarray:
    return np.floor(s * FINE).astype(np.int64)


def _by_score(rows, z: Callable, w: np.ndarray):
    """Of good and of bad rows: (bins that hold any, (times marked, sum of scores))."""

    def part(x, good, bad):
        s = z(x) @ w
        k = _bins(s)
        return tuple(by_key(k[m > 0], np.column_stack([m, m * s])[m > 0]) for m in (good, bad))

    return over(rows, part, lambda a, b: tuple(map(_joined, a, b)))


def _means(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums[:, 1] / sums[:, 0], sums[:, 0]


def loss(scores) -> float:
    """The mean over all pairs."""
    good, bad = (_means(sums) for _, sums in scores)
    return float(good[1] @ _against(good[0], bad, lambda d: np.logaddexp(0, d)) / (good[1].sum() * bad[1].sum()))


def _slopes(rows, z: Callable, w: np.ndarray, scores) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss over all pairs."""
    (good_bins, good_sums), (bad_bins, bad_sums) = scores
    pairs = good_sums[:, 0].sum() * bad_sums[:, 0].sum()
    low = (min(good_bins[0], bad_bins[0]) - 1) // COARSE * COARSE
    at = (np.arange(low, max(good_bins[-1], bad_bins[-1]) + 2) + 0.5) / FINE
    # of a good row at a score, and of a bad one: slope against the others, and how it changes with the score
    up, down = _against(at, _means(bad_sums), _logistic) / pairs, _against(at, _means(good_sums), lambda d: _logistic(-d)) / pairs
    up_change, down_change = -_against(at, _means(bad_sums), _bend) / pairs, _against(at, _means(good_sums), _bend) / pairs
    # the curvature's bins, where nothing lies at their middle
    n_wide = (len(at) - 1) // COARSE + 1
    count, middle = np.zeros((2, n_wide)), np.tile((np.arange(n_wide) + 0.5) * COARSE / FINE + low / FINE, (2, 1))
    for kind, (bins, sums) in enumerate(scores):
        k, wide = by_key((bins - low) // COARSE, sums)
        middle[kind, k], count[kind, k] = _means(wide)
    bend = _bend(middle[1] - middle[0][:, None]) / pairs
    bend_good, bend_bad = bend @ count[1], count[0] @ bend

    def part(x, good, bad):
        y = z(x)
        s = y @ w
        k = np.clip(_bins(s) - low, 0, len(at) - 1)
        off, wide = s - at[k], k // COARSE
        slope = bad * (down[k] + down_change[k] * off) - good * (up[k] + up_change[k] * off)
        own = (y * (good * bend_good[wide] + bad * bend_bad[wide])[:, None]).T @ y
        return slope @ y, own, *(by_key(wide[m > 0], (y * m[:, None])[m > 0]) for m in (good, bad))

    gradient, own, *sums = over(rows, part, lambda a, b: (a[0] + b[0], a[1] + b[1], _joined(a[2], b[2]), _joined(a[3], b[3])))
    (a, of_good), (b, of_bad) = sums
    cross = of_good.T @ bend[np.ix_(a, b)] @ of_bad
    return gradient, own - cross - cross.T


def learn(rows: list[Block] | DataFrame, z: Callable[[np.ndarray], np.ndarray], shrink: np.ndarray, steps: int, close: float) -> np.ndarray:
    """The weights of z(features) that minimise the loss over all pairs plus half of shrink * weights^2."""
    whole = lambda found, w: loss(found) + float(shrink @ (w * w)) / 2
    w = np.zeros(len(shrink))
    scores = _by_score(rows, z, w)
    value = whole(scores, w)
    for _ in range(steps):
        gradient, curvature = _slopes(rows, z, w, scores)
        gradient += shrink * w
        step = np.linalg.solve(curvature + np.diag(shrink), gradient)
        gain, length = float(gradient @ step), 1.0
        while True:
            new = w - length * step
            scores = _by_score(rows, z, new)
            new_value = whole(scores, new)
            # bins may cost the loss about 1e-6 of its change
            if new_value <= value - 1e-4 * length * gain + 1e-7 or length < 1e-4:
                break
            length /= 2
        w, value = new, new_value
        if gain < close:
            break
    return w
