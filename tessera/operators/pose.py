"""Poses and sides of boxes, fitted so that what the volume holds in a box is what its cluster's model says."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import volume as v
from tessera.plans.components import settle

PARAMETERS = ["theta", "cx", "cy", "lx", "ly", "lz"]


def _cells(boxes: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """Each box's cells (pid, u, v, t: shares of the sides; px, py, pz: places)."""
    nx, ny, nz = counts
    out = boxes
    for c, n in zip("xyz", counts, strict=True):
        out = out.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    share = lambda c, n, low: F.col(f"i{c}") / max(1, n - 1) - low
    out = out.withColumns({"u": share("x", nx, 0.5), "v": share("y", ny, 0.5), "t": share("z", nz, 0.0), "idx": g.flat_index(F.col("ix"), F.col("iy"), F.col("iz"), ny, nz).cast("int")})
    x, y = g.turned(F.col("u") * F.col("lx"), F.col("v") * F.col("ly"), F.col("theta"))
    return out.withColumns({"px": F.col("cx") + x, "py": F.col("cy") + y, "pz": F.col("bz") + F.col("t") * F.col("lz"), "pid": F.struct("obb_id", "idx")})


def equations(voxels: DataFrame, boxes: DataFrame, model: DataFrame, counts: tuple[int, int, int], observation: float, max_weight: float = v.MAX_WEIGHT) -> DataFrame:
    """(obb_id, error, a.., b..): each box's error and the normal equations of its six parameters.

    model: (cluster, idx, mean).  The error is the sum of w (value - mean)^2
    over the observed cells, and ``observation`` * (max_weight - w) over all;
    a cell's slope is the volume's gradient times how the cell moves.
    """
    cells = settle(_cells(boxes, counts).select("pid", "obb_id", "cluster", "idx", "u", "v", "t", "px", "py", "pz", "theta", "cx", "cy"), "pose-cells")
    points = cells.select("pid", "px", "py", "pz")
    value = v.trilinear(points, voxels)
    slope = v.gradient(points, voxels)
    met = cells.join(value, "pid", "left").join(slope, "pid", "left").join(model, ["cluster", "idx"], "left")
    c, s = F.cos("theta"), F.sin("theta")
    moves = {
        "theta": F.col("gx") * (F.col("cy") - F.col("py")) + F.col("gy") * (F.col("px") - F.col("cx")),
        "cx": F.col("gx"),
        "cy": F.col("gy"),
        "lx": F.col("u") * (F.col("gx") * c + F.col("gy") * s),
        "ly": F.col("v") * (F.col("gy") * c - F.col("gx") * s),
        "lz": F.col("t") * F.col("gz"),
    }
    rows = met.select("obb_id", F.coalesce("w", F.lit(0.0)).alias("w"), (F.col("d") - F.col("mean")).alias("r"), *[F.coalesce(m, F.lit(0.0)).alias(f"j_{k}") for k, m in moves.items()])
    weight, r = F.col("w"), F.coalesce("r", F.lit(0.0))
    pairs = [(p, q) for i, p in enumerate(PARAMETERS) for q in PARAMETERS[i:]]
    return rows.groupBy("obb_id").agg(
        (F.sum(weight * r * r) + observation * F.sum(F.greatest(F.lit(0.0), max_weight - weight))).alias("error"),
        *[F.sum(weight * F.col(f"j_{p}") * F.col(f"j_{q}")).alias(f"a_{p}_{q}") for p, q in pairs],
        *[F.sum(weight * F.col(f"j_{p}") * r).alias(f"b_{p}") for p in PARAMETERS],
    )


def _solve(pdf: pd.DataFrame, damping: float, alike: float) -> pd.DataFrame:
    n = len(PARAMETERS)
    a, b = np.zeros((len(pdf), n, n)), np.zeros((len(pdf), n))
    for i, p in enumerate(PARAMETERS):
        b[:, i] = pdf[f"b_{p}"]
        for j in range(i, n):
            a[:, i, j] = a[:, j, i] = pdf[f"a_{p}_{PARAMETERS[j]}"]
    for i, p in enumerate(PARAMETERS[3:], 3):  # sides like the cluster's
        a[:, i, i] += alike
        b[:, i] += alike * (pdf[p] - pdf[f"m_{p}"]).to_numpy()
    a += np.eye(n) * (damping * (1 + np.einsum("kii->ki", a)))[:, None, :]
    out = pdf[["obb_id", "cluster", "category", "score", "bz", *PARAMETERS]].copy()
    out[PARAMETERS] = pdf[PARAMETERS].to_numpy() - np.linalg.solve(a, b[:, :, None])[:, :, 0]
    out[PARAMETERS[3:]] = np.maximum(out[PARAMETERS[3:]], 0.01)
    return out


def refine(voxels: DataFrame, boxes: DataFrame, model: DataFrame, counts: tuple[int, int, int], rounds: int = 8, damping: float = 1e-3, alike: float = 0.1, observation: float = 0.01) -> DataFrame:
    """(.., error): boxes (.., cluster) at the poses and sides of the least error that damped Gauss-Newton steps pass.

    All boxes step side by side: a round is one join of cells with the volume,
    27 sums a box, and a 6 x 6 system solved for each.  The boxes of a cluster
    are held together by the spread of their sides.
    """
    kind = "obb_id long, cluster int, category int, score double, bz double, " + ", ".join(f"{p} double" for p in PARAMETERS)
    columns = ["obb_id", "cluster", "category", "score", "bz", *PARAMETERS]
    now, best = settle(boxes.select(*columns), "poses"), None
    for left in range(rounds, -1, -1):
        stepped = equations(voxels, now, model, counts, observation).join(now, "obb_id")
        tried = settle(stepped, "pose-equations")
        seen = tried.select(*columns, "error")
        best = seen if best is None else best.unionByName(seen)
        if left:
            means = tried.groupBy("cluster").agg(*[F.avg(p).alias(f"m_{p}") for p in PARAMETERS[3:]])
            now = settle(tried.join(means, "cluster").mapInPandas(lambda parts: (_solve(p, damping, alike) for p in parts if len(p)), kind), "poses")
    chosen = best.groupBy("obb_id").agg(F.min_by(F.struct(*columns[1:], "error"), "error").alias("b"))
    return chosen.select("obb_id", "b.*")
