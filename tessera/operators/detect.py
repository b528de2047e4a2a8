"""Detection: a template box is scanned over a grid of poses, scored on what the volume holds there, refined and mined.

A detector is a template (sides and bottom), the counts of a sample's cells
and linear weights (feature, wt) with a bias.  Poses are numbered, and the
number is the box's id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import boxes as b
from tessera.operators import learn as n
from tessera.operators import volume as v
from tessera.plans.components import settle


@dataclass(frozen=True)
class Scan:
    """A grid of poses: ranges in the plane, and steps in x, y and angle (all of a turn)."""

    x: tuple[float, float]
    y: tuple[float, float]
    steps: tuple[float, float, float]

    @property
    def counts(self) -> tuple[int, int, int]:
        spans = (self.x[1] - self.x[0], self.y[1] - self.y[0], 2 * math.pi - 1e-5)
        return tuple(math.ceil(s / d) for s, d in zip(spans, self.steps, strict=True))

    def number(self, ix: Column, iy: Column, ia: Column) -> Column:
        _, ny, na = self.counts
        return (ix.cast("long") * ny + iy) * na + ia

    def place(self, number: Column) -> tuple[Column, Column, Column]:
        """Grid places of a pose's number."""
        _, ny, na = self.counts
        return F.floor(number / (ny * na)).cast("int"), F.pmod(F.floor(number / na), F.lit(ny)).cast("int"), F.pmod(number, F.lit(na)).cast("int")

    def pose(self, ix: Column, iy: Column, ia: Column) -> tuple[Column, Column, Column]:
        return self.x[0] + ix * self.steps[0], self.y[0] + iy * self.steps[1], ia * self.steps[2]

    def nearest(self, x: Column, y: Column, angle: Column) -> tuple[Column, Column, Column]:
        """The grid places next to a pose; the last angle's other side is angle 0."""
        near = lambda p, low, step: F.round((p - low) / step).cast("int")
        return near(x, self.x[0], self.steps[0]), near(y, self.y[0], self.steps[1]), F.pmod(near(g.wrap_positive(angle), 0.0, self.steps[2]), F.lit(self.counts[2])).cast("int")

    def boxes(self, spark, template: tuple[float, float, float], bottom: float = 0.0, category: int = 0) -> DataFrame:
        """A box of the template's sides at every pose; its id is the pose's number."""
        nx, ny, na = self.counts
        ix, iy, ia = self.place(F.col("id"))
        x, y, angle = self.pose(ix, iy, ia)
        sides = [F.lit(float(s)).alias(c) for s, c in zip(template, ("lx", "ly", "lz"), strict=True)]
        return spark.range(nx * ny * na).select(F.col("id").alias("obb_id"), F.lit(category).alias("category"), x.alias("cx"), y.alias("cy"), F.lit(float(bottom)).alias("bz"), *sides, angle.alias("theta"))


@dataclass(frozen=True)
class Detector:
    template: tuple[float, float, float]
    cells: tuple[int, int, int]
    bias: float = 0.0
    bottom: float = 0.0
    least_occupied: float = 0.5
    least_score: float = 0.0


def sample_cells(voxels: DataFrame, boxes: DataFrame, detector: Detector) -> DataFrame:
    """(sample, idx, val, w): what the volume holds in the cells of each box."""
    _, ny, nz = detector.cells
    s = v.resample_box(voxels, boxes, detector.cells)
    return s.select(F.col("obb_id").alias("sample"), g.flat_index(F.col("ix"), F.col("iy"), F.col("iz"), ny, nz).cast("int").alias("idx"), F.col("d").alias("val"), "w")


def score(voxels: DataFrame, boxes: DataFrame, weights: DataFrame, detector: Detector) -> DataFrame:
    """(.., score): the boxes that enough of is observed, with their scores."""
    cells = sample_cells(voxels, boxes, detector)
    good = n.occupied_ratio(cells, math.prod(detector.cells)).filter(F.col("ratio") >= detector.least_occupied)
    scored = n.linear_score(n.feature_rows(cells.join(good, "sample", "left_semi")), weights, detector.bias)
    return boxes.join(scored.select(F.col("sample").alias("obb_id"), "score"), "obb_id")


def detect(voxels: DataFrame, scan: Scan, weights: DataFrame, detector: Detector, suppress: bool = True, threshold: float = 0.05, category: int = 0) -> DataFrame:
    """Boxes with a score above the least, all poses scored side by side.

    With ``suppress`` each angle's boxes are thinned out among themselves, and
    what is left of all angles together.
    """
    poses = scan.boxes(voxels.sparkSession, detector.template, detector.bottom, category)
    found = score(voxels, poses, weights, detector).filter(F.col("score") > detector.least_score)
    if not suppress:
        return found
    found = settle(found, "detections")
    kept = settle(b.suppress(found, b.nms_same_angle_pairs(found, threshold)), "angle-detections")
    return b.suppress(kept, b.nms_pairs(kept, threshold))


def _best(boxes: DataFrame, tried: DataFrame, voxels: DataFrame, weights: DataFrame, detector: Detector) -> DataFrame:
    """The boxes, moved to the best of their tried poses (.., home, k) where it scores higher than the box did."""
    numbered = settle(tried.withColumn("obb_id", F.col("home") * 100_000 + F.col("k")), "tried")
    best = b.refine(score(voxels, numbered, weights, detector), "home")
    moved = [*b.GEOMETRY, "score"]
    better = best.select(F.col("home").alias("obb_id"), *[F.col(c).alias(f"n_{c}") for c in moved])
    out = boxes.join(better, "obb_id", "left").withColumn("up", F.coalesce(F.col("n_score") > F.col("score"), F.lit(False)))
    return out.select("obb_id", "category", *[F.when(F.col("up"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in moved])


def refine_positions(voxels: DataFrame, boxes: DataFrame, scan: Scan, weights: DataFrame, detector: Detector, steps: int = 4) -> DataFrame:
    """The boxes at the best of (2 steps + 1)^3 poses around them, a quarter of the scan's steps apart for steps = 4."""
    out, side = boxes.drop("score").withColumnRenamed("obb_id", "home"), 2 * steps + 1
    for c, step in zip(("cx", "cy", "theta"), scan.steps, strict=True):
        out = out.withColumn(f"k{c}", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn(c, F.col(c) + F.col(f"k{c}") * (step / steps))
    k = ((F.col("kcx") + steps) * side + F.col("kcy") + steps) * side + F.col("ktheta") + steps
    return _best(boxes, out.withColumn("k", k).drop("kcx", "kcy", "ktheta"), voxels, weights, detector)


def refine_scales(voxels: DataFrame, boxes: DataFrame, low: float, high: float, weights: DataFrame, detector: Detector, step: float = 0.05) -> DataFrame:
    """The boxes with the best of the scaled sides between low and high, in steps of 5 per cent on each axis; the bottom centre stays."""
    out, m = boxes.drop("score").withColumnRenamed("obb_id", "home").withColumn("k", F.lit(0)), round((high - low) / step)
    for c in ("lx", "ly", "lz"):
        out = out.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(m)))).withColumns({c: F.col(c) * (low + F.col("s") * step), "k": F.col("k") * (m + 1) + F.col("s")})
    return _best(boxes, out.drop("s"), voxels, weights, detector)


def mine(voxels: DataFrame, scan: Scan, weights: DataFrame, detector: Detector, positives: DataFrame, negatives: DataFrame, most: int, overlap: float = 0.3) -> tuple[DataFrame, bool]:
    """(negatives, any new): detections on no positive box join the known negatives; the ``most`` highest scores are kept."""
    found = settle(detect(voxels, scan, weights, detector, suppress=False), "mined")
    wrong = b.unmatched(found, b.best_match(found, positives), overlap).join(negatives.select("obb_id"), "obb_id", "left_anti")
    wrong = settle(wrong, "hard-negatives")
    both = negatives.select(wrong.columns).unionByName(wrong)
    return settle(both.orderBy(F.desc("score"), "obb_id").limit(most), "negatives"), wrong.limit(1).count() > 0


def train(voxels: DataFrame, scan: Scan, detector: Detector, positives: DataFrame, negatives: DataFrame, rounds: int = 3, most: int = 2000, steps: int = 30) -> tuple[DataFrame, float, DataFrame]:
    """(weights, bias, negatives): trained on the boxes, then again with the hard negatives of each round, until a round finds none."""
    from dataclasses import replace

    negatives = negatives if "score" in negatives.columns else negatives.withColumn("score", F.lit(0.0))
    for left in range(rounds, -1, -1):
        marked = positives.select("obb_id", *b.GEOMETRY, F.lit(1).alias("y")).unionByName(negatives.select((-F.col("obb_id") - 1).alias("obb_id"), *b.GEOMETRY, F.lit(-1).alias("y")))
        marked = settle(marked, "marked")
        features = settle(n.feature_rows(sample_cells(voxels, marked, detector)), "features")
        weights, bias = n.train_linear(features, marked.select(F.col("obb_id").alias("sample"), "y"), rounds=steps)
        if not left:
            break
        negatives, more = mine(voxels, scan, weights, replace(detector, bias=bias, least_score=-1.0), positives, negatives, most)
        if not more:
            break
    return weights, bias, negatives


def cross_validate(features: DataFrame, labels: DataFrame, folds: int = 3, steps: int = 30) -> DataFrame:
    """(fold, n, accuracy, mse): a classifier trained on the other folds, tried on each; a sample's fold is its number modulo ``folds``."""
    out = None
    part = F.pmod(F.col("sample"), F.lit(folds))
    for k in range(folds):
        weights, bias = n.train_linear(features.filter(part != k), labels.filter(part != k), rounds=steps)
        tried = n.linear_score(features.filter(part == k), weights, bias).join(labels, "sample")
        row = tried.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("mse"))
        out = row if out is None else out.unionByName(row)
    return out


def squared_correlation(pairs: DataFrame, a: str, b_: str) -> DataFrame:
    """One row: n, mean squared error and r squared of two columns."""
    x, y = F.col(a).cast("double"), F.col(b_).cast("double")
    return pairs.agg(F.count("*").alias("n"), F.avg((x - y) * (x - y)).alias("mse"), F.pow(F.corr(x, y), 2).alias("r2"))


def cluster_members(assignment: DataFrame, outliers: DataFrame) -> DataFrame:
    """(cluster, place, sample): the samples of each cluster, in order, without the outliers."""
    kept = assignment.join(outliers.select("sample"), "sample", "left_anti")
    return kept.select("cluster", (F.row_number().over(W.partitionBy("cluster").orderBy("sample")) - 1).alias("place"), "sample")


def mean_sides(boxes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster, lx, ly, lz): the mean sides of each cluster's boxes."""
    return boxes.join(assignment.select(F.col("sample").alias("obb_id"), "cluster"), "obb_id").groupBy("cluster").agg(*[F.avg(c).alias(c) for c in ("lx", "ly", "lz")])


def major_box(voxels: DataFrame, label: int, angle: float, size: int, share: float) -> DataFrame:
    """(cx, cy, bz, lx, ly, lz, theta): the smallest box of an angle that holds a share of a label's voxels in the plane.

    The turned voxels are counted in bins of ``size`` voxels; the smallest
    rectangle of bins with the share is the footprint, and the box has the
    height of all of the label's voxels.
    """
    u, t = g.rotated(F.col("vx").cast("double"), F.col("vy").cast("double"), F.lit(angle))
    own = voxels.filter((F.col("w") > 0) & (F.col("label") == label)).select(u.alias("u"), t.alias("t"), "vz")
    at = own.agg(F.count("*").alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("vz").alias("z0"), F.max("vz").alias("z1")).first()
    if not at["n"]:
        return voxels.sparkSession.createDataFrame([], "cx double, cy double, bz double, lx double, ly double, lz double, theta double")
    bin_ = lambda c, low: F.floor((F.col(c) - low) / size).cast("int")
    hist = own.groupBy(bin_("u", at["u0"]).alias("hx"), bin_("t", at["t0"]).alias("hy")).agg(F.count("*").alias("n"))
    nx, ny = int((at["u1"] - at["u0"]) // size) + 1, int((at["t1"] - at["t0"]) // size) + 1
    rect = v.smallest_rectangle(v.integral2d(hist, nx, ny), max(1, math.ceil(share * at["n"])))
    lx, ly = (F.col("x1") - F.col("x0") + 1) * float(size), (F.col("y1") - F.col("y0") + 1) * float(size)
    cu, ct = at["u0"] + F.col("x0") * size + lx / 2, at["t0"] + F.col("y0") * size + ly / 2
    x, y = g.turned(cu, ct, F.lit(angle))
    return rect.select(x.alias("cx"), y.alias("cy"), F.lit(float(at["z0"])).alias("bz"), lx.alias("lx"), ly.alias("ly"), F.lit(float(at["z1"] - at["z0"])).alias("lz"), F.lit(angle).alias("theta"))
