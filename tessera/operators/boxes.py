"""Oriented boxes: geometry, overlap joins, matching and suppression.

A box is (obb_id, category, score, cx, cy, bz, lx, ly, lz, theta): centre in
the plane, bottom, side lengths, turn about z.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g

GEOMETRY = ["cx", "cy", "bz", "lx", "ly", "lz", "theta"]


def corners(boxes: DataFrame) -> DataFrame:
    """(obb_id, k, x, y, z): the eight corners, k counting x, then y, then z."""
    signs = F.posexplode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for z in (0.0, 1.0) for y in (-0.5, 0.5) for x in (-0.5, 0.5)]))
    b = boxes.select("*", signs.alias("k", "s"))
    x, y = g.turned(F.col("s.x") * F.col("lx"), F.col("s.y") * F.col("ly"), F.col("theta"))
    return b.select("obb_id", "k", (F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y"), (F.col("bz") + F.col("s.z") * F.col("lz")).alias("z"))


def affine(boxes: DataFrame) -> DataFrame:
    """(obb_id, m): row-major 3 x 4 map from the unit box (x, y in [-.5, .5], z in [0, 1])."""
    c, s = F.cos("theta"), F.sin("theta")
    zero = F.lit(0.0)
    return boxes.select("obb_id", F.array(c * F.col("lx"), -s * F.col("ly"), zero, F.col("cx"), s * F.col("lx"), c * F.col("ly"), zero, F.col("cy"), zero, zero, F.col("lz"), F.col("bz")).alias("m"))


def from_affine(maps: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Boxes back from (obb_id, m); maps whose turn isn't orthonormal within the tolerance raise."""
    m = F.col("m")
    lx, ly = F.sqrt(m[0] * m[0] + m[4] * m[4] + m[8] * m[8]), F.sqrt(m[1] * m[1] + m[5] * m[5] + m[9] * m[9])
    dot = F.abs(m[0] * m[1] + m[4] * m[5] + m[8] * m[9]) / (lx * ly)
    checked = F.when(F.assert_true(dot < tolerance, F.lit("a box map isn't orthogonal")).isNull(), F.atan2(m[4], m[0]))
    return maps.select("obb_id", m[3].alias("cx"), m[7].alias("cy"), m[11].alias("bz"), lx.alias("lx"), ly.alias("ly"), m[10].alias("lz"), checked.alias("theta"))


def extend(boxes: DataFrame, x: float = 0.0, y: float = 0.0, z: float = 0.0) -> DataFrame:
    """Sides grow by x and y on either side, and upwards by z."""
    return boxes.withColumns({"lx": F.col("lx") + 2 * x, "ly": F.col("ly") + 2 * y, "lz": F.col("lz") + z})


def extend_share(boxes: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """As ``extend``, in shares of the sides."""
    return boxes.withColumns({"lx": F.col("lx") * (1 + 2 * x), "ly": F.col("ly") * (1 + 2 * y), "lz": F.col("lz") * (1 + z)})


def from_centres(boxes: DataFrame, counts: tuple[int, int, int], bottom: bool = False) -> DataFrame:
    """(obb_id, offset, orientation, sides, voxel_lengths) of boxes: the corner they start from, their turn, and the length of a cell.

    The centre is that of the box, or with ``bottom`` that of its bottom.
    """
    c, s = F.cos("theta"), F.sin("theta")
    zero, one = F.lit(0.0), F.lit(1.0)
    x, y = g.turned(-F.col("lx") / 2, -F.col("ly") / 2, F.col("theta"))
    z = F.col("bz") if bottom else F.col("bz") - F.col("lz") / 2
    cells = [F.col(k) / (n - 1) for k, n in zip(("lx", "ly", "lz"), counts, strict=True)]
    return boxes.select("obb_id", F.array(F.col("cx") + x, F.col("cy") + y, z).alias("offset"), F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("orientation"), F.array("lx", "ly", "lz").alias("sides"), F.array(*cells).alias("voxel_lengths"))


def rescale(boxes: DataFrame, x: float, y: float, z: float, keep_bottom: bool = False) -> DataFrame:
    """Sides times factors about the centre, or with ``keep_bottom`` about the bottom's centre."""
    out = boxes.withColumns({"lx": F.col("lx") * x, "ly": F.col("ly") * y, "lz": F.col("lz") * z})
    return out if keep_bottom else out.withColumn("bz", F.col("bz") - F.col("lz") * ((z - 1) / (2 * z)))


def rotated_axes(boxes: DataFrame) -> DataFrame:
    """(obb_id, centre, axes, half): boxes in general form, axes the rows of a 3 x 3 turn."""
    c, s = F.cos("theta"), F.sin("theta")
    zero, one = F.lit(0.0), F.lit(1.0)
    return boxes.select("obb_id", F.array("cx", "cy", F.col("bz") + F.col("lz") / 2).alias("centre"), F.array(c, s, zero, -s, c, zero, zero, zero, one).alias("axes"), F.array(F.col("lx") / 2, F.col("ly") / 2, F.col("lz") / 2).alias("half"))


def cosines(angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines by the C library, as SQL engines have them: the JVM's differ in the last bit for some angles, and at ties that decides."""
    known, at = np.unique(angles, return_inverse=True)
    return tuple(np.array([f(x) if math.isfinite(x) else math.nan for x in known])[at] for f in (math.cos, math.sin))


def _flat_form(box: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, axes and half sides of boxes turned about z, as ``rotated_axes`` has them."""
    c, s, zero, one = np.cos(box["theta"]), np.sin(box["theta"]), np.zeros(len(box["theta"])), np.ones(len(box["theta"]))
    return np.stack([box["cx"], box["cy"], box["bz"] + box["lz"] / 2]), np.stack([c, s, zero, -s, c, zero, zero, zero, one]), np.stack([box["lx"], box["ly"], box["lz"]]) / 2


def _flat_touch(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Do boxes turned about z touch? Term by term as ``touch_3d`` is written, so that ties fall as they do in SQL."""
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    c, s = (np.abs(v) for v in cosines(b["theta"] - a["theta"]))
    out = (a["bz"] <= b["bz"] + b["lz"]) & (b["bz"] <= a["bz"] + a["lz"])
    for o, p in ((a, b), (b, a)):
        co, si = cosines(o["theta"])
        out &= (np.abs(dx * co + dy * si) <= (o["lx"] + p["lx"] * c + p["ly"] * s) / 2) & (np.abs(dy * co - dx * si) <= (o["ly"] + p["lx"] * s + p["ly"] * c) / 2)
    return out


def touch_general(pairs: DataFrame, epsilon: float = 1e-9, flat: bool = False) -> DataFrame:
    """Pairs (a_centre, a_axes, a_half, b_..) of boxes turned in any way that touch: none of the fifteen axes parts them.

    Pairs within ``epsilon`` of touching touch.  flat: pairs (a_cx, .., a_theta,
    b_..) of boxes turned about z, of which those within epsilon of touching
    are decided exactly.
    """
    parts = GEOMETRY if flat else ["centre", "axes", "half"]
    names = [f"{t}_{c}" for t in "ab" for c in parts]

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in names]
            if flat:
                flats = [dict(zip(GEOMETRY, (c.to_numpy(zero_copy_only=False).astype(float) for c in columns[k : k + len(GEOMETRY)]), strict=True)) for k in (0, len(GEOMETRY))]
                ca, ua, ea, cb, ub, eb = (v for box in flats for v in _flat_form(box))
            else:
                ca, ua, ea, cb, ub, eb = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T for c in columns)
            r = [[sum(ua[3 * i + k] * ub[3 * j + k] for k in range(3)) for j in range(3)] for i in range(3)]
            t = [sum((cb[k] - ca[k]) * ua[3 * i + k] for k in range(3)) for i in range(3)]
            bent = [[np.abs(r[i][j]) + epsilon for j in range(3)] for i in range(3)]
            whole, slack = np.ones(batch.num_rows, bool), np.full(batch.num_rows, np.inf)
            for i in range(3):
                gap = ea[i] + sum(eb[j] * bent[i][j] for j in range(3)) - np.abs(t[i])
                whole, slack = whole & (gap >= 0), np.minimum(slack, gap)
            for j in range(3):
                gap = eb[j] + sum(ea[i] * bent[i][j] for i in range(3)) - np.abs(sum(t[i] * r[i][j] for i in range(3)))
                whole, slack = whole & (gap >= 0), np.minimum(slack, gap)
            for i in range(3):
                i1, i2 = (i + 1) % 3, (i + 2) % 3
                for j in range(3):
                    j1, j2 = (j + 1) % 3, (j + 2) % 3
                    reach = ea[i1] * bent[i2][j] + ea[i2] * bent[i1][j] + eb[j1] * bent[i][j2] + eb[j2] * bent[i][j1]
                    whole &= np.abs(t[i2] * r[i1][j] - t[i1] * r[i2][j]) <= reach
            if flat:
                near = np.flatnonzero(whole & (slack <= 2 * epsilon * (1 + sum(ea) + sum(eb))))
                whole[near] = _flat_touch(*[{c: v[near] for c, v in box.items()} for box in flats])
            yield batch.filter(pa.array(whole))

    # a pair without one of the two boxes touches nowhere
    return pairs.dropna(subset=names).mapInArrow(run, pairs.schema)


def volume() -> Column:
    return F.col("lx") * F.col("ly") * F.col("lz")


def _radius(t: str) -> Column:
    return F.sqrt(F.col(f"{t}lx") * F.col(f"{t}lx") + F.col(f"{t}ly") * F.col(f"{t}ly")) / 2


#: Rows of the right side that are sent to every executor (of some hundred bytes each); beyond them both sides are shuffled.
SENT = 100_000


def candidate_pairs(left: DataFrame, right: DataFrame, cell: float = 8.0) -> DataFrame:
    """Pairs (a_*, b_*) whose bounding circles touch: a range join by grid cells.

    A box is put into every cell that its circle's square touches; boxes meet
    in cells by equi-join, and a pair is kept in the one cell that holds the
    lower corner of the two squares' intersection, so that none comes twice.
    The left boxes of a cell are dealt over tasks, however many it holds: the
    right ones go to all of them, or to each share of the left ones.
    """
    spark = left.sparkSession
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = right.count()
    shares = max(1, -(-rows // SENT))
    sides = []
    for df, t in ((left, "a_"), (right, "b_")):
        b = df.select(*[F.col(c).alias(t + c) for c in df.columns])
        if t == "a_":
            b = b.repartition(4 * parallel, "a_obb_id")
        rad = _radius(t)
        low = [F.floor((F.col(f"{t}c{c}") - rad) / cell).cast("int") for c in "xy"]
        high = [F.floor((F.col(f"{t}c{c}") + rad) / cell).cast("int") for c in "xy"]
        b = b.withColumns({f"{t}x0": low[0], f"{t}y0": low[1], "kx": F.explode(F.sequence(low[0], high[0]))})
        b = b.withColumn("ky", F.explode(F.sequence(low[1], high[1])))
        share = F.pmod(F.xxhash64("a_obb_id"), F.lit(shares)).cast("int") if t == "a_" else F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
        sides.append(b.withColumn("share", share) if shares > 1 else b)
    key = ["kx", "ky", "share"] if shares > 1 else ["kx", "ky"]
    other = sides[1] if shares > 1 else F.broadcast(sides[1])
    met = sides[0].join(other, key).filter((F.col("kx") == F.greatest("a_x0", "b_x0")) & (F.col("ky") == F.greatest("a_y0", "b_y0")))
    dx, dy = F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")
    reach = _radius("a_") + _radius("b_")
    return met.filter(dx * dx + dy * dy <= reach * reach).drop(*key, "a_x0", "a_y0", "b_x0", "b_y0")


def touch_2d() -> Column:
    """Separating axes of the footprints of a_* and b_*: no axis of either parts them."""
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    turn = F.col("b_theta") - F.col("a_theta")
    c, s = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    out = F.lit(True)
    for own, other in (("a_", "b_"), ("b_", "a_")):
        u, v = g.rotated(dx, dy, F.col(f"{own}theta"))
        out = out & (F.abs(u) <= (F.col(f"{own}lx") + F.col(f"{other}lx") * c + F.col(f"{other}ly") * s) / 2) & (F.abs(v) <= (F.col(f"{own}ly") + F.col(f"{other}lx") * s + F.col(f"{other}ly") * c) / 2)
    return out


def touch_3d() -> Column:
    """Boxes turned about z only: the footprints touch and the heights overlap."""
    return touch_2d() & (F.col("a_bz") <= F.col("b_bz") + F.col("b_lz")) & (F.col("b_bz") <= F.col("a_bz") + F.col("a_lz"))


def overlaps(left: DataFrame, right: DataFrame, three: bool = True, cell: float = 8.0) -> DataFrame:
    """The pairs that touch."""
    return candidate_pairs(left, right, cell).filter(touch_3d() if three else touch_2d())


def _share_inside(a: dict[str, np.ndarray], o: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Share of an n^3 grid over each box a (faces included) that lies in its box o.

    Along a line of the footprint's grid both coordinates in o are linear, so
    the points inside are the whole numbers of an interval; the height is the
    same for all of them and is counted once.
    """
    eps = 1e-9
    turn = a["theta"] - o["theta"]
    c, s = np.cos(turn), np.sin(turn)
    dx, dy = a["cx"] - o["cx"], a["cy"] - o["cy"]
    oc, os_ = np.cos(o["theta"]), np.sin(o["theta"])
    du, dv = dx * oc + dy * os_, dy * oc - dx * os_
    x = (np.arange(n) / (n - 1) - 0.5) * a["lx"][:, None]
    low, high = np.zeros(x.shape), np.full(x.shape, n - 1.0)
    for across, along, shift, side in ((c, -s, du, o["lx"]), (s, c, dv, o["ly"])):
        start = x * across[:, None] + (shift - 0.5 * a["ly"] * along)[:, None]
        step = (a["ly"] * along / (n - 1))[:, None]
        half = (side / 2 + eps)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (-half - start) / step, (half - start) / step
        still = step == 0
        here = np.abs(start) <= half
        first, last = np.where(still, np.where(here, -np.inf, np.inf), np.minimum(p, q)), np.where(still, np.where(here, np.inf, -np.inf), np.maximum(p, q))
        low, high = np.maximum(low, first), np.minimum(high, last)
    flat = np.maximum(0.0, np.floor(np.maximum(high, -1.0)) - np.ceil(np.minimum(low, float(n))) + 1).sum(1)
    z = a["bz"][:, None] + np.arange(n) / (n - 1) * a["lz"][:, None]
    height = ((z >= (o["bz"] - eps)[:, None]) & (z <= (o["bz"] + o["lz"] + eps)[:, None])).sum(1)
    return flat * height / float(n**3)


def iou(pairs: DataFrame, n: int = 31) -> DataFrame:
    """pairs with a_in_b and b_in_a (shares of an n^3 grid over one box in the other), inter (mean of both estimates of the shared volume) and iou."""
    kept = pairs.select(*[c for c in pairs.columns if c[:2] in ("a_", "b_")])
    made = ["a_in_b", "b_in_a", "inter", "iou"]
    names = [*kept.columns, *made]

    def run(batches):
        for batch in batches:
            a, o = ({c: batch.column(f"{t}_{c}").to_numpy(zero_copy_only=False).astype(float) for c in GEOMETRY} for t in "ab")
            there, back = _share_inside(a, o, n), _share_inside(o, a, n)
            va, vb = (box["lx"] * box["ly"] * box["lz"] for box in (a, o))
            inter = (there * va + back * vb) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                share = inter / (va + vb - inter)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in (there, back, inter, share)]], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*kinds, *[f"{c} double" for c in made]]))


def _bare(pairs: DataFrame) -> DataFrame:
    """Ids and geometry of the pairs: what their shared volume needs."""
    return pairs.select(*[f"{t}_{c}" for t in "ab" for c in ("obb_id", *GEOMETRY)])


def similarity(pairs: DataFrame, n: int = 31) -> DataFrame:
    """pairs that touch in the plane and turn by less than 45 degrees, with similarity = iou * cos(turn)."""
    c = F.cos(F.col("a_theta") - F.col("b_theta"))
    near = pairs.filter(touch_2d() & (c >= np.sqrt(0.5)))
    return iou(near, n).withColumn("similarity", F.col("iou") * F.cos(F.col("a_theta") - F.col("b_theta")))


def best_match(detections: DataFrame, truth: DataFrame, n: int = 31) -> DataFrame:
    """(a_obb_id, b_obb_id, similarity): the most similar true box of each detection; of equals the smallest id."""
    met = similarity(_bare(candidate_pairs(detections, truth)), n).filter("similarity > 0")
    best = met.groupBy("a_obb_id").agg(F.max_by(F.struct("b_obb_id", "similarity"), F.struct("similarity", (-F.col("b_obb_id")).alias("o"))).alias("m"))
    return best.select("a_obb_id", "m.b_obb_id", "m.similarity")


def unmatched(detections: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """Detections without a true box above the threshold."""
    good = matches.filter(F.col("similarity") > threshold).select(F.col("a_obb_id").alias("obb_id"))
    return detections.join(good, "obb_id", "left_anti")


def _greedy(pairs: list[tuple[int, int]], order: list[int]) -> set[int]:
    """The kept ones: each, in order, unless an earlier kept one suppresses it."""
    beats: dict[int, list[int]] = {}
    for a, b in pairs:
        beats.setdefault(a, []).append(b)
    kept, gone = set(), set()
    for i in order:
        if i not in gone:
            kept.add(i)
            gone.update(beats.get(i, ()))
    return kept


#: Pairs that are walked component by component; more are thinned out first.
WALKED = 500_000
#: Rounds of thinning at most: long chains are walked.
ROUNDS = 30


def _thinned(pairs: DataFrame, walked: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs that are open still, boxes (b) found suppressed): a box that no open pair suppresses is kept, and suppresses its own."""
    from tessera.plans.components import settle

    left, gone = settle(pairs.select("a", "b"), "suppressions"), None
    for _ in range(ROUNDS):
        if left.count() <= walked:
            break
        heads = settle(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "heads")
        lost = settle(left.join(heads, "a", "left_semi").select("b").distinct(), "suppressed")
        decided = heads.unionByName(lost.select(F.col("b").alias("a")))
        gone = lost if gone is None else gone.unionByName(lost)
        left = settle(left.join(decided, "a", "left_anti").join(lost, "b", "left_anti").select("a", "b"), "suppressions")
    return left, gone


def suppress(boxes: DataFrame, pairs: DataFrame, walked: int = WALKED) -> DataFrame:
    """Greedy non-maximum suppression: boxes in order of (score descending, id), each unless a kept one suppresses it.

    pairs: (a, b) where a comes earlier and suppresses b if it is kept.  As long
    as there are more than ``walked`` pairs, boxes that nothing open suppresses
    are kept, all at once, and what they suppress goes with its pairs.  Whether
    a box is kept depends on its overlap component only, so the components of
    the pairs left are walked side by side, each in one group.
    """
    from tessera.plans.components import connected_components

    pairs, gone = _thinned(pairs, walked)
    if gone is not None:
        boxes = boxes.join(gone.select(F.col("b").alias("obb_id")), "obb_id", "left_anti")
    inside = connected_components(pairs.select("a", "b"))
    alone = boxes.join(inside.select(F.col("node").alias("obb_id")), "obb_id", "left_anti").select("obb_id")
    rows = boxes.join(inside.withColumnRenamed("node", "obb_id"), "obb_id").select("component", "obb_id", "score", F.lit(None).cast("long").alias("b"))
    edges = pairs.join(inside.withColumnRenamed("node", "a"), "a").select("component", F.col("a").alias("obb_id"), F.lit(None).cast("double").alias("score"), "b")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["b"].isna()].sort_values(["score", "obb_id"], ascending=[False, True])
        links = pdf[pdf["b"].notna()]
        kept = _greedy(list(zip(links["obb_id"], links["b"].astype("int64"), strict=True)), nodes["obb_id"].tolist())
        return pd.DataFrame({"obb_id": sorted(kept)}, dtype="int64")

    kept = rows.unionByName(edges).groupBy("component").applyInPandas(walk, "obb_id long")
    return boxes.join(alone.unionByName(kept), "obb_id", "left_semi")


def nms_pairs(boxes: DataFrame, threshold: float = 0.05, n: int = 31) -> DataFrame:
    """(a, b): a is earlier in score order, the footprints touch, and more than ``threshold`` of b's volume is shared."""
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_obb_id") < F.col("b_obb_id")))
    met = iou(_bare(candidate_pairs(boxes, boxes).filter(first).filter(touch_2d())), n)
    return met.filter(F.col("inter") / (F.col("b_lx") * F.col("b_ly") * F.col("b_lz")) > threshold).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"))


def nms_same_angle_pairs(boxes: DataFrame, threshold: float = 0.05) -> DataFrame:
    """As ``nms_pairs`` for boxes of one turn: overlap of axis-aligned rectangles around the bottom centres."""
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_obb_id") < F.col("b_obb_id")))
    flat = boxes.select("obb_id", "score", *GEOMETRY)
    met = candidate_pairs(flat, flat).filter(first).filter("a_theta = b_theta")
    side = lambda c: F.greatest(F.lit(0.0), F.least(F.col(f"a_c{c}") + F.col(f"a_l{c}") / 2, F.col(f"b_c{c}") + F.col(f"b_l{c}") / 2) - F.greatest(F.col(f"a_c{c}") - F.col(f"a_l{c}") / 2, F.col(f"b_c{c}") - F.col(f"b_l{c}") / 2))
    inter = side("x") * side("y")
    union = F.col("a_lx") * F.col("a_ly") + F.col("b_lx") * F.col("b_ly") - inter
    return met.filter(inter / union > threshold).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 8.0) -> DataFrame:
    """(pid, obb_id) of points (pid, x, y, z) in boxes, faces included: a range join by grid cells."""
    rad = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly")) / 2
    spread = boxes.withColumn("kx", F.explode(F.sequence(F.floor((F.col("cx") - rad) / cell).cast("int"), F.floor((F.col("cx") + rad) / cell).cast("int"))))
    spread = spread.withColumn("ky", F.explode(F.sequence(F.floor((F.col("cy") - rad) / cell).cast("int"), F.floor((F.col("cy") + rad) / cell).cast("int"))))
    keyed = points.withColumns({"kx": F.floor(F.col("x") / cell).cast("int"), "ky": F.floor(F.col("y") / cell).cast("int")})
    return keyed.join(spread, ["kx", "ky"]).filter(g.in_box(F.col("x"), F.col("y"), F.col("z"))).select("pid", "obb_id")


def refine(candidates: DataFrame, *by: str) -> DataFrame:
    """The candidate of the highest score for each ``by``; of equals the smallest ``k``."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), "k"))).filter("rank = 1").drop("rank")


def step_sizes(boxes: DataFrame) -> DataFrame:
    """(obb_id, sx, sy, sangle): scan steps; coarse where the smaller side is above 8."""
    big = F.least("lx", "ly") > 8
    one = lambda a, b: F.when(big, F.lit(a)).otherwise(F.lit(b))
    return boxes.select("obb_id", one(2.0, 1.0).alias("sx"), one(2.0, 1.0).alias("sy"), (one(2.0, 1.0) * g.PI / 180).alias("sangle"))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: the same in every run, on every partitioning and engine."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(*keys: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit(1)))) * F.cos(2 * g.PI * uniform(*keys, F.lit(2)))


def jitter(boxes: DataFrame, copies: int, share: float = 0.1, angle: float = g.PI / 16, seed: int = 0) -> DataFrame:
    """``copies`` moved boxes (.., copy) of each: normal offsets of ``share`` of the sides, turns within +-angle; each box has offsets of its own."""
    many = boxes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = lambda n: (F.col("obb_id"), F.col("copy"), F.lit(seed), F.lit(n))
    return many.withColumns({"cx": F.col("cx") + _normal(*key(0)) * share * F.col("lx"), "cy": F.col("cy") + _normal(*key(1)) * share * F.col("ly"), "theta": F.col("theta") + (2 * uniform(*key(2)) - 1) * angle})


def random_negatives(truth: DataFrame, template: tuple[float, float, float], low: tuple[float, float], high: tuple[float, float], n: int, seed: int = 0) -> DataFrame:
    """n boxes of the template's sides at uniform poses that touch no true box: twice as many are drawn until enough are left."""
    spark, drawn = truth.sparkSession, 2 * n
    while True:
        i = F.col("id")
        at = lambda k: uniform(i, F.lit(seed), F.lit(k))
        pose = spark.range(drawn).select((-i - 1).alias("obb_id"), F.lit(-1).alias("category"), F.lit(0.0).alias("score"), (low[0] + at(0) * (high[0] - low[0])).alias("cx"), (low[1] + at(1) * (high[1] - low[1])).alias("cy"), F.lit(0.0).alias("bz"), *[F.lit(float(s)).alias(c) for s, c in zip(template, ("lx", "ly", "lz"), strict=True)], (at(2) * 2 * g.PI).alias("theta"))
        hit = overlaps(pose, truth).select(F.col("a_obb_id").alias("obb_id")).distinct()
        free = pose.join(hit, "obb_id", "left_anti")
        if free.limit(n).count() == n:
            return free.orderBy(F.col("obb_id").desc()).limit(n)
        if drawn > 64 * n:
            raise ValueError(f"of {drawn} drawn poses fewer than {n} touch no true box")
        drawn *= 2
