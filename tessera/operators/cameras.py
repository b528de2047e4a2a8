"""Views with poses: between pixels and the world, visibility, fusion of depth maps, integration into volumes.

A camera is (frame, r, cx, cy, cz): r is the row-major 3 x 3 turn from its own
axes to the world's, (cx, cy, cz) its centre.  A pixel (y, x) looks along
theta = theta0 + x * theta_step (from the z axis) and phi = phi0 + y * phi_step.
Pixels are (frame, y, x, depth); a missing row has no depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import boxes as b
from tessera.operators import mesh as m
from tessera.operators import volume as v

POSE = ["r", "cx", "cy", "cz"]


@dataclass(frozen=True)
class Image:
    rows: int = 64
    columns: int = 64
    theta0: float = g.PI / 128
    theta_step: float = g.PI / 64
    phi0: float = -g.PI / 2 + g.PI / 128
    phi_step: float = g.PI / 64

    def theta(self, x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(g.PI), self.theta0 + x * self.theta_step))

    def phi(self, y: Column) -> Column:
        return F.greatest(F.lit(-g.PI / 2), F.least(F.lit(g.PI / 2), self.phi0 + y * self.phi_step))


def to_world(x: Column, y: Column, z: Column) -> list[Column]:
    """World coordinates of a point on the camera's own axes, in a row with the camera's pose."""
    r = F.col("r")
    return [r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z + F.col(f"c{c}") for i, c in enumerate("xyz")]


def to_camera(x: Column, y: Column, z: Column) -> list[Column]:
    """The inverse: the pose's turn is orthonormal."""
    r = F.col("r")
    d = [x - F.col("cx"), y - F.col("cy"), z - F.col("cz")]
    return [r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2] for i in range(3)]


def relative(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(frame, other, r, tx, ty, tz) of pairs (frame, other): the map from one camera's axes to the other's."""
    own = cameras.select("frame", *[F.col(c).alias(f"a_{c}") for c in POSE])
    there = cameras.select(F.col("frame").alias("other"), *[F.col(c).alias(f"b_{c}") for c in POSE])
    met = pairs.join(own, "frame").join(there, "other")
    turn = [sum((F.col("b_r")[3 * k + i] * F.col("a_r")[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]
    shift = [sum((F.col("b_r")[3 * k + i] * (F.col(f"a_c{c}") - F.col(f"b_c{c}")) for k, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    return met.select("frame", "other", F.array(*turn).alias("r"), *[s.alias(f"t{c}") for c, s in zip("xyz", shift, strict=True)])


def unproject(pixels: DataFrame, cameras: DataFrame, image: Image = Image()) -> DataFrame:
    """The pixels with their points (wx, wy, wz) in the world."""
    theta, phi = image.theta(F.col("x")), image.phi(F.col("y"))
    met = pixels.filter("depth > 0").join(cameras.select("frame", *POSE), "frame")
    return met.select(*pixels.columns, *[c.alias(f"w{k}") for k, c in zip("xyz", to_world(*g.ray(theta, phi, F.col("depth"))), strict=True)])


def project(points: DataFrame, cameras: DataFrame, image: Image = Image()) -> DataFrame:
    """Points (.., frame, wx, wy, wz) with the pixel (iy, ix) of that frame they fall on and their distance; those behind it or outside the image go."""
    met = points.join(cameras.select("frame", *POSE), "frame")
    x, y, z = to_camera(F.col("wx"), F.col("wy"), F.col("wz"))
    # generators: filters on what they give are not copied into how it is computed
    seen = met.select(*points.columns, F.inline(F.array(F.struct(x.alias("lx"), y.alias("ly"), z.alias("lz"))))).filter("lx > 0")
    theta, phi = g.angles(F.col("lx"), F.col("ly"), F.col("lz"))
    length = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"))
    turned = seen.select(*points.columns, F.inline(F.array(F.struct(theta.alias("theta"), phi.alias("phi"), length.alias("length")))))
    iy, ix = F.round((F.col("phi") - image.phi0) / image.phi_step).cast("int"), F.round((F.col("theta") - image.theta0) / image.theta_step).cast("int")
    placed = turned.select(*points.columns, iy.alias("iy"), ix.alias("ix"), "length")
    return placed.filter(F.col("ix").between(0, image.columns - 1) & F.col("iy").between(0, image.rows - 1))


def candidates(pixels: DataFrame, cameras: DataFrame, reference: int, image: Image = Image(), max_depth: float = 30.0) -> DataFrame:
    """(y, x, frame, depth): the nearest depth that each frame, the reference among them, puts on each pixel of the reference."""
    points = unproject(pixels.filter(F.col("depth") <= max_depth), cameras, image).select("wx", "wy", "wz", F.col("frame").alias("source"), F.lit(reference).alias("frame"))
    seen = project(points, cameras, image).filter(F.col("length") <= max_depth)
    return seen.groupBy(F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("source").alias("frame")).agg(F.min("length").alias("depth"))


def _seen_from(points: DataFrame, pixels: DataFrame, cameras: DataFrame, image: Image) -> DataFrame:
    """Points of the world (.., frame, wx, wy, wz), where they fall into that frame's image, with the frame's own depth there (0: none)."""
    there = pixels.select("frame", F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("depth").alias("there"))
    return project(points, cameras, image).join(there, ["frame", "iy", "ix"], "left").withColumn("there", F.coalesce("there", F.lit(0.0)))


def fuse_visibility(pixels: DataFrame, cameras: DataFrame, reference: int, image: Image = Image(), epsilon: float = 0.05, max_depth: float = 30.0) -> DataFrame:
    """(y, x, depth, conf): the nearest candidate that more candidates lie in front of than frames see through.

    Each candidate of a reference pixel is put into every other frame: a frame
    with a larger depth there sees through it, one within epsilon supports it.
    conf is the share of supporting frames among those whose image it falls
    into; null if there is none.
    """
    ranked = candidates(pixels, cameras, reference, image, max_depth).withColumn("front", F.row_number().over(W.partitionBy("y", "x").orderBy("depth", "frame")) - 1)
    ranked = ranked.select("y", "x", "front", "depth")
    others = cameras.filter(F.col("frame") != reference).agg(F.collect_list("frame").alias("others"))
    points = unproject(ranked.withColumn("frame", F.lit(reference)), cameras, image).drop("frame")
    # every candidate is put into every other frame: that many rows are the operator's own work
    each = points.crossJoin(F.broadcast(others)).withColumn("frame", F.explode("others")).drop("others")
    seen = _seen_from(each, pixels, cameras, image)
    votes = seen.groupBy("y", "x", "front").agg(F.count_if(F.col("there") > F.col("length") + epsilon).alias("through"), F.count_if(F.abs(F.col("there") - F.col("length")) <= epsilon).alias("support"), F.count("*").alias("all"))
    good = ranked.join(votes, ["y", "x", "front"], "left").filter(F.col("front") - F.coalesce("through", F.lit(0)) > 0)
    best = good.groupBy("y", "x").agg(F.min_by(F.struct("depth", (F.col("support") / F.col("all")).alias("conf")), "front").alias("b"))
    return best.select("y", "x", "b.depth", "b.conf")


def fuse_disparity(pixels: DataFrame, cameras: DataFrame, reference: int, image: Image = Image(), threshold: float = 0.1, base: float = 1.0, edge: int = 4, least: int = 4, max_depth: float = 30.0) -> DataFrame:
    """(y, x, depth, conf): reference depths that both directions of test support.

    Each frame's candidate on the pixel is compared with the pixel's own
    depth, and the pixel's own point is put into that frame and compared with
    what stands there, in steps of angular disparity.  conf is (support -
    occluding - seen through) / (2 (frames - 1)).
    """
    frames = cameras.count()
    ref = pixels.filter((F.col("frame") == reference) & (F.col("depth") > 0) & (F.col("depth") <= max_depth) & F.col("x").between(edge, image.columns - 1 - edge))
    own = unproject(ref, cameras, image).drop("frame")
    met = own.join(candidates(pixels, cameras, reference, image, max_depth).withColumnRenamed("depth", "other"), ["y", "x"])
    step = g.PI / image.columns
    theta = image.theta(F.col("x"))
    apart = g.angular_disparity(F.col("other"), theta, base) - g.angular_disparity(F.col("depth"), theta, base)
    here = met.withColumns({"occluding": (apart > step).cast("int"), "near": (F.abs(apart) <= step).cast("int")})
    seen = _seen_from(here, pixels, cameras, image)
    theta_q = image.theta(F.col("ix"))
    back = g.angular_disparity(F.col("there"), theta_q, base) - g.angular_disparity(F.col("length"), theta_q, base)
    second = seen.select("y", "x", "frame", (back < -step).cast("int").alias("through"), (F.abs(back) <= step).cast("int").alias("near_back"))
    all_ = here.join(second, ["y", "x", "frame"], "left").groupBy("y", "x", "depth").agg((F.sum("near") + F.sum(F.coalesce("near_back", F.lit(0)))).alias("support"), (F.sum("occluding") + F.sum(F.coalesce("through", F.lit(0)))).alias("against"))
    conf = (F.col("support") - F.col("against")) / (2.0 * (frames - 1))
    return all_.withColumn("conf", conf).filter((F.col("conf") > threshold) & (F.col("support") >= least)).select("y", "x", "depth", "conf")


def cloud(pixels: DataFrame, cameras: DataFrame, image: Image = Image()) -> DataFrame:
    """(frame, wx, wy, wz, r, g, b): all frames' points, a colour for each frame."""
    hue = (F.col("frame") * 37 % 100) / 100.0
    return unproject(pixels, cameras, image).select("frame", "wx", "wy", "wz", *[c.alias(n) for n, c in zip("rgb", g.jet(hue), strict=True)])


def visible(points: DataFrame, cameras: DataFrame, reach: float = 30.0, cosine: float = 0.05) -> DataFrame:
    """(pid, frame) of points (pid, wx, wy, wz) that a camera sees: within reach, in front, and not too far from its axis; a range join by grid cells."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    spread = cameras.select("frame", *POSE)
    for c in "xyz":
        spread = spread.withColumn(f"k{c}", F.explode(F.array(*[cell(f"c{c}") + i for i in (-1, 0, 1)])))
    keyed = points.select("pid", "wx", "wy", "wz", *[cell(f"w{c}").alias(f"k{c}") for c in "xyz"])
    met = keyed.join(spread, ["kx", "ky", "kz"])
    x, y, z = to_camera(F.col("wx"), F.col("wy"), F.col("wz"))
    far = F.sqrt(x * x + y * y + z * z)
    return met.filter((far <= reach) & (x > 0) & (x / far > cosine)).select("pid", "frame")


def visible_cameras(boxes: DataFrame, cameras: DataFrame, reach: float = 30.0, cosine: float = 0.05) -> DataFrame:
    """(obb_id, frame): the cameras that see each box's centre."""
    centres = boxes.select(F.col("obb_id").alias("pid"), F.col("cx").alias("wx"), F.col("cy").alias("wy"), (F.col("bz") + F.col("lz") / 2).alias("wz"))
    return visible(centres, cameras, reach, cosine).select(F.col("pid").alias("obb_id"), "frame")


def check_vertices(vertices: DataFrame, boxes: DataFrame, pixels: DataFrame, cameras: DataFrame, image: Image = Image(), sky_limit: int = 3, base: float = 1.0, check_sky: bool = True, check_depth: bool = True) -> DataFrame:
    """(vid): vertices in boxes that the cameras of a box speak against.

    pixels: (frame, y, x, depth, sky).  A vertex goes if more than sky_limit
    cameras see the sky there, or if more than half of those that agree with
    it or look past it look past it.
    """
    inside = b.points_in_boxes(vertices.select(F.col("vid").alias("pid"), "x", "y", "z"), boxes)
    seen_by = inside.join(visible_cameras(boxes, cameras), "obb_id")
    points = seen_by.join(vertices.select(F.col("vid").alias("pid"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("wz")), "pid")
    there = pixels.select("frame", F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("depth").alias("there"), "sky")
    seen = project(points, cameras, image).join(there, ["frame", "iy", "ix"], "left")
    theta = image.theta(F.col("ix"))
    slack = 4 * g.depth_error(theta, g.angular_disparity(F.col("there"), theta, base), base, g.PI / image.columns)
    real = (F.col("there") > 0) & F.lit(check_depth)
    gap = F.col("there") - F.col("length")
    votes = seen.groupBy("pid", "obb_id").agg(F.count_if((F.col("sky") > 0) & F.lit(check_sky)).alias("sky"), F.count_if(real & (F.abs(gap) < slack)).alias("agree"), F.count_if(real & (F.abs(gap) >= slack) & (gap > slack)).alias("past"))
    bad = (F.col("sky") > sky_limit) | ((F.col("past") > 0) & (F.col("past") / (F.col("past") + F.col("agree")) > 0.5))
    return votes.filter(bad).select(F.col("pid").alias("vid")).distinct()


def clean_mesh(faces: DataFrame, vertices: DataFrame, boxes: DataFrame, pixels: DataFrame, cameras: DataFrame, image: Image = Image(), **limits) -> DataFrame:
    """The faces without a vertex that ``check_vertices`` names."""
    return m.without_vertices(faces, check_vertices(vertices, boxes, pixels, cameras, image, **limits))


def clean_volume(voxels: DataFrame, vertices: DataFrame, gone: DataFrame, low: int, high: int) -> DataFrame:
    """The voxels but for those near the vertices (vid) that go: within [low, high) steps along each axis of a vertex's voxel."""
    return v.clear_near(voxels, vertices.join(gone, "vid", "left_semi").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), low, high)


def integrate(pixels: DataFrame, cameras: DataFrame, image: Image = Image(), length: float = 0.5, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), low: float = -1.0, high: float = 1.2, reach: int = 1, max_weight: float = v.MAX_WEIGHT) -> DataFrame:
    """(vx, vy, vz, d, w, label): depth maps fused into a volume, frame by frame in order.

    pixels: (frame, y, x, depth, conf, label).  The bricks within ``reach``
    of each frame's points are touched by it; each of their voxels is
    projected into the frame and observed through the pixel it falls on, with
    the distance's weight times the pixel's confidence.  All frames are worked
    on side by side; the fold along frames is ``volume.fuse``'s.
    """
    points = unproject(pixels, cameras, image)
    voxel = [F.round(g.to_voxel(F.col(f"w{c}"), o, length)).cast("int") for c, o in zip("xyz", origin, strict=True)]
    bricks = points.select("frame", *[g.brick(k).alias(f"b{c}") for c, k in zip("xyz", voxel, strict=True)]).distinct()
    for c in "xyz":
        bricks = bricks.withColumn(f"b{c}", F.explode(F.array(*[F.col(f"b{c}") + 8 * i for i in range(-reach, reach + 1)]))).distinct()
    for c in "xyz":
        bricks = bricks.withColumn(f"v{c}", F.explode(F.array(*[F.col(f"b{c}") + i for i in range(8)])))
    world = bricks.select("frame", *v.KEY, *[g.to_world(F.col(f"v{c}"), o, length).alias(f"w{c}") for c, o in zip("xyz", origin, strict=True)])
    there = pixels.filter("depth > 0 and conf > 0").select("frame", F.col("y").alias("iy"), F.col("x").alias("ix"), "depth", "conf", "label")
    seen = project(world, cameras, image).join(there, ["frame", "iy", "ix"]).withColumn("d", F.col("depth") - F.col("length"))
    obs = seen.filter(F.col("d").between(low, high)).select(F.col("frame").cast("long").alias("seq"), *v.KEY, "d", (g.ramp_weight(F.col("d"), end=low) * F.col("conf")).alias("w"), "label")
    return v.fuse(obs, low, high, max_weight)
