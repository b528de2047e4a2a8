"""Operators on depth maps in long form: pixels (frame, y, x, depth).

A missing row is a pixel without depth.  Fusion keeps a reference pixel by
the votes of the other frames that see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def pixel_angles(y: Column, x: Column, rows: int = 64, columns: int = 64) -> tuple[Column, Column]:
    """(theta, phi) of a pixel: theta over (0, pi), phi over (-pi/2, pi/2)."""
    return (y + 0.5) * (g.PI / rows), (x + 0.5) * (g.PI / columns) - g.PI / 2


def unproject(pixels: DataFrame, shift: float = 0.0) -> DataFrame:
    """(frame, y, x, px, py, pz): points in the world; frame f stands ``shift`` * f along y."""
    theta, phi = pixel_angles(F.col("y"), F.col("x"))
    px, py, pz = g.ray(theta, phi, F.col("depth"))
    return pixels.filter("depth > 0").select("frame", "y", "x", px.alias("px"), (py + F.col("frame") * shift).alias("py"), pz.alias("pz"))


def project(points: DataFrame, shift: float = 0.0, max_depth: float = 30.0, rows: int = 64, columns: int = 64) -> DataFrame:
    """(frame, sy, sx, y, x, depth): where the points of each frame fall in the reference frame 0; points behind or too far are left out."""
    x, y, z = F.col("px"), F.col("py"), F.col("pz")
    n = F.sqrt(x * x + y * y + z * z)
    theta, phi = g.angles(x, y, z)
    seen = points.filter((x > 0) & (n <= max_depth)).select(
        "frame", F.col("y").alias("sy"), F.col("x").alias("sx"), F.round(theta / (g.PI / rows) - 0.5).cast("int").alias("y"), F.round((phi + g.PI / 2) / (g.PI / columns) - 0.5).cast("int").alias("x"), n.alias("depth")
    )
    return seen.filter(F.col("y").between(0, rows - 1) & F.col("x").between(0, columns - 1))


def zbuffer(projected: DataFrame) -> DataFrame:
    """(y, x, frame, depth): the nearest depth of each source frame at each reference pixel."""
    return projected.groupBy("y", "x", "frame").agg(F.min("depth").alias("depth"))


def _against(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    ref = reference.select("y", "x", F.col("depth").alias("ref"))
    return ref.join(candidates.filter("frame <> 0").select("y", "x", "frame", "depth"), ["y", "x"], "left")


def fuse_simple(reference: DataFrame, candidates: DataFrame, share: float = 0.9, least: int = 1, scale: float = 0.01 / 6.25) -> DataFrame:
    """(y, x, depth, support, seen): depths that nearly all frames that see the pixel support, within scale * depth^2."""
    met = _against(reference, candidates)
    votes = met.groupBy("y", "x").agg(F.first("ref").alias("depth"), F.count_if(F.abs(F.col("depth") - F.col("ref")) < scale * F.col("ref") * F.col("ref")).alias("support"), F.count("depth").alias("seen"))
    return votes.filter(((F.col("support") + 1) / (F.col("seen") + 1) > share) & (F.col("support") >= least))


def _disparity_votes(reference: DataFrame, candidates: DataFrame, base: float, step: float) -> DataFrame:
    met = _against(reference, candidates)
    theta, _ = pixel_angles(F.col("y"), F.col("x"))
    apart = g.angular_disparity(F.col("depth"), theta, base) - g.angular_disparity(F.col("ref"), theta, base)
    return met.groupBy("y", "x").agg(F.first("ref").alias("depth"), F.count_if(F.abs(apart) <= step).alias("support"), F.count_if(apart < -step).alias("violations"), F.count_if(apart > step).alias("occlusions"), F.count("depth").alias("seen"))


def fuse_reference_support(reference: DataFrame, candidates: DataFrame, frames: int, threshold: float = 0.3, base: float = 1.0, columns: int = 64, edge: int = 4, least: int = 2) -> DataFrame:
    """Depths that enough of all frames support within two disparity steps."""
    v = _disparity_votes(reference, candidates, base, 2 * g.PI / columns)
    return v.filter(((F.col("support") + 1) / frames > threshold) & (F.col("support") >= least) & F.col("x").between(edge, columns - 1 - edge)).select("y", "x", "depth", "support")


def fuse_spherical(reference: DataFrame, candidates: DataFrame, frames: int, threshold: float = 0.3, base: float = 1.0, columns: int = 64, edge: int = 5, least: int = 2) -> DataFrame:
    """As ``fuse_reference_support`` within one step, with conf = exp(-2 error) of the depth's angular error."""
    v = _disparity_votes(reference, candidates, base, g.PI / columns)
    theta, _ = pixel_angles(F.col("y"), F.col("x"))
    error = g.depth_error(theta, g.angular_disparity(F.col("depth"), theta, base) - theta, base, g.PI / columns)
    kept = v.filter(((F.col("support") + 1) / frames > threshold) & (F.col("support") >= least) & F.col("x").between(edge, columns - 1 - edge))
    return kept.select("y", "x", "depth", "support", F.exp(-2 * F.abs(error)).alias("conf"))


def remove_low_confidence(pixels: DataFrame, least: float) -> DataFrame:
    """Depths whose confidence is no more than ``least`` become 0."""
    return pixels.withColumn("depth", F.when(F.col("conf") <= least, F.lit(0.0)).otherwise(F.col("depth")))


def triangulate(pixels: DataFrame, cut: float | None = None) -> DataFrame:
    """(frame, y, x, t, depth jump): the triangles of each 2 x 2 block with three depths or more.

    Corners are 0 (y, x), 1 (y, x+1), 2 (y+1, x), 3 (y+1, x+1).  Four depths
    split along the diagonal of the smaller jump: t 1 and 4 along 0-3, 2 and 3
    along 1-2; three depths give the one triangle without the missing corner
    (t 10 + that corner).  With ``cut``, triangles that jump further go.
    """
    at = {k: pixels.select("frame", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k"), "depth") for k, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))}
    corners = at[0].unionByName(at[1]).unionByName(at[2]).unionByName(at[3])
    block = corners.groupBy("frame", "y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("depth"))).alias(f"d{k}") for k in range(4)], F.count("*").alias("n")).filter("n >= 3")
    d = [F.col(f"d{k}") for k in range(4)]
    jump = lambda *ks: F.greatest(*[d[k] for k in ks]) - F.least(*[d[k] for k in ks])
    tri = lambda t, *ks: F.struct(F.lit(t).alias("t"), jump(*ks).alias("jump"))
    along = F.abs(d[0] - d[3]) <= F.abs(d[1] - d[2])
    made = (
        F.when((F.col("n") == 4) & along, F.array(tri(1, 0, 1, 3), tri(4, 0, 2, 3)))
        .when(F.col("n") == 4, F.array(tri(2, 0, 1, 2), tri(3, 1, 2, 3)))
        .when(d[0].isNull(), F.array(tri(10, 1, 2, 3)))
        .when(d[1].isNull(), F.array(tri(11, 0, 2, 3)))
        .when(d[2].isNull(), F.array(tri(12, 0, 1, 3)))
        .otherwise(F.array(tri(13, 0, 1, 2)))
    )
    out = block.select("frame", "y", "x", F.explode(made).alias("m")).select("frame", "y", "x", "m.t", "m.jump")
    return out if cut is None else out.filter(F.col("jump") <= cut)


def partners(frames: DataFrame, reach: int = 50) -> DataFrame:
    """(frame, before, after): the nearest other frames on either side within ``reach``: an as-of join in both directions."""
    # the neighbours in order are the nearest; frames are cut into ranges that overlap by the reach
    size = 64 * reach
    home = F.floor(F.col("frame") / size)
    near = F.explode(F.array_distinct(F.array(F.floor((F.col("frame") - reach) / size), home, F.floor((F.col("frame") + reach) / size))))
    dealt = frames.select("frame", near.alias("part"))
    w = W.partitionBy("part").orderBy("frame")
    both = dealt.withColumns({"before": F.lag("frame").over(w), "after": F.lead("frame").over(w)}).filter(F.col("part") == home)
    close = lambda c: F.when(F.abs(F.col(c) - F.col("frame")) <= reach, F.col(c))
    return both.select("frame", close("before").alias("before"), close("after").alias("after"))


def within(frames: DataFrame, reach: int = 2) -> DataFrame:
    """(frame, partner): all pairs at most ``reach`` apart, by equi-join on shifted numbers."""
    shifted = frames.select("frame", F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("partner")).filter("frame <> partner")
    return shifted.join(frames.select(F.col("frame").alias("partner")), "partner", "left_semi").select("frame", "partner")


def consistency(checks: DataFrame, sky: int = 3, occluded: float = 0.5) -> DataFrame:
    """(vid, sky, consistent, occluded, occluding, kept): votes of the views (vid, depth, seen, is_sky, error) of each vertex.

    A view whose own depth lies within 4 errors agrees; one that sees further
    is occluded by the vertex, one that sees less occludes it.
    """
    gap = F.col("seen") - F.col("depth")
    out = checks.groupBy("vid").agg(F.count_if(F.col("is_sky")).alias("sky"), F.count_if(~F.col("is_sky") & (F.abs(gap) <= 4 * F.col("error"))).alias("consistent"), F.count_if(~F.col("is_sky") & (gap > 4 * F.col("error"))).alias("occluded"), F.count_if(~F.col("is_sky") & (gap < -4 * F.col("error"))).alias("occluding"))
    bad = (F.col("sky") > sky) | (F.when(F.col("occluded") + F.col("consistent") > 0, F.col("occluded") / (F.col("occluded") + F.col("consistent"))).otherwise(0.0) > occluded)
    return out.withColumn("kept", ~bad)


def rle_encode(scan: DataFrame) -> DataFrame:
    """(y, start, length, kind, items): runs of each scanline (y, pos, value); the two constants -1 (empty) and -2 (full) collapse, anything between is one varying run."""
    kind = F.when(F.col("value") == -1, F.lit("E")).when(F.col("value") == -2, F.lit("F")).otherwise(F.lit("V"))
    w = W.partitionBy("y").orderBy("pos")
    marked = scan.withColumn("kind", kind).withColumn("opens", (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")).cast("int"))
    runs = marked.withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("y", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("items")).select("y", "start", "length", "kind", F.when(F.col("kind") == "V", F.transform("items", lambda s: s["value"])).alias("items"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(y, pos, value): the scanlines again."""
    constant = F.array_repeat(F.when(F.col("kind") == "E", F.lit(-1)).otherwise(F.lit(-2)), F.col("length").cast("int"))
    return runs.select("y", "start", F.posexplode(F.when(F.col("kind") == "V", F.col("items")).otherwise(constant)).alias("k", "value")).select("y", (F.col("start") + F.col("k")).alias("pos"), "value")
