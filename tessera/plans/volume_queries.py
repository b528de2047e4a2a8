"""Queries of the volume operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import r
from tessera.operators import volume as v
from tessera.plans import inputs as i
from tessera.plans.registry import query

#: Keeps finite decimals off the halves at which engines may round apart.
OFF_TIES = 3.7e-12

_OFFSETS8 = "o8 AS (SELECT * FROM (SELECT unnest([0, 1]) AS sx), (SELECT unnest([0, 1]) AS sy), (SELECT unnest([0, 1]) AS sz))"
_OFFSETS27 = "o27 AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy), (SELECT unnest([-1, 0, 1]) AS oz))"
_SNAP = "CASE WHEN p{c} - floor(p{c}) > 0.9999 THEN floor(p{c}) + 1 ELSE p{c} END AS p{c}"
_CORNERS = f"""{_OFFSETS8}, snapped AS (SELECT pid, {", ".join(_SNAP.format(c=c) for c in "xyz")} FROM pts),
    corners AS (SELECT pid, sx, sy, sz, CAST(floor(px) AS INTEGER) + sx AS vx, CAST(floor(py) AS INTEGER) + sy AS vy, CAST(floor(pz) AS INTEGER) + sz AS vz,
        (CASE WHEN sx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN sy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN sz = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) AS share
        FROM snapped, o8),
    met AS (SELECT corners.*, vox.d, vox.w FROM corners JOIN vox USING (vx, vy, vz))"""
_STENCIL = f"""{_OFFSETS27}, spread AS (SELECT vx + ox AS vx, vy + oy AS vy, vz + oz AS vz, d, w FROM {{t}}, o27),
    bricks AS (SELECT DISTINCT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz FROM {{t}}),
    sums AS (SELECT vx, vy, vz, sum(w * d) AS wd, sum(w) AS ww, count(*) AS n FROM spread GROUP BY ALL),
    inside AS (SELECT sums.* FROM sums JOIN bricks ON (vx & -8) = bx AND (vy & -8) = \"by\" AND (vz & -8) = bz)"""


@query("brick_hist", f"WITH {i.OBS} SELECT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz, count(*) AS n, count(DISTINCT (vx & 7) * 64 + (vy & 7) * 8 + (vz & 7)) AS occupied FROM obs GROUP BY ALL")
def brick_hist(spark, sf):
    o = i.observations(spark, sf)
    cell = g.in_brick("vx") * 64 + g.in_brick("vy") * 8 + g.in_brick("vz")
    return o.groupBy(*[g.brick(f"v{c}").alias(f"b{c}") for c in "xyz"]).agg(F.count("*").alias("n"), F.countDistinct(cell).alias("occupied"))


@query("brick_hash", f"""WITH {i.OBS} SELECT DISTINCT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz,
    xor(xor(((vx & -8) >> 3)::BIGINT * 73856093, ((vy & -8) >> 3)::BIGINT * 19349669), ((vz & -8) >> 3)::BIGINT * 83492791) AS h FROM obs""")
def brick_hash(spark, sf):
    b = i.observations(spark, sf).select(*[g.brick(f"v{c}").alias(f"b{c}") for c in "xyz"]).distinct()
    return b.withColumn("h", g.brick_hash(F.col("bx"), F.col("by"), F.col("bz")))


def _fused(spark, sf, coarse):
    f = v.fuse(i.observations(spark, sf, coarse))
    return f.select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"), "label")


@query("fuse_saturating", f"WITH {i.VOX_COARSE} SELECT vx, vy, vz, round(d, 6) AS d, round(w, 6) AS w, label FROM vox")
def fuse_saturating(spark, sf):
    return _fused(spark, sf, True)


@query("fuse_sparse", f"WITH {i.VOX} SELECT vx, vy, vz, round(d, 6) AS d, round(w, 6) AS w, label FROM vox")
def fuse_sparse(spark, sf):
    return _fused(spark, sf, False)


@query("fuse_colors", f"""WITH {i.OBS_COARSE}, s AS (SELECT vx, vy, vz, list_reduce(list_prepend({{'w': 0.0::DOUBLE, 'r': 0, 'g': 0, 'b': 0}}, list({{'w': w, 'r': r, 'g': g, 'b': b}} ORDER BY seq)),
    lambda a, x: {{'w': least(a.w + x.w, 5.0), 'r': CAST(floor((a.r * a.w + x.r * x.w) / (a.w + x.w)) AS INTEGER), 'g': CAST(floor((a.g * a.w + x.g * x.w) / (a.w + x.w)) AS INTEGER), 'b': CAST(floor((a.b * a.w + x.b * x.w) / (a.w + x.w)) AS INTEGER)}}) AS s
    FROM obs GROUP BY vx, vy, vz) SELECT vx, vy, vz, s.r AS r, s.g AS g, s.b AS b FROM s""")
def fuse_colors(spark, sf):
    return v.fuse_colors(i.observations(spark, sf, True))


@query("fuse_plain_mean", f"WITH {i.OBS} SELECT vx, vy, vz, round(sum(d * w) / sum(w), 6) AS d, round(least(sum(w), 5.0), 6) AS w FROM obs GROUP BY ALL")
def fuse_plain_mean(spark, sf):
    return v.fuse_mean(i.observations(spark, sf)).select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))


@query("set_last_writer", f"WITH {i.OBS_COARSE} SELECT vx, vy, vz, round(arg_max(d, seq), 6) AS d, round(arg_max(w, seq), 6) AS w FROM obs GROUP BY ALL")
def set_last_writer(spark, sf):
    return v.set_last(i.observations(spark, sf, True)).select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))


@query("merge_two_volumes", f"""WITH {i.VOX}, pair AS (SELECT vx, vy, vz, d, w, 0 AS s FROM vox UNION ALL SELECT vx + 1, vy, vz, d, w, 1 FROM vox)
    SELECT vx, vy, vz, round(sum(d * w) / sum(w), 6) AS d, round(least(sum(w), 5.0), 6) AS w FROM pair GROUP BY ALL""")
def merge_two_volumes(spark, sf):
    a = i.voxels(spark, sf)
    return v.merge(a, a.withColumn("vx", F.col("vx") + 1)).select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))


@query("tsdf_weight_ramp", f"""WITH {i.OBS} SELECT seq, round(CASE WHEN d >= -0.04 THEN 1.0 WHEN d >= -0.6 THEN 0.05::DOUBLE + (d + 0.6::DOUBLE) / 0.56::DOUBLE * 0.95::DOUBLE WHEN d >= -1.0 THEN (d + 1.0::DOUBLE) / 0.4::DOUBLE * 0.05::DOUBLE ELSE 0 END, 9) AS ramp FROM obs""")
def tsdf_weight_ramp(spark, sf):
    return i.observations(spark, sf).select("seq", r(g.ramp_weight(F.col("d")), 9).alias("ramp"))


@query("world_voxel_roundtrip", f"WITH {i.POINTS} SELECT pid, round(px * 0.2::DOUBLE - 3, 6) AS wx, round((px * 0.2::DOUBLE - 3 + 3) / 0.2::DOUBLE, 6) AS vx FROM pts")
def world_voxel_roundtrip(spark, sf):
    w = g.to_world(F.col("px"), -3, 0.2)
    return i.points(spark, sf).select("pid", r(w).alias("wx"), r(g.to_voxel(w, -3, 0.2)).alias("vx"))


@query("grid_index_codec", f"WITH {i.OBS} SELECT DISTINCT (vx::BIGINT * 32 + vy) * 24 + vz AS idx, vx::BIGINT AS x, vy::BIGINT AS y, vz::BIGINT AS z FROM obs")
def grid_index_codec(spark, sf):
    o = i.observations(spark, sf).select(g.flat_index(F.col("vx"), F.col("vy"), F.col("vz"), 32, 24).alias("idx")).distinct()
    x, y, z = g.unflatten(F.col("idx"), 32, 24)
    return o.select("idx", x.alias("x"), y.alias("y"), z.alias("z"))


@query("slice_label", f"WITH {i.VOX} SELECT vx, vy, vz, round(d, 6) AS d FROM vox WHERE w > 0 AND label = 3")
def slice_label(spark, sf):
    return v.select(i.voxels(spark, sf), F.col("label") == 3).select("vx", "vy", "vz", r("d").alias("d"))


@query("slice_any_label", f"WITH {i.VOX} SELECT label, count(*) AS n FROM vox WHERE w > 0 AND label > -1 GROUP BY label")
def slice_any_label(spark, sf):
    return v.select(i.voxels(spark, sf), F.col("label") > -1).groupBy("label").agg(F.count("*").alias("n"))


_TURNED = "((vx - 16) * cos(0.5::DOUBLE) + (vy - 15) * sin(0.5::DOUBLE))", "((vy - 15) * cos(0.5::DOUBLE) - (vx - 16) * sin(0.5::DOUBLE))"
_BOX_SQL = f"abs({_TURNED[0]}) <= 6 AND abs({_TURNED[1]}) <= 4 AND vz BETWEEN 2 AND 15"


def _box():
    x, y = g.rotated(F.col("vx") - 16, F.col("vy") - 15, F.lit(0.5))
    return (F.abs(x) <= 6) & (F.abs(y) <= 4) & F.col("vz").between(2, 15)


@query("slice_box", f"WITH {i.VOX} SELECT vx, vy, vz, round(d, 6) AS d FROM vox WHERE {_BOX_SQL}")
def slice_box(spark, sf):
    return v.select(i.voxels(spark, sf), _box()).select("vx", "vy", "vz", r("d").alias("d"))


@query("clean_box", f"WITH {i.VOX} SELECT vx, vy, vz, round(d, 6) AS d FROM vox WHERE NOT ({_BOX_SQL})")
def clean_box(spark, sf):
    return v.outside(i.voxels(spark, sf), _box()).select("vx", "vy", "vz", r("d").alias("d"))


@query("scale_box", f"WITH {i.VOX} SELECT vx, vy, vz, round(CASE WHEN {_BOX_SQL} THEN greatest(0, least(5.0, w * 1.7)) ELSE w END, 6) AS w FROM vox")
def scale_box(spark, sf):
    return v.scale_weights(i.voxels(spark, sf), 1.7, _box()).select("vx", "vy", "vz", r("w").alias("w"))


@query("voxel_lookup", f"""WITH {i.VOX}, {i.POINTS}, p AS (SELECT pid, CAST(floor(px) AS INTEGER) AS vx, CAST(floor(py) AS INTEGER) AS vy, CAST(floor(pz) AS INTEGER) AS vz FROM pts)
    SELECT pid, round(coalesce(d, -1), 6) AS d, round(coalesce(w, 0), 6) AS w FROM p LEFT JOIN vox USING (vx, vy, vz)""")
def voxel_lookup(spark, sf):
    p = i.points(spark, sf).select("pid", *[F.floor(f"p{c}").cast("int").alias(f"v{c}") for c in "xyz"])
    return v.lookup(p, i.voxels(spark, sf)).select("pid", r("d").alias("d"), r("w").alias("w"))


@query("sample_nearest", f"""WITH {i.VOX}, {i.POINTS}, p AS (SELECT pid, CAST(round(px) AS INTEGER) AS vx, CAST(round(py) AS INTEGER) AS vy, CAST(round(pz) AS INTEGER) AS vz FROM pts)
    SELECT pid, round(d, 6) AS d, round(w, 6) AS w FROM p JOIN vox USING (vx, vy, vz)""")
def sample_nearest(spark, sf):
    return v.nearest(i.points(spark, sf), i.voxels(spark, sf)).select("pid", r("d").alias("d"), r("w").alias("w"))


@query("sample_trilinear", f"""WITH {i.VOX}, {i.POINTS}, {_CORNERS}
    SELECT pid, round(sum(share * d) / sum(share), 9) AS d, round(sum(share * w) / sum(share), 9) AS w FROM met GROUP BY pid HAVING sum(share) > 0.4""")
def sample_trilinear(spark, sf):
    return v.trilinear(i.points(spark, sf), i.voxels(spark, sf)).select("pid", r("d", 9).alias("d"), r("w", 9).alias("w"))


_G = ", ".join(f"round(avg({{e}}) FILTER (s{c} = 1) - avg({{e}}) FILTER (s{c} = 0), 9) + 0.0::DOUBLE AS g{c}" for c in "xyz")


_DENSE = f"{i.VOX}".replace("vox AS (", "seen AS (") + f", {_STENCIL.format(t='seen')}, vox AS (SELECT vx, vy, vz, wd / ww AS d, ww / 27 AS w FROM inside)"


@query("gradient", f"WITH {_DENSE}, {i.POINTS}, {_CORNERS} SELECT pid, {_G.format(e='d')} FROM met GROUP BY pid HAVING count(*) = 8")
def gradient(spark, sf):
    return v.gradient(i.points(spark, sf), v.smooth(i.voxels(spark, sf))).select("pid", *[r(f"g{c}", 9).alias(f"g{c}") for c in "xyz"])


@query("abs_gradient", f"WITH {i.VOX}, {i.POINTS}, {_CORNERS} SELECT pid, {_G.format(e='abs(d)')} FROM met GROUP BY pid")
def abs_gradient(spark, sf):
    return v.gradient(i.points(spark, sf), i.voxels(spark, sf), absolute=True).select("pid", *[r(f"g{c}", 9).alias(f"g{c}") for c in "xyz"])


@query("neighbors27", f"""WITH {i.VOX}, {i.POINTS}, {_OFFSETS27}, p AS (SELECT pid, CAST(floor(px) AS INTEGER) + ox AS vx, CAST(floor(py) AS INTEGER) + oy AS vy, CAST(floor(pz) AS INTEGER) + oz AS vz FROM pts, o27)
    SELECT pid, count(w) AS observed, round(sum(coalesce(d, -1)), 9) AS sum_d, round(sum(coalesce(w, 0)), 9) AS sum_w FROM p LEFT JOIN vox USING (vx, vy, vz) GROUP BY pid""")
def neighbors27(spark, sf):
    p = i.points(spark, sf).select("pid", *[F.floor(f"p{c}").cast("int").alias(f"v{c}") for c in "xyz"])
    return v.neighborhood(p, i.voxels(spark, sf)).groupBy("pid").agg(F.count_if(F.col("w") > 0).alias("observed"), r(F.sum("d"), 9).alias("sum_d"), r(F.sum("w"), 9).alias("sum_w"))


@query("enqueue_bricks", f"""WITH {i.POINTS}, {_OFFSETS27} SELECT DISTINCT (CAST(floor(px) AS INTEGER) & -8) + 8 * ox AS bx, (CAST(floor(py) AS INTEGER) & -8) + 8 * oy AS \"by\", (CAST(floor(pz) AS INTEGER) & -8) + 8 * oz AS bz FROM pts, o27""")
def enqueue_bricks(spark, sf):
    return v.bricks_around(i.points(spark, sf).select(*[F.floor(f"p{c}").cast("int").alias(f"v{c}") for c in "xyz"]))


@query("update_bricks", f"""WITH {i.VOX}, b AS (SELECT DISTINCT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz FROM vox WHERE label = 3),
    c AS (SELECT bx + x AS vx, \"by\" + y AS vy, bz + z AS vz FROM b, (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS z)),
    n AS (SELECT vx, vy, vz, (vx + vy + vz) * 0.01::DOUBLE - 0.5 AS d, CAST((vx + vz) % 3 AS DOUBLE) AS w FROM c),
    u AS (SELECT vx, vy, vz, d, w FROM vox UNION ALL SELECT CAST(vx AS INTEGER), CAST(vy AS INTEGER), CAST(vz AS INTEGER), d, w FROM n WHERE w > 0 AND d BETWEEN -1.0 AND 1.2)
    SELECT vx, vy, vz, round(sum(d * w) / sum(w), 6) AS d, round(least(sum(w), 5.0), 6) AS w FROM u GROUP BY ALL""")
def update_bricks(spark, sf):
    vox = i.voxels(spark, sf)
    bricks = vox.filter("label = 3").select(*[g.brick(f"v{c}").alias(f"b{c}") for c in "xyz"]).distinct()
    made = v.update(bricks, vox, lambda c: c.withColumns({"d": (F.col("vx") + F.col("vy") + F.col("vz")) * 0.01 - 0.5, "w": ((F.col("vx") + F.col("vz")) % 3).cast("double")}))
    return made.select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))


@query("smooth_box", f"WITH {i.VOX}, {_STENCIL.format(t='vox')} SELECT vx, vy, vz, round(wd / ww + 3.7e-12, 9) + 0.0::DOUBLE AS d, round(ww / 27, 9) AS w FROM inside")
def smooth_box(spark, sf):
    return v.smooth(i.voxels(spark, sf)).select("vx", "vy", "vz", r(F.col("d") + OFF_TIES, 9).alias("d"), r("w", 9).alias("w"))


_EXTENDED = f"""WITH {i.VOX}, {_STENCIL.format(t='vox')}, ext AS (SELECT vx, vy, vz, d, w FROM vox UNION ALL
    SELECT vx, vy, vz, wd / ww, ww / n FROM inside ANTI JOIN vox USING (vx, vy, vz))"""


@query("extend_fill", f"{_EXTENDED} SELECT vx, vy, vz, round(d + 3.7e-12, 9) + 0.0::DOUBLE AS d, round(w, 9) AS w FROM ext")
def extend_fill(spark, sf):
    return v.extend(i.voxels(spark, sf)).select("vx", "vy", "vz", r(F.col("d") + OFF_TIES, 9).alias("d"), r("w", 9).alias("w"))


@query("extend_decay", f"""WITH {i.VOX}, {_OFFSETS27}, spread AS (SELECT vx + ox AS vx, vy + oy AS vy, vz + oz AS vz, d, w, exp(-0.5 * sqrt(ox * ox + oy * oy + oz * oz)) AS k FROM vox, o27),
    bricks AS (SELECT DISTINCT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz FROM vox),
    sums AS (SELECT vx, vy, vz, sum(k * w * d) AS wd, sum(k * w) AS ww, sum(k) AS k FROM spread GROUP BY ALL),
    inside AS (SELECT sums.* FROM sums JOIN bricks ON (vx & -8) = bx AND (vy & -8) = \"by\" AND (vz & -8) = bz)
    SELECT vx, vy, vz, round(d + 3.7e-12, 9) + 0.0::DOUBLE AS d, round(w, 9) AS w FROM (SELECT vx, vy, vz, d, w FROM vox UNION ALL SELECT vx, vy, vz, wd / ww, ww / k FROM inside ANTI JOIN vox USING (vx, vy, vz))""")
def extend_decay(spark, sf):
    return v.extend(i.voxels(spark, sf), v.decay_kernel(0.5)).select("vx", "vy", "vz", r(F.col("d") + OFF_TIES, 9).alias("d"), r("w", 9).alias("w"))


def _fill_round(t: str, n: int) -> str:
    return f"""s{n} AS (SELECT vx + ox AS vx, vy + oy AS vy, vz + oz AS vz, sum(w * d) AS wd, sum(w) AS ww, count(*) AS n FROM {t}, o27 GROUP BY 1, 2, 3),
    e{n} AS (SELECT vx, vy, vz, d, w FROM {t} UNION ALL SELECT vx, vy, vz, wd / ww, ww / n FROM s{n} JOIN bricks ON (vx & -8) = bx AND (vy & -8) = \"by\" AND (vz & -8) = bz ANTI JOIN {t} USING (vx, vy, vz))"""


@query("hole_fill_3", f"""WITH {i.VOX}, {_OFFSETS27}, bricks AS (SELECT DISTINCT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz FROM vox), {_fill_round('vox', 1)}, {_fill_round('e1', 2)}, {_fill_round('e2', 3)}
    SELECT vx, vy, vz, round(d + 3.7e-12, 9) + 0.0::DOUBLE AS d, round(w, 9) AS w FROM e3""")
def hole_fill_3(spark, sf):
    return v.fill_holes(i.voxels(spark, sf), 3).select("vx", "vy", "vz", r(F.col("d") + OFF_TIES, 9).alias("d"), r("w", 9).alias("w"))


_MINMAX = ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in ("vx", "vy", "vz"))


@query("bbox_all", f"WITH {i.VOX} SELECT {_MINMAX} FROM vox")
def bbox_all(spark, sf):
    return v.bounding_box(i.voxels(spark, sf))


@query("bbox_bricks", f"WITH {i.VOX} SELECT {', '.join(f'min(v{c} & -8) AS min_v{c}, max(v{c} & -8) + 8 AS end_v{c}' for c in 'xyz')} FROM vox")
def bbox_bricks(spark, sf):
    return v.brick_box(i.voxels(spark, sf))


@query("bbox_by_label", f"WITH {i.VOX} SELECT label, {_MINMAX} FROM vox GROUP BY label")
def bbox_by_label(spark, sf):
    return v.bounding_box(i.voxels(spark, sf), "label")


@query("bbox_oriented", f"WITH {i.VOX}, t AS (SELECT label, {_TURNED[0]} AS u, {_TURNED[1]} AS t, vz FROM vox) SELECT label, round(min(u), 9) AS u0, round(max(u), 9) AS u1, round(min(t), 9) AS t0, round(max(t), 9) AS t1, min(vz) AS z0, max(vz) AS z1 FROM t GROUP BY label")
def bbox_oriented(spark, sf):
    u, t = g.rotated(F.col("vx") - 16, F.col("vy") - 15, F.lit(0.5))
    return i.voxels(spark, sf).groupBy("label").agg(r(F.min(u), 9).alias("u0"), r(F.max(u), 9).alias("u1"), r(F.min(t), 9).alias("t0"), r(F.max(t), 9).alias("t1"), F.min("vz").alias("z0"), F.max("vz").alias("z1"))


_HIST = f"{i.VOX}, hist AS (SELECT vx // 4 AS hx, vy // 4 AS hy, count(*) AS n FROM vox GROUP BY ALL)"
_INTEGRAL = f"""{_HIST}, dense AS (SELECT CAST(x AS INTEGER) AS hx, CAST(y AS INTEGER) AS hy, coalesce(n, 0) AS n FROM (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y) LEFT JOIN hist ON hx = x AND hy = y),
    integral AS (SELECT a.hx, a.hy, CAST(sum(b.n) AS BIGINT) AS total FROM dense a JOIN dense b ON b.hx <= a.hx AND b.hy <= a.hy GROUP BY ALL)"""


@query("hist2d", f"WITH {_HIST} SELECT * FROM hist")
def hist2d(spark, sf):
    return v.histogram2d(i.voxels(spark, sf))


@query("integral2d", f"WITH {_INTEGRAL} SELECT * FROM integral")
def integral2d(spark, sf):
    return v.integral2d(v.histogram2d(i.voxels(spark, sf)), 8, 8)


@query("min_area_rect", f"""WITH {_INTEGRAL}, whole AS (SELECT sum(n) AS n FROM dense), e AS (SELECT x0, x1, y0, y1 FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS x0), (SELECT CAST(unnest(range(8)) AS INTEGER) AS x1), (SELECT CAST(unnest(range(8)) AS INTEGER) AS y0), (SELECT CAST(unnest(range(8)) AS INTEGER) AS y1) WHERE x0 <= x1 AND y0 <= y1)
    SELECT x0, y0, x1, y1, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS area, CAST((SELECT sum(n) FROM dense WHERE hx BETWEEN x0 AND x1 AND hy BETWEEN y0 AND y1) AS BIGINT) AS held
    FROM e WHERE held >= 100 ORDER BY area, x0, y0, x1, y1 LIMIT 1""")
def min_area_rect(spark, sf):
    return v.smallest_rectangle(v.integral2d(v.histogram2d(i.voxels(spark, sf)), 8, 8), 100)


@query("transform_identity", f"WITH {i.VOX} SELECT vx, vy, vz, round(d, 6) AS d, round(w, 6) AS w FROM vox")
def transform_identity(spark, sf):
    return v.transform(i.voxels(spark, sf), 0.0, (0.0, 0.0, 0.0)).select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))


_GRID = """own AS (SELECT row_number() OVER (ORDER BY obb_id, ix, iy, iz) AS pid, obb_id, ix, iy, iz,
    cx + (ix / 4.0::DOUBLE - 0.5) * lx * cos(theta) - (iy / 4.0::DOUBLE - 0.5) * ly * sin(theta) AS px,
    cy + (ix / 4.0::DOUBLE - 0.5) * lx * sin(theta) + (iy / 4.0::DOUBLE - 0.5) * ly * cos(theta) AS py, bz + iz / 2.0::DOUBLE * lz AS pz
    FROM boxes, (SELECT CAST(unnest(range(5)) AS INTEGER) AS ix), (SELECT CAST(unnest(range(5)) AS INTEGER) AS iy), (SELECT CAST(unnest(range(3)) AS INTEGER) AS iz)), pts AS (SELECT pid, px, py, pz FROM own)"""


@query("sample_boxes", f"""WITH {i.VOX}, {i.BOXES}, {_GRID}, {_CORNERS}, t AS (SELECT pid, sum(share * d) / sum(share) AS d, sum(share * w) / sum(share) AS w FROM met GROUP BY pid HAVING sum(share) > 0.4)
    SELECT obb_id, count(*) AS n, round(avg(d), 4) + 0.0::DOUBLE AS mean_d, round(sum(w), 4) AS sum_w FROM t JOIN own USING (pid) GROUP BY obb_id""")
def sample_boxes(spark, sf):
    s = v.resample_box(i.voxels(spark, sf), i.boxes(spark, sf), (5, 5, 3))
    return s.groupBy("obb_id").agg(F.count("*").alias("n"), r(F.avg("d"), 4).alias("mean_d"), r(F.sum("w"), 4).alias("sum_w"))


@query("sample_boxes_nearest", f"""WITH {i.VOX}, {i.BOXES}, {_GRID} SELECT obb_id, count(*) AS n, round(avg(d), 4) + 0.0::DOUBLE AS mean_d FROM own JOIN vox ON vx = CAST(round(px) AS INTEGER) AND vy = CAST(round(py) AS INTEGER) AND vz = CAST(round(pz) AS INTEGER) GROUP BY obb_id""")
def sample_boxes_nearest(spark, sf):
    s = v.resample_box(i.voxels(spark, sf), i.boxes(spark, sf), (5, 5, 3), nearest_only=True)
    return s.groupBy("obb_id").agg(F.count("*").alias("n"), r(F.avg("d"), 4).alias("mean_d"))


@query("mask_by_template", f"WITH {i.VOX} SELECT a.vx, a.vy, a.vz, round(a.d, 6) AS d FROM vox a SEMI JOIN (SELECT vx, vy, vz FROM vox WHERE label = 2) b USING (vx, vy, vz)")
def mask_by_template(spark, sf):
    vox = i.voxels(spark, sf)
    return v.ordered_like(vox.filter("label = 2"), vox).select("vx", "vy", "vz", r("d").alias("d"))


@query("flagship", f"""WITH {i.VOX_COARSE} SELECT vx & -8 AS bx, vy & -8 AS \"by\", vz & -8 AS bz, count(*) AS occupied, round(avg(d), 6) + 0.0::DOUBLE AS mean_d, min(vx) AS min_vx, max(vx) AS max_vx, min(vz) AS min_vz, max(vz) AS max_vz FROM vox GROUP BY 1, 2, 3""")
def flagship(spark, sf):
    """Observations to fused voxels to brick summaries."""
    vox = i.voxels(spark, sf, True)
    return vox.groupBy(*[g.brick(f"v{c}").alias(f"b{c}") for c in "xyz"]).agg(F.count("*").alias("occupied"), r(F.avg("d")).alias("mean_d"), F.min("vx").alias("min_vx"), F.max("vx").alias("max_vx"), F.min("vz").alias("min_vz"), F.max("vz").alias("max_vz"))


@query("oriented_boxes", f"""WITH {i.VOX}, t AS (SELECT label, vx * cos(0.4) + vy * sin(0.4) AS u, vy * cos(0.4) - vx * sin(0.4) AS t, vz FROM vox)
    SELECT label, round((min(u) + max(u)) / 2 * cos(0.4) - (min(t) + max(t)) / 2 * sin(0.4), 6) + 0.0::DOUBLE AS cx, round(max(u) - min(u), 6) AS lx, round(max(t) - min(t), 6) AS ly, CAST(max(vz) - min(vz) AS DOUBLE) AS lz FROM t GROUP BY label""")
def oriented_boxes(spark, sf):
    return v.oriented_box(i.voxels(spark, sf), 0.4, "label").select("label", r("cx").alias("cx"), r("lx").alias("lx"), r("ly").alias("ly"), "lz")
