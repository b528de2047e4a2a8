"""Queries of posed views, and of the volume operators that belong to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geometry import r
from tessera.operators import cameras as c
from tessera.operators import depth as d
from tessera.operators import volume as v
from tessera.plans import inputs as i
from tessera.plans.registry import query

FRAMES = 6


def cameras(spark):
    """Six cameras along a curve, each turned a little further about z."""
    f = F.col("id").cast("int")
    turn = F.array(F.cos(0.05 * f), -F.sin(0.05 * f), F.lit(0.0), F.sin(0.05 * f), F.cos(0.05 * f), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return spark.range(FRAMES).select(f.alias("frame"), turn.alias("r"), (0.1 * f).alias("cx"), (0.25 * f).alias("cy"), (0.05 * f).alias("cz"))


def views(spark, sf):
    """The pixels with confidence, label and sky."""
    x, y = F.col("x"), F.col("y")
    return i.pixels(spark, sf).select("*", ((x * 7 + y * 3) % 5 / 4.0).alias("conf"), ((x + y) % 4).cast("int").alias("label"), F.when((x * 3 + y) % 7 == 0, F.lit(1)).otherwise(F.lit(0)).alias("sky"))


CAMS = f"cams AS (SELECT CAST(f AS INTEGER) AS frame, cos(0.05 * f) AS ca, sin(0.05 * f) AS sa, 0.1::DOUBLE * f AS cx, 0.25::DOUBLE * f AS cy, 0.05::DOUBLE * f AS cz FROM range({FRAMES}) t(f))"
VIEWS = "views AS (SELECT *, (x * 7 + y * 3) % 5 / 4.0::DOUBLE AS conf, CAST((x + y) % 4 AS INTEGER) AS label, CASE WHEN (x * 3 + y) % 7 = 0 THEN 1 ELSE 0 END AS sky FROM pixels)"
_TH = "(pi() / 128 + {x} * (pi() / 64))"
_PH = "(-pi() / 2 + pi() / 128 + {y} * (pi() / 64))"


def _lift(source: str, out: str) -> str:
    """The points of a table (.., frame, y, x, depth) in the world."""
    th, ph = _TH.format(x="x"), _PH.format(y="y")
    return f"""{out}_l AS (SELECT *, depth * sin({th}) * cos({ph}) AS px, depth * sin({th}) * sin({ph}) AS py, depth * cos({th}) AS pz FROM {source} WHERE depth > 0),
    {out} AS (SELECT l.* EXCLUDE (px, py, pz), ca * px - sa * py + cx AS wx, sa * px + ca * py + cy AS wy, pz + cz AS wz FROM {out}_l l JOIN cams USING (frame))"""


def _put(source: str, out: str) -> str:
    """A table (.., frame, wx, wy, wz) with its pixels iy, ix and length in that frame."""
    return f"""{out}_a AS (SELECT s.*, ca * (wx - cx) + sa * (wy - cy) AS ax, ca * (wy - cy) - sa * (wx - cx) AS ay, wz - cz AS az FROM {source} s JOIN cams USING (frame)),
    {out}_b AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS length FROM {out}_a WHERE ax > 0), {out}_c AS (SELECT *, acos(az / length) AS th FROM {out}_b),
    {out}_d AS (SELECT * EXCLUDE (ax, ay, az, th), CAST(round((th - pi() / 128) / (pi() / 64)) AS INTEGER) AS ix, CAST(round((asin(greatest(-1, least(1, ay / length / sin(th)))) - (-pi() / 2 + pi() / 128)) / (pi() / 64)) AS INTEGER) AS iy FROM {out}_c),
    {out} AS (SELECT * FROM {out}_d WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63)"""


_BASE = f"{i.PIXELS}, {VIEWS}, {CAMS}"
_CLOUD = f"{_BASE}, {_lift('pixels', 'cloud')}"
_CAND = f"{_CLOUD}, src AS (SELECT frame AS source, 0 AS frame, wx, wy, wz FROM cloud WHERE depth <= 30), {_put('src', 'placed')}, cand AS (SELECT iy AS y, ix AS x, source AS frame, min(length) AS depth FROM placed WHERE length <= 30 GROUP BY ALL)"
_DISP = "(pi() / 2 + atan(-({d} + cos({t})) / sin({t})))"


@query("relative_pose", f"""WITH {CAMS} SELECT a.frame, b.frame AS other, round(a.ca * b.ca + a.sa * b.sa, 8) AS r0, round(a.ca * b.sa - a.sa * b.ca, 8) + 0.0::DOUBLE AS r1,
    round(b.ca * (a.cx - b.cx) + b.sa * (a.cy - b.cy), 8) + 0.0::DOUBLE AS tx, round(b.ca * (a.cy - b.cy) - b.sa * (a.cx - b.cx), 8) + 0.0::DOUBLE AS ty, round(a.cz - b.cz, 8) + 0.0::DOUBLE AS tz FROM cams a JOIN cams b ON a.frame <> b.frame""")
def relative_pose(spark, sf):
    cams = cameras(spark)
    pairs = d.within(cams.select("frame"), FRAMES)
    return c.relative(pairs.withColumnRenamed("partner", "other"), cams).select("frame", "other", r(F.col("r")[0], 8).alias("r0"), r(F.col("r")[1], 8).alias("r1"), *[r(f"t{k}", 8).alias(f"t{k}") for k in "xyz"])


@query("posed_cloud", f"WITH {_CLOUD} SELECT frame, y, x, round(wx, 7) + 0.0::DOUBLE AS wx, round(wy, 7) + 0.0::DOUBLE AS wy, round(wz, 7) + 0.0::DOUBLE AS wz FROM cloud")
def posed_cloud(spark, sf):
    return c.unproject(i.pixels(spark, sf), cameras(spark)).select("frame", "y", "x", *[r(f"w{k}", 7).alias(f"w{k}") for k in "xyz"])


@query("coloured_cloud", f"""WITH {_CLOUD}, t AS (SELECT *, frame * 37 % 100 / 100.0::DOUBLE AS h FROM cloud) SELECT frame, count(*) AS n, CAST(min(floor(255 * greatest(0, least(1, 1.5 - abs(4 * h - 3))))) AS INTEGER) AS r,
    CAST(min(floor(255 * greatest(0, least(1, 1.5 - abs(4 * h - 2))))) AS INTEGER) AS g, CAST(min(floor(255 * greatest(0, least(1, 1.5 - abs(4 * h - 1))))) AS INTEGER) AS b, round(sum(wx), 4) AS wx FROM t GROUP BY frame""")
def coloured_cloud(spark, sf):
    return c.cloud(i.pixels(spark, sf), cameras(spark)).groupBy("frame").agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in "rgb"], r(F.sum("wx"), 4).alias("wx"))


@query("posed_candidates", f"WITH {_CAND} SELECT y, x, frame, round(depth, 7) AS depth FROM cand")
def posed_candidates(spark, sf):
    return c.candidates(i.pixels(spark, sf), cameras(spark), 0).withColumn("depth", r("depth", 7))


@query("fuse_visibility", f"""WITH {_CAND}, ranked AS (SELECT y, x, depth, row_number() OVER (PARTITION BY y, x ORDER BY depth, frame) - 1 AS front FROM cand), at0 AS (SELECT *, 0 AS frame FROM ranked), {_lift('at0', 'own')},
    each AS (SELECT own.* EXCLUDE (frame), cams.frame FROM own JOIN cams ON cams.frame <> 0), {_put('each', 'seen')}, looked AS (SELECT s.*, coalesce(p.depth, 0) AS there FROM seen s LEFT JOIN pixels p ON p.frame = s.frame AND p.y = s.iy AND p.x = s.ix),
    votes AS (SELECT y, x, front, count(*) FILTER (there > length + 0.05) AS through, count(*) FILTER (abs(there - length) <= 0.05) AS support, count(*) AS total FROM looked GROUP BY y, x, front),
    good AS (SELECT k.*, support / total AS conf FROM ranked k LEFT JOIN votes v ON k.y = v.y AND k.x = v.x AND k.front = v.front WHERE k.front - coalesce(through, 0) > 0)
    SELECT y, x, round(arg_min(depth, front), 6) AS depth, round(arg_min(coalesce(conf, -1), front), 6) AS conf FROM good GROUP BY y, x""")
def fuse_visibility(spark, sf):
    return c.fuse_visibility(i.pixels(spark, sf), cameras(spark), 0).select("y", "x", r("depth").alias("depth"), r(F.coalesce("conf", F.lit(-1.0))).alias("conf"))


_A = f"({_DISP.format(d='other', t=_TH.format(x='x'))} - {_DISP.format(d='depth', t=_TH.format(x='x'))})"
_B = f"({_DISP.format(d='there', t=_TH.format(x='ix'))} - {_DISP.format(d='length', t=_TH.format(x='ix'))})"


@query("fuse_disparity", f"""WITH {_CAND}, ref AS (SELECT * FROM pixels WHERE frame = 0 AND depth > 0 AND depth <= 30 AND x BETWEEN 4 AND 59), {_lift('ref', 'own')},
    here AS (SELECT o.* EXCLUDE (frame), k.frame, k.depth AS other FROM own o JOIN cand k ON o.y = k.y AND o.x = k.x), {_put('here', 'seen')}, looked AS (SELECT s.*, coalesce(p.depth, 0) AS there FROM seen s LEFT JOIN pixels p ON p.frame = s.frame AND p.y = s.iy AND p.x = s.ix),
    one AS (SELECT y, x, min(depth) AS depth, count(*) FILTER ({_A} > pi() / 64) AS occ, count(*) FILTER (abs({_A}) <= pi() / 64) AS near FROM here GROUP BY y, x),
    two AS (SELECT y, x, count(*) FILTER ({_B} < -pi() / 64) AS through, count(*) FILTER (abs({_B}) <= pi() / 64) AS near FROM looked GROUP BY y, x),
    sides AS (SELECT y, x, depth, one.near + coalesce(two.near, 0) AS support, occ + coalesce(through, 0) AS against FROM one LEFT JOIN two USING (y, x))
    SELECT y, x, round(depth, 6) AS depth, round((support - against) / 10.0, 6) AS conf FROM sides WHERE (support - against) / 10.0 > 0.1 AND support >= 4""")
def fuse_disparity(spark, sf):
    return c.fuse_disparity(i.pixels(spark, sf), cameras(spark), 0).withColumns({"depth": r("depth"), "conf": r("conf")})


_VISIBLE = "sqrt(pow(wx - cx, 2) + pow(wy - cy, 2) + pow(wz - cz, 2))"
_AHEAD = "(ca * (wx - cx) + sa * (wy - cy))"


@query("visible_points", f"WITH {i.POINTS}, {CAMS}, q AS (SELECT pid, px AS wx, py AS wy, pz AS wz FROM pts) SELECT pid, frame FROM q, cams WHERE {_VISIBLE} <= 30 AND {_AHEAD} > 0 AND {_AHEAD} / {_VISIBLE} > 0.05")
def visible_points(spark, sf):
    p = i.points(spark, sf).select("pid", *[F.col(f"p{k}").alias(f"w{k}") for k in "xyz"])
    return c.visible(p, cameras(spark))


_SEEN_BOXES = f"centres AS (SELECT obb_id, cx AS wx, cy AS wy, bz + lz / 2 AS wz FROM boxes), seen_by AS (SELECT obb_id, frame FROM centres, cams WHERE {_VISIBLE} <= 30 AND {_AHEAD} > 0 AND {_AHEAD} / {_VISIBLE} > 0.05)"


@query("visible_cameras", f"WITH {i.BOXES}, {CAMS}, {_SEEN_BOXES} SELECT * FROM seen_by")
def visible_cameras(spark, sf):
    return c.visible_cameras(i.boxes(spark, sf), cameras(spark))


_SLACK = f"(4 * sin({_TH.format(x='ix')}) / pow(sin({_DISP.format(d='there', t=_TH.format(x='ix'))}), 2) * (pi() / 64))"
_GONE = f"""{_BASE}, {i.BOXES}, {_SEEN_BOXES}, {i.FACES}, {i.VERTICES},
    inside AS (SELECT vid, obb_id, x, y, z FROM verts JOIN boxes ON abs((x - cx) * cos(theta) + (y - cy) * sin(theta)) <= lx / 2 AND abs((y - cy) * cos(theta) - (x - cx) * sin(theta)) <= ly / 2 AND z BETWEEN bz AND bz + lz),
    asked AS (SELECT vid, obb_id, frame, x AS wx, y AS wy, z AS wz FROM inside JOIN seen_by USING (obb_id)), {_put('asked', 'put')},
    looked AS (SELECT s.*, p.depth AS there, p.sky FROM put s LEFT JOIN views p ON p.frame = s.frame AND p.y = s.iy AND p.x = s.ix),
    votes AS (SELECT vid, obb_id, count(*) FILTER (sky > 0) AS skies, count(*) FILTER (there > 0 AND abs(there - length) < {_SLACK}) AS agree, count(*) FILTER (there > 0 AND there - length > {_SLACK}) AS past FROM looked GROUP BY ALL),
    gone AS (SELECT DISTINCT vid FROM votes WHERE skies > 0 OR (past > 0 AND past / (past + agree) > 0.5))"""


def _gone(spark, sf):
    return c.check_vertices(i.vertices(spark, sf), i.boxes(spark, sf), views(spark, sf), cameras(spark), sky_limit=0)


@query("check_vertices", f"WITH {_GONE} SELECT vid FROM gone")
def check_vertices(spark, sf):
    return _gone(spark, sf)


@query("clean_mesh_views", f"WITH {_GONE} SELECT fid FROM faces WHERE v0 NOT IN (SELECT vid FROM gone) AND v1 NOT IN (SELECT vid FROM gone) AND v2 NOT IN (SELECT vid FROM gone)")
def clean_mesh_views(spark, sf):
    return c.clean_mesh(i.faces(spark, sf), i.vertices(spark, sf), i.boxes(spark, sf), views(spark, sf), cameras(spark), sky_limit=0).select("fid")


@query("clean_volume_views", f"""WITH {_GONE}, {i.VOX}, spots AS (SELECT CAST(round(x) AS INTEGER) AS sx, CAST(round(y) AS INTEGER) AS sy, CAST(round(z) AS INTEGER) AS sz FROM verts WHERE vid IN (SELECT vid FROM gone))
    SELECT vx, vy, vz FROM vox WHERE NOT EXISTS (SELECT 1 FROM spots WHERE vx - sx BETWEEN -1 AND 1 AND vy - sy BETWEEN -1 AND 1 AND vz - sz BETWEEN -1 AND 1)""")
def clean_volume_views(spark, sf):
    return c.clean_volume(i.voxels(spark, sf), i.vertices(spark, sf), _gone(spark, sf), -1, 2).select(*v.KEY)


_RAMP = "(CASE WHEN d >= -0.04 THEN 1.0 WHEN d >= -0.6 THEN 0.05 + (d + 0.6) / 0.56 * 0.95 ELSE (d + 1.0) / 0.4 * 0.05 END)"


@query("integrate_views", f"""WITH {_CLOUD}, b0 AS (SELECT DISTINCT frame, CAST(round((wx - 0.013) / 0.5) AS INTEGER) & -8 AS bx, CAST(round((wy - 0.027) / 0.5) AS INTEGER) & -8 AS by_, CAST(round((wz - 0.041) / 0.5) AS INTEGER) & -8 AS bz FROM cloud),
    bricks AS (SELECT DISTINCT frame, bx + 8 * i AS bx, by_ + 8 * j AS by_, bz + 8 * k AS bz FROM b0, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)),
    cells AS (SELECT frame, bx + i AS vx, by_ + j AS vy, bz + k AS vz FROM bricks, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i), (SELECT CAST(unnest(range(8)) AS INTEGER) AS j), (SELECT CAST(unnest(range(8)) AS INTEGER) AS k)),
    world AS (SELECT *, vx * 0.5::DOUBLE + 0.013 AS wx, vy * 0.5::DOUBLE + 0.027 AS wy, vz * 0.5::DOUBLE + 0.041 AS wz FROM cells), {_put('world', 'put')},
    obs0 AS (SELECT s.frame AS seq, vx, vy, vz, p.depth - length AS d, p.conf, p.label FROM put s JOIN views p ON p.frame = s.frame AND p.y = s.iy AND p.x = s.ix WHERE p.conf > 0 AND p.depth - length BETWEEN -1.0 AND 1.2),
    obs AS (SELECT seq, vx, vy, vz, d, {_RAMP} * conf AS w, label FROM obs0 WHERE {_RAMP} * conf > 0), {i.VOX_BODY} SELECT vx, vy, vz, round(d, 6) + 0.0::DOUBLE AS d, round(w, 6) AS w, label FROM vox""")
def integrate_views(spark, sf):
    return c.integrate(views(spark, sf), cameras(spark), origin=(0.013, 0.027, 0.041)).withColumns({"d": r("d"), "w": r("w")})


@query("remove_low_confidence", f"WITH {_BASE} SELECT frame, count(*) FILTER (conf > 0.5) AS kept, round(sum(CASE WHEN conf > 0.5 THEN depth ELSE 0 END), 2) AS total FROM views GROUP BY frame")
def remove_low_confidence(spark, sf):
    return d.remove_low_confidence(views(spark, sf), 0.5).groupBy("frame").agg(F.count_if(F.col("depth") > 0).alias("kept"), r(F.sum("depth"), 2).alias("total"))


@query("clear_near", f"WITH {i.VOX}, {i.POINTS}, s AS (SELECT CAST(round(px) AS INTEGER) AS sx, CAST(round(py) AS INTEGER) AS sy, CAST(round(pz) AS INTEGER) AS sz FROM pts) SELECT vx, vy, vz FROM vox WHERE NOT EXISTS (SELECT 1 FROM s WHERE vx - sx BETWEEN -2 AND 1 AND vy - sy BETWEEN -2 AND 1 AND vz - sz BETWEEN -2 AND 1)")
def clear_near(spark, sf):
    return v.clear_near(i.voxels(spark, sf), i.points(spark, sf), -2, 2).select(*v.KEY)


@query("range_template", f"""WITH {i.POINTS}, o AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS o) SELECT DISTINCT CAST(round(px) AS INTEGER) + a.o AS vx, CAST(round(py) AS INTEGER) + b.o AS vy, CAST(round(pz) AS INTEGER) + c.o AS vz FROM pts, o a, o b, o c""")
def range_template(spark, sf):
    return v.range_template(i.points(spark, sf), 0.6).select(*v.KEY)


@query("brick_table", f"""WITH {i.VOX}, k AS (SELECT DISTINCT vx & -8 AS x, vy & -8 AS y, vz & -8 AS z FROM vox), h AS (SELECT xor(xor((x >> 3) * 73856093::BIGINT, (y >> 3) * 19349669::BIGINT), (z >> 3) * 83492791::BIGINT) % 7 AS bucket FROM k),
    n AS (SELECT (bucket + 7) % 7 AS bucket, count(*) AS n FROM h GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS bricks, count(*) AS used, CAST(sum(n) - count(*) AS BIGINT) AS collisions, max(n) AS fullest FROM n""")
def brick_table(spark, sf):
    return v.brick_table(i.voxels(spark, sf), 7)


@query("transposed_plane", f"WITH {i.VOX} SELECT vy AS a, vx AS b, round(d, 7) + 0.0::DOUBLE AS d, round(w, 7) AS w FROM vox WHERE vz = 12")
def transposed_plane(spark, sf):
    return v.plane(v.transposed(i.voxels(spark, sf), "yxz"), "z", 12).withColumns({"d": r("d", 7), "w": r("w", 7)})


@query("matrix_volumes", f"WITH {i.CELLS} SELECT sample, CAST(idx // 16 AS INTEGER) AS vx, CAST(idx // 4 % 4 AS INTEGER) AS vy, CAST(idx % 4 AS INTEGER) AS vz, round(val, 6) + 0.0::DOUBLE AS d, least(w, 5.0::DOUBLE) AS w FROM cells WHERE w >= 1")
def matrix_volumes(spark, sf):
    return v.to_columns(i.cells(spark, sf), 4, 4, 1.0).withColumn("d", r("d"))


_VOLS = f"{i.CELLS}, vols AS (SELECT sample, idx // 16 AS vx, idx // 4 % 4 AS vy, idx % 4 AS vz, val AS d, w FROM cells WHERE w > 0), mean AS (SELECT vx, vy, vz, sum(d * w) / sum(w) AS mean FROM vols GROUP BY ALL), cen AS (SELECT sample, vx, vy, vz, mean, d - mean AS centred, w FROM vols JOIN mean USING (vx, vy, vz))"


def _volumes(spark, sf):
    return v.data_matrix(v.to_columns(i.cells(spark, sf), 4, 4))


@query("data_matrix", f"WITH {_VOLS} SELECT sample, CAST(vx AS INTEGER) AS vx, CAST(vy AS INTEGER) AS vy, CAST(vz AS INTEGER) AS vz, round(mean, 7) + 0.0::DOUBLE AS mean, round(centred, 7) + 0.0::DOUBLE AS centred FROM cen")
def data_matrix(spark, sf):
    return _volumes(spark, sf).select("sample", *v.KEY, r("mean", 7).alias("mean"), r("centred", 7).alias("centred"))


@query("sample_gram", f"WITH {_VOLS} SELECT a.sample AS a, b.sample AS b, round(sum(a.centred * b.centred * sqrt(a.w * b.w)) / sum(sqrt(a.w * b.w)), 7) + 0.0::DOUBLE AS product FROM cen a JOIN cen b ON a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz AND a.sample <= b.sample GROUP BY ALL")
def sample_gram(spark, sf):
    return v.gram(_volumes(spark, sf), 7)
