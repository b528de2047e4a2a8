"""Queries of the further mesh operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geometry import r
from tessera.operators import boxes as b
from tessera.operators import mesh as m
from tessera.operators import meshtools as t
from tessera.plans import inputs as i
from tessera.plans.detect_queries import _draw
from tessera.plans.mesh_queries import _EDGES, _P
from tessera.plans.registry import query

_MESH = f"{i.FACES}, {i.VERTICES}"
_GEO = f"{_MESH}, {_P}"
_UNIT = "unit AS (SELECT fid, v0, v1, v2, nx / size AS nx, ny / size AS ny, nz / size AS nz, size / 2 AS area FROM geo)"
_FULL = f"{_EDGES}, {i.VERTICES}, {_P}, {_UNIT}"


def _mesh(spark, sf):
    return i.faces(spark, sf), i.vertices(spark, sf)


@query("close_pairs", f"WITH {_MESH} SELECT a.vid AS a, b.vid AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 7) AS distance FROM verts a JOIN verts b ON a.vid < b.vid AND abs(a.x - b.x) <= 1.2 AND abs(a.y - b.y) <= 1.2 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 1.2")
def close_pairs(spark, sf):
    return t.close_pairs(i.vertices(spark, sf).withColumnRenamed("vid", "pid"), 1.2).withColumn("distance", r("distance", 7))


@query("weld_radius")
def weld_radius(spark, sf):
    """Faces on the vertices that a radius of 1.2 welds, and where these lie."""
    f, v = _mesh(spark, sf)
    targets = t.weld_radius(v, 1.2)
    left = m.flatten(f, targets)
    return left.join(t.merged(v, targets, 1.2).withColumnRenamed("vid", "v0"), "v0").select("fid", "v0", "v1", "v2", *[r(c).alias(c) for c in "xyz"])


@query("drop_lone_faces", f"""WITH RECURSIVE {_GEO}, near AS (SELECT a.fid AS f, b.fid AS g FROM geo a JOIN geo b ON abs(a.cx - b.cx) <= 0.6 AND abs(a.cy - b.cy) <= 0.6 WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) <= 0.6),
    reach(f, g) AS (SELECT fid, fid FROM geo UNION SELECT reach.f, near.g FROM reach JOIN near ON reach.g = near.f), comp AS (SELECT g AS fid, min(f) AS c FROM reach GROUP BY g)
    SELECT fid FROM comp WHERE c IN (SELECT c FROM comp GROUP BY c HAVING count(*) > 1)""")
def drop_lone_faces(spark, sf):
    return t.drop_lone_faces(*_mesh(spark, sf), 0.6, 1).select("fid")


@query("moved_mesh", f"WITH {_MESH} SELECT vid, round(0.5::DOUBLE * x - 2.0::DOUBLE * y + 3.0::DOUBLE, 7) + 0.0::DOUBLE AS x, round(2.0::DOUBLE * x + 0.5::DOUBLE * y, 7) + 0.0::DOUBLE AS y, round(1.5::DOUBLE * z - 1.0::DOUBLE, 7) + 0.0::DOUBLE AS z FROM verts")
def moved_mesh(spark, sf):
    return t.moved(i.vertices(spark, sf), [0.5, -2, 0, 3, 2, 0.5, 0, 0, 0, 0, 1.5, -1]).select("vid", *[r(c, 7).alias(c) for c in "xyz"])


@query("flipped_normals", f"WITH {_GEO}, {_UNIT} SELECT fid, round(-nx, 7) + 0.0::DOUBLE AS nx, round(-nz, 7) + 0.0::DOUBLE AS nz FROM unit")
def flipped_normals(spark, sf):
    f, v = _mesh(spark, sf)
    return m.face_geometry(t.flipped(f), v).select("fid", r("nx", 7).alias("nx"), r("nz", 7).alias("nz"))


@query("inflated_mesh", f"""WITH {_GEO}, {_UNIT}, s AS (SELECT unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM unit), n AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM s GROUP BY vid)
    SELECT vid, round(x + 0.3 * nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0::DOUBLE AS x, round(z + 0.3 * nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0::DOUBLE AS z FROM verts JOIN n USING (vid)""")
def inflated_mesh(spark, sf):
    return t.inflated(*_mesh(spark, sf), 0.3).select("vid", r("x").alias("x"), r("z").alias("z"))


@query("noisy_mesh", f"WITH {_MESH} SELECT vid, round(x + 0.2 * (2 * {_draw('vid', '0', '0')} - 1), 7) + 0.0::DOUBLE AS x, round(z + 0.2 * (2 * {_draw('vid', '0', '2')} - 1), 7) + 0.0::DOUBLE AS z FROM verts")
def noisy_mesh(spark, sf):
    return t.noisy(i.vertices(spark, sf), 0.2).select("vid", r("x", 7).alias("x"), r("z", 7).alias("z"))


@query("mesh_bounds", f"""WITH {_MESH}, b AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM verts)
    SELECT *, (SELECT round(max(sqrt(pow(x - (min_x + max_x) / 2, 2) + pow(y - (min_y + max_y) / 2, 2) + pow(z - (min_z + max_z) / 2, 2))), 7) FROM verts) AS radius FROM b""")
def mesh_bounds(spark, sf):
    return t.bounds(i.vertices(spark, sf)).drop("mid_x", "mid_y", "mid_z").withColumn("radius", r("radius", 7))


@query("box_union", f"""WITH {_MESH}, {i.POINTS}, u AS (SELECT x, y, z FROM verts UNION ALL SELECT px, py, pz FROM pts) SELECT {", ".join(f"round(min({c}), 7) + 0.0::DOUBLE AS min_{c}, round(max({c}), 7) AS max_{c}" for c in "xyz")} FROM u""")
def box_union(spark, sf):
    box = lambda df: t.bounds(df).drop("radius", "mid_x", "mid_y", "mid_z")
    out = t.box_union(box(i.vertices(spark, sf)), box(i.points(spark, sf).withColumnsRenamed({f"p{c}": c for c in "xyz"})))
    return out.select(*[r(c, 7).alias(c) for c in out.columns])


@query("box_distance", f"WITH {i.POINTS} SELECT pid, round(sqrt(pow(greatest(10 - px, 0, px - 20), 2) + pow(greatest(11 - py, 0, py - 19), 2) + pow(greatest(8 - pz, 0, pz - 14), 2)), 7) AS distance FROM pts")
def box_distance(spark, sf):
    p = i.points(spark, sf).withColumnsRenamed({f"p{c}": c for c in "xyz"})
    return t.box_distance(p, (10, 11, 8), (20, 19, 14)).withColumn("distance", r("distance", 7))


_LENGTHS = f"{_EDGES}, {i.VERTICES}, lens AS (SELECT e.a, e.b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS length FROM (SELECT DISTINCT a, b FROM edges) e JOIN verts p ON p.vid = e.a JOIN verts q ON q.vid = e.b)"


@query("edge_lengths", f"WITH {_LENGTHS} SELECT a, b, round(length, 8) AS length FROM lens")
def edge_lengths(spark, sf):
    return t.edge_lengths(*_mesh(spark, sf)).withColumn("length", r("length", 8))


@query("feature_size", f"WITH {_LENGTHS} SELECT round(quantile_cont(length, 0.5), 8) AS size FROM lens")
def feature_size(spark, sf):
    return t.feature_size(*_mesh(spark, sf)).withColumn("size", r("size", 8))


_COS = "(({a}x - {o}x) * ({b}x - {o}x) + ({a}y - {o}y) * ({b}y - {o}y) + ({a}z - {o}z) * ({b}z - {o}z)) / sqrt((pow({a}x - {o}x, 2) + pow({a}y - {o}y, 2) + pow({a}z - {o}z, 2)) * (pow({b}x - {o}x, 2) + pow({b}y - {o}y, 2) + pow({b}z - {o}z, 2)))"


def _angle(o: int, a: int, c: int) -> str:
    out = _COS
    for name, k in (("o", o), ("a", a), ("b", c)):
        for x in "xyz":
            out = out.replace("{" + name + "}" + x, f"{x}{k}")
    return f"acos(greatest(-1, least(1, {out})))"


_ANGLES = f"angles AS (SELECT fid, v0 AS vid, 0 AS k, {_angle(0, 1, 2)} AS angle FROM wide UNION ALL SELECT fid, v1, 1, {_angle(1, 2, 0)} FROM wide UNION ALL SELECT fid, v2, 2, {_angle(2, 0, 1)} FROM wide)"


@query("corner_angles", f"WITH {_GEO}, {_ANGLES} SELECT fid, k, round(angle, 6) AS angle FROM angles")
def corner_angles(spark, sf):
    return t.corner_angles(*_mesh(spark, sf)).withColumn("angle", r("angle"))


@query("dihedrals", f"""WITH {_FULL}, two AS (SELECT a, b, min(e.fid) AS f, max(e.fid) AS g FROM edges e JOIN unit USING (fid) GROUP BY a, b HAVING count(*) = 2)
    SELECT a, b, round(acos(greatest(-1, least(1, p.nx * q.nx + p.ny * q.ny + p.nz * q.nz))), 4) + 0.0::DOUBLE AS angle FROM two JOIN unit p ON p.fid = f JOIN unit q ON q.fid = g""")
def dihedrals(spark, sf):
    return t.dihedrals(*_mesh(spark, sf)).withColumn("angle", r("angle", 4))


@query("edge_normals", f"WITH {_FULL} SELECT a, b, count(*) AS n, round(sum(nx), 7) + 0.0::DOUBLE AS nx, round(sum(ny), 7) + 0.0::DOUBLE AS ny, round(sum(nz), 7) + 0.0::DOUBLE AS nz FROM edges JOIN unit USING (fid) GROUP BY a, b")
def edge_normals(spark, sf):
    return t.edge_normals(*_mesh(spark, sf)).select("a", "b", "n", *[r(f"n{c}", 7).alias(f"n{c}") for c in "xyz"])


_SQ = {(p, q): f"(pow(x{p} - x{q}, 2) + pow(y{p} - y{q}, 2) + pow(z{p} - z{q}, 2))" for p in range(3) for q in range(3)}


@query("weighted_normals", f"""WITH {_GEO}, s AS ({" UNION ALL ".join(f"SELECT v{k} AS vid, nx / w AS nx, ny / w AS ny, nz / w AS nz FROM (SELECT *, {_SQ[(k + 1) % 3, k]} * {_SQ[(k + 2) % 3, k]} AS w FROM crossed)" for k in range(3))}), n AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM s GROUP BY vid)
    SELECT vid, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 7) + 0.0::DOUBLE AS nx, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 7) + 0.0::DOUBLE AS nz FROM n""")
def weighted_normals(spark, sf):
    return t.weighted_normals(*_mesh(spark, sf)).select("vid", r("nx", 7).alias("nx"), r("nz", 7).alias("nz"))


_AREAS = "areas AS (SELECT vid, sum(area) / 3 AS area FROM (SELECT unnest([v0, v1, v2]) AS vid, area FROM unit) GROUP BY vid)"


@query("point_areas", f"WITH {_GEO}, {_UNIT}, {_AREAS} SELECT vid, round(area, 7) AS area FROM areas")
def point_areas(spark, sf):
    return t.point_areas(*_mesh(spark, sf)).withColumn("area", r("area", 7))


@query("curvature", f"""WITH {_FULL}, {_ANGLES}, {_AREAS}, rim AS (SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1), rv AS (SELECT a AS vid FROM rim UNION SELECT b FROM rim)
    SELECT vid, round((2 * pi() - sum(angle)) / any_value(area), 4) + 0.0::DOUBLE AS curvature FROM angles JOIN areas USING (vid) WHERE vid NOT IN (SELECT vid FROM rv) GROUP BY vid""")
def curvature(spark, sf):
    return t.curvature(*_mesh(spark, sf)).withColumn("curvature", r("curvature", 4))


_NEIGHBOURS = "u AS (SELECT DISTINCT a, b FROM edges), n AS (SELECT a AS vid, b AS o FROM u UNION ALL SELECT b, a FROM u)"


@query("diffused_field", f"""WITH {_EDGES}, {i.VERTICES}, {_NEIGHBOURS}, m1 AS (SELECT n.vid, avg(z) AS mean FROM n JOIN verts ON verts.vid = o GROUP BY n.vid), f1 AS (SELECT vid, z + 0.5 * (mean - z) AS value FROM verts JOIN m1 USING (vid)),
    m2 AS (SELECT n.vid, avg(value) AS mean FROM n JOIN f1 ON f1.vid = o GROUP BY n.vid) SELECT vid, round(value + 0.5 * (mean - value), 7) + 0.0::DOUBLE AS value FROM f1 JOIN m2 USING (vid)""")
def diffused_field(spark, sf):
    f, v = _mesh(spark, sf)
    return t.diffused(f, v.select("vid", F.col("z").alias("value")), 2).withColumn("value", r("value", 7))


def _smoothed(source: str, out: str, step: str) -> str:
    return f"""{out}_m AS (SELECT n.vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM n JOIN {source} s ON s.vid = o GROUP BY n.vid),
    {out} AS (SELECT vid, {", ".join(f"CASE WHEN vid IN (SELECT vid FROM rv) THEN {c} ELSE {c} + {step} * (m{c} - {c}) END AS {c}" for c in "xyz")} FROM {source} JOIN {out}_m USING (vid))"""


@query("taubin", f"WITH {_EDGES}, {i.VERTICES}, {_NEIGHBOURS}, rim AS (SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1), rv AS (SELECT a AS vid FROM rim UNION SELECT b FROM rim), {_smoothed('verts', 's1', '0.330')}, {_smoothed('s1', 's2', '(-0.331)')} SELECT vid, round(x, 5) + 0.0::DOUBLE AS x, round(z, 5) + 0.0::DOUBLE AS z FROM s2")
def taubin(spark, sf):
    return m.taubin(*_mesh(spark, sf)).select("vid", r("x", 5).alias("x"), r("z", 5).alias("z"))


_SIDES = [f"sqrt({_SQ[(k + 1) % 3, k]})" for k in range(3)]
_RATIO = f"greatest({', '.join(_SIDES)}) > 1.8 * least({', '.join(_SIDES)})"
_RAY = "sqrt(pow(20 - x0, 2) + pow(20 - y0, 2) + pow(9 - z0, 2))"


@query("clean_triangles", f"""WITH {_GEO}, bad AS (SELECT * FROM geo WHERE {_RATIO}), bv AS (SELECT DISTINCT unnest([v0, v1, v2]) AS vid FROM bad), one AS (SELECT * FROM geo WHERE v0 NOT IN (SELECT vid FROM bv) AND v1 NOT IN (SELECT vid FROM bv) AND v2 NOT IN (SELECT vid FROM bv)),
    side AS (SELECT * FROM one WHERE abs(nx * (20 - x0) + ny * (20 - y0) + nz * (9 - z0)) < 0.2 * size * {_RAY}), sv AS (SELECT DISTINCT unnest([v0, v1, v2]) AS vid FROM side)
    SELECT fid FROM one WHERE v0 NOT IN (SELECT vid FROM sv) AND v1 NOT IN (SELECT vid FROM sv) AND v2 NOT IN (SELECT vid FROM sv)""")
def clean_triangles(spark, sf):
    return t.clean_triangles(*_mesh(spark, sf), 1.8, (20, 20, 9), 0.2).select("fid")


def _segment(k: int) -> str:
    """SQL: squared distance of p to edge k, by the foot of the perpendicular."""
    a, c = k, (k + 1) % 3
    e2 = _SQ[c, a]
    s = f"greatest(0, least(1, ((px - x{a}) * (x{c} - x{a}) + (py - y{a}) * (y{c} - y{a}) + (pz - z{a}) * (z{c} - z{a})) / {e2}))"
    return "(" + " + ".join(f"pow(p{x} - {x}{a} - {s} * ({x}{c} - {x}{a}), 2)" for x in "xyz") + ")"


_HEIGHT = "((px - x0) * nx + (py - y0) * ny + (pz - z0) * nz)"
#: barycentric coordinates of the foot on the plane
_UU, _VV, _UV = _SQ[1, 0], _SQ[2, 0], "((x1 - x0) * (x2 - x0) + (y1 - y0) * (y2 - y0) + (z1 - z0) * (z2 - z0))"
_PU, _PV = (f"((px - x0) * (x{k} - x0) + (py - y0) * (y{k} - y0) + (pz - z0) * (z{k} - z0))" for k in (1, 2))
_BETA, _GAMMA = f"({_VV} * {_PU} - {_UV} * {_PV})", f"({_UU} * {_PV} - {_UV} * {_PU})"
_INSIDE = f"({_BETA} >= 0 AND {_GAMMA} >= 0 AND {_BETA} + {_GAMMA} <= {_UU} * {_VV} - {_UV} * {_UV})"
_TO_TRIANGLE = f"CASE WHEN {_INSIDE} THEN abs({_HEIGHT}) / size ELSE sqrt(least({', '.join(_segment(k) for k in range(3))})) END"


@query("closest_triangles", f"""WITH {_GEO}, {i.POINTS}, d AS (SELECT pid, fid, {_TO_TRIANGLE} AS distance FROM pts JOIN geo ON px BETWEEN least(x0, x1, x2) - 3 AND greatest(x0, x1, x2) + 3 AND py BETWEEN least(y0, y1, y2) - 3 AND greatest(y0, y1, y2) + 3)
    SELECT pid, round(min(distance), 6) AS distance FROM d WHERE distance <= 3 GROUP BY pid""")
def closest_triangles(spark, sf):
    return t.closest_triangles(i.points(spark, sf), *_mesh(spark, sf), 3.0).select("pid", r("distance").alias("distance"))


@query("ray_hits", f"""WITH {_GEO}, {i.POINTS}, rays AS (SELECT pid, px, py, pz, 0.3::DOUBLE AS dx, -0.2::DOUBLE AS dy, -30.0::DOUBLE AS dz FROM pts), h AS (SELECT pid, fid, -{_HEIGHT} / (dx * nx + dy * ny + dz * nz) AS sh, * FROM rays JOIN geo ON px BETWEEN least(x0, x1, x2) - 1 AND greatest(x0, x1, x2) + 1 AND py BETWEEN least(y0, y1, y2) - 1 AND greatest(y0, y1, y2) + 1),
    foot AS (SELECT h.pid, h.fid, sh, geo.* EXCLUDE (fid), h.px + sh * dx AS px, h.py + sh * dy AS py, h.pz + sh * dz AS pz FROM h JOIN geo ON geo.fid = h.fid WHERE sh BETWEEN 0 AND 1) SELECT pid, round(min(sh), 7) AS share FROM foot WHERE {_INSIDE} GROUP BY pid""")
def ray_hits(spark, sf):
    rays = i.points(spark, sf).withColumns({"dx": F.lit(0.3), "dy": F.lit(-0.2), "dz": F.lit(-30.0)})
    return t.ray_hits(rays, *_mesh(spark, sf)).select("pid", r("share", 7).alias("share"))


def _along(c: str) -> str:
    return f"CAST(unnest(range(CAST(ceil(least({c}0, {c}1, {c}2) - 1.5) AS BIGINT), CAST(floor(greatest({c}0, {c}1, {c}2) + 1.5) AS BIGINT) + 1)) AS INTEGER) AS v{c}"


_VOXELS = f"""{_GEO}, gx AS (SELECT *, {_along('x')} FROM geo), gy AS (SELECT *, {_along('y')} FROM gx), gz AS (SELECT *, {_along('z')} FROM gy), g AS (SELECT *, vx * 1.0::DOUBLE AS px, vy * 1.0::DOUBLE AS py, vz * 1.0::DOUBLE AS pz FROM gz),
    vd AS (SELECT vx, vy, vz, fid, {_TO_TRIANGLE} AS distance FROM g)"""


@query("voxelize_mesh", f"WITH {_VOXELS} SELECT vx, vy, vz, round(min(distance), 6) AS distance FROM vd WHERE distance <= 1.5 GROUP BY vx, vy, vz")
def voxelize_mesh(spark, sf):
    return t.voxelize(*_mesh(spark, sf), 1.0, 1.5).select("vx", "vy", "vz", r(F.abs("d")).alias("distance"))


@query("quantize_volume", f"WITH {i.VOX}, q AS (SELECT vx, vy, vz, CAST(round((0.5 - d / 2.4) * 65535) AS INTEGER) AS value, CAST(round(least(w, 1.0) * 65535) AS INTEGER) AS weight FROM vox) SELECT vx, vy, vz, round(-(value / 65535.0 - 0.5) * 2.4, 9) + 0.0::DOUBLE AS d, round(weight / 65535.0::DOUBLE, 9) AS w FROM q WHERE weight > 0")
def quantize_volume(spark, sf):
    return t.dequantized(t.quantized(i.voxels(spark, sf), 1.2), 1.2).select("vx", "vy", "vz", r("d", 9).alias("d"), r("w", 9).alias("w"))


@query("correspondences", f"""WITH {_MESH}, {i.POINTS}, d AS (SELECT pid, vid, sqrt(pow(px - x, 2) + pow(py - y, 2) + pow(pz - z, 2)) AS distance FROM pts JOIN verts ON abs(px - x) <= 4 AND abs(py - y) <= 4), k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, vid) AS rk FROM d WHERE distance <= 4), best AS (SELECT * FROM k WHERE rk = 1)
    SELECT pid, vid AS oid, round(distance, 7) AS distance FROM best WHERE distance <= 1.2 * (SELECT quantile_cont(distance, 0.5) FROM best)""")
def correspondences(spark, sf):
    p = i.points(spark, sf).withColumnsRenamed({f"p{c}": c for c in "xyz"})
    return t.correspondences(p, i.vertices(spark, sf).withColumnRenamed("vid", "pid"), 4.0, 1.2).select("pid", "oid", r("distance", 7).alias("distance"))


@query("align_moved_mesh", f"WITH {_MESH} SELECT vid, round(x, 3) + 0.0::DOUBLE AS x, round(y, 3) + 0.0::DOUBLE AS y, round(z, 3) + 0.0::DOUBLE AS z FROM verts")
def align_moved_mesh(spark, sf):
    """The vertices, moved a little, find their way back to themselves."""
    import math

    p = i.vertices(spark, sf).withColumnRenamed("vid", "pid")
    c, s = math.cos(0.002), math.sin(0.002)
    _, back = t.align(t.moved(p, [c, -s, 0, 0.05, s, c, 0, -0.08, 0, 0, 1, 0.04]), p, 1.0)
    return back.select(F.col("pid").alias("vid"), *[r(k, 3).alias(k) for k in "xyz"])


@query("normalized_variance", f"WITH {_MESH}, a AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS s FROM verts) SELECT vid, round((x - mx) / s, 7) + 0.0::DOUBLE AS x, round((z - mz) / s, 7) + 0.0::DOUBLE AS z FROM verts, a")
def normalized_variance(spark, sf):
    return t.normalized_variance(i.vertices(spark, sf)).select("vid", r("x", 7).alias("x"), r("z", 7).alias("z"))


@query("turned_to_axes", f"WITH {_MESH}, a AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM verts) SELECT vid, round(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2), 5) AS far, 0.0::DOUBLE AS xy FROM verts, a")
def turned_to_axes(spark, sf):
    """Distances from the centre are kept, and the axes are uncorrelated."""
    out = t.turned_to_axes(i.vertices(spark, sf))
    mixed = out.agg(F.abs(F.covar_pop("x", "y")).alias("xy"))
    return out.crossJoin(F.broadcast(mixed)).select("vid", r(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"), 5).alias("far"), r("xy", 5).alias("xy"))


@query("box_mesh", f"WITH {i.BOXES} SELECT obb_id, 12 AS faces, round(2 * (lx * ly + ly * lz + lz * lx), 5) AS area FROM boxes")
def box_mesh(spark, sf):
    """The boxes' surfaces: their areas by the triangles."""
    v, f = t.box_mesh(b.corners(i.boxes(spark, sf)))
    at = lambda k: v.select("obb_id", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
    p = f.join(at(0), ["obb_id", "v0"]).join(at(1), ["obb_id", "v1"]).join(at(2), ["obb_id", "v2"])
    n = t.cross(t.minus(t.vector("", "1"), t.vector("", "0")), t.minus(t.vector("", "2"), t.vector("", "0")))
    return p.groupBy("obb_id").agg(F.count("*").cast("int").alias("faces"), r(F.sum(t.norm(n)) / 2, 5).alias("area"))


@query("component_ranks", f"""WITH RECURSIVE {_EDGES}, c0 AS (SELECT fid, fid AS l FROM faces), adj AS (SELECT DISTINCT s.fid AS f, t.fid AS g FROM edges s JOIN edges t ON s.a = t.a AND s.b = t.b),
    reach(f, g) AS (SELECT fid, fid FROM faces UNION SELECT reach.f, adj.g FROM reach JOIN adj ON reach.g = adj.f), comp AS (SELECT g AS fid, min(f) AS component FROM reach GROUP BY g), s AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
    SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS rank FROM s""")
def component_ranks(spark, sf):
    return m.component_ranks(i.faces(spark, sf))
