"""Queries of the depth map and mesh operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import r
from tessera.operators import depth as d
from tessera.operators import mesh as m
from tessera.plans import inputs as i
from tessera.plans.registry import query

_EDGES = f"{i.FACES}, e3 AS (SELECT fid, v0 AS p, v1 AS q FROM faces UNION ALL SELECT fid, v1, v2 FROM faces UNION ALL SELECT fid, v2, v0 FROM faces), edges AS (SELECT fid, least(p, q) AS a, greatest(p, q) AS b FROM e3)"
_P = """wide AS (SELECT fid, v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM faces JOIN verts a ON a.vid = v0 JOIN verts b ON b.vid = v1 JOIN verts c ON c.vid = v2),
    crossed AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM wide),
    geo AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size, (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy, (z0 + z1 + z2) / 3 AS cz FROM crossed WHERE sqrt(nx * nx + ny * ny + nz * nz) > 0)"""
_COMPONENTS = """c0 AS (SELECT fid, fid AS l FROM faces), adj AS (SELECT DISTINCT s.fid AS f, t.fid AS g FROM edges s JOIN edges t ON s.a = t.a AND s.b = t.b),
    reach(f, g) AS (SELECT fid, fid FROM faces UNION SELECT reach.f, adj.g FROM reach JOIN adj ON reach.g = adj.f), comp AS (SELECT g AS fid, min(f) AS component FROM reach GROUP BY g)"""


@query("mesh_edges", f"WITH {_EDGES} SELECT a, b, count(*) AS n FROM edges GROUP BY a, b")
def mesh_edges(spark, sf):
    return m.edges(i.faces(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("mesh_boundary", f"WITH {_EDGES} SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1")
def mesh_boundary(spark, sf):
    return m.boundary(i.faces(spark, sf))


@query("components", f"WITH RECURSIVE {_EDGES}, {_COMPONENTS} SELECT fid, component FROM comp")
def components(spark, sf):
    return m.face_components(i.faces(spark, sf))


@query("component_sizes", f"WITH RECURSIVE {_EDGES}, {_COMPONENTS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component) SELECT size, count(*) AS n FROM s GROUP BY size")
def component_sizes(spark, sf):
    s = m.face_components(i.faces(spark, sf)).groupBy("component").agg(F.count("*").alias("size"))
    return s.groupBy("size").agg(F.count("*").alias("n"))


@query("drop_small", f"WITH RECURSIVE {_EDGES}, {_COMPONENTS} SELECT fid FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) >= 20)")
def drop_small(spark, sf):
    return m.keep_components(i.faces(spark, sf), 20).select("fid")


@query("keep_largest", f"WITH RECURSIVE {_EDGES}, {_COMPONENTS}, s AS (SELECT component, count(*) AS n FROM comp GROUP BY component) SELECT fid FROM comp JOIN s USING (component) WHERE n = (SELECT max(n) FROM s)")
def keep_largest(spark, sf):
    return m.keep_components(i.faces(spark, sf), -1).select("fid")


@query("strip_boundary", f"""WITH {_EDGES}, rim AS (SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1), rv AS (SELECT a AS vid FROM rim UNION SELECT b FROM rim)
    SELECT fid FROM faces WHERE v0 NOT IN (SELECT vid FROM rv) AND v1 NOT IN (SELECT vid FROM rv) AND v2 NOT IN (SELECT vid FROM rv)""")
def strip_boundary(spark, sf):
    return m.strip_boundary(i.faces(spark, sf), 1).select("fid")


@query("drop_slanted", f"""WITH {i.FACES}, {i.VERTICES}, {_P}, bad AS (SELECT fid, v0, v1, v2 FROM geo WHERE abs(nz / size) < 0.5), tv AS (SELECT v0 AS vid FROM bad UNION SELECT v1 FROM bad UNION SELECT v2 FROM bad)
    SELECT fid FROM faces WHERE v0 NOT IN (SELECT vid FROM tv) AND v1 NOT IN (SELECT vid FROM tv) AND v2 NOT IN (SELECT vid FROM tv)""")
def drop_slanted(spark, sf):
    f = i.faces(spark, sf)
    bad = m.face_geometry(f, i.vertices(spark, sf)).filter(F.abs("nz") < 0.5)
    return m.drop_slanted(f, bad).select("fid")


@query("face_geometry", f"WITH {i.FACES}, {i.VERTICES}, {_P} SELECT fid, round(nx / size, 8) + 0.0::DOUBLE AS nx, round(ny / size, 8) + 0.0::DOUBLE AS ny, round(nz / size, 8) AS nz, round(size / 2, 8) AS area, round(cx, 8) AS cx, round(cz, 8) AS cz FROM geo")
def face_geometry(spark, sf):
    return m.face_geometry(i.faces(spark, sf), i.vertices(spark, sf)).select("fid", *[r(c, 8).alias(c) for c in ("nx", "ny", "nz", "area", "cx", "cz")])


@query("vertex_normals", f"""WITH {i.FACES}, {i.VERTICES}, {_P}, s AS (SELECT unnest([v0, v1, v2]) AS vid, nx / size AS nx, ny / size AS ny, nz / size AS nz FROM geo), t AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM s GROUP BY vid)
    SELECT vid, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 8) + 0.0::DOUBLE AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 8) + 0.0::DOUBLE AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 8) AS nz FROM t""")
def vertex_normals(spark, sf):
    return m.vertex_normals(i.faces(spark, sf), i.vertices(spark, sf)).select("vid", *[r(c, 8).alias(c) for c in ("nx", "ny", "nz")])


@query("centre_of_mass", f"WITH {i.FACES}, {i.VERTICES}, {_P} SELECT round(sum(size / 2), 5) AS area, round(sum(size * cx) / sum(size), 6) AS cx, round(sum(size * cy) / sum(size), 6) AS cy, round(sum(size * cz) / sum(size), 6) AS cz FROM geo")
def centre_of_mass(spark, sf):
    return m.centre_of_mass(i.faces(spark, sf), i.vertices(spark, sf)).select(r("area", 5).alias("area"), *[r(c).alias(c) for c in ("cx", "cy", "cz")])


@query("second_moments", f"WITH {i.FACES}, {i.VERTICES} SELECT round(avg(x * x), 6) AS xx, round(avg(x * y), 6) AS xy, round(avg(x * z), 6) AS xz, round(avg(y * y), 6) AS yy, round(avg(y * z), 6) AS yz, round(avg(z * z), 6) AS zz FROM verts")
def second_moments(spark, sf):
    s = m.second_moments(i.vertices(spark, sf))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query("mesh_stats", f"""WITH {i.FACES}, {i.VERTICES}, {_P}, v AS (SELECT size / 2 AS a FROM geo) SELECT round(min(a), 7) AS min, round(max(a), 7) AS max, round(avg(a), 7) AS mean, round(avg(abs(a)), 7) AS mean_abs, round(sqrt(avg(a * a)), 7) AS rms, round(quantile_cont(a, 0.5), 7) AS median, round(stddev_pop(a), 7) AS stdev, round(sum(a), 5) AS total FROM v""")
def mesh_stats(spark, sf):
    s = m.statistics(m.face_geometry(i.faces(spark, sf), i.vertices(spark, sf)), "area")
    return s.select(*[r(c, 5 if c == "total" else 7).alias(c) for c in s.columns])


@query("valences", f"WITH {_EDGES}, u AS (SELECT DISTINCT a, b FROM edges), n AS (SELECT a AS vid FROM u UNION ALL SELECT b FROM u) SELECT vid, count(*) AS valence FROM n GROUP BY vid")
def valences(spark, sf):
    return m.valences(i.faces(spark, sf))


@query("laplacian", f"""WITH {_EDGES}, {i.VERTICES}, u AS (SELECT DISTINCT a, b FROM edges), n AS (SELECT a AS vid, b AS o FROM u UNION ALL SELECT b, a FROM u), rim AS (SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1), rv AS (SELECT a AS vid FROM rim UNION SELECT b FROM rim),
    mean AS (SELECT n.vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM n JOIN verts ON verts.vid = o GROUP BY n.vid)
    SELECT vid, round(CASE WHEN vid IN (SELECT vid FROM rv) THEN x ELSE x + 0.5 * (mx - x) END, 7) AS x, round(CASE WHEN vid IN (SELECT vid FROM rv) THEN z ELSE z + 0.5 * (mz - z) END, 7) AS z FROM verts JOIN mean USING (vid)""")
def laplacian(spark, sf):
    return m.laplacian(i.faces(spark, sf), i.vertices(spark, sf)).select("vid", r("x", 7).alias("x"), r("z", 7).alias("z"))


@query("subdivide", f"WITH {_EDGES}, {i.VERTICES} SELECT (SELECT count(*) * 4 FROM faces) AS faces, (SELECT count(*) FROM verts) + (SELECT count(*) FROM (SELECT DISTINCT a, b FROM edges)) AS vertices")
def subdivide(spark, sf):
    f, v = m.subdivide(i.faces(spark, sf), i.vertices(spark, sf))
    return f.agg(F.count("*").alias("faces")).crossJoin(v.agg(F.count("*").alias("vertices")))


@query("compact_ids", f"WITH {i.FACES}, {i.VERTICES} SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM verts")
def compact_ids(spark, sf):
    return m.compact(i.faces(spark, sf))


_POINTS = f"""{i.PIXELS}, cloud AS (SELECT frame, y, x, depth * sin((y + 0.5) * pi() / 64) * cos((x + 0.5) * pi() / 64 - pi() / 2) AS px, depth * sin((y + 0.5) * pi() / 64) * sin((x + 0.5) * pi() / 64 - pi() / 2) + frame * 0.25 AS py, depth * cos((y + 0.5) * pi() / 64) AS pz FROM pixels)"""
_PROJECTED = f"""{_POINTS}, n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM cloud WHERE px > 0), a AS (SELECT *, acos(pz / n) AS th FROM n WHERE n <= 30),
    b AS (SELECT frame, y AS sy, x AS sx, CAST(round(th / (pi() / 64) - 0.5) AS INTEGER) AS y, CAST(round((asin(greatest(-1, least(1, py / n / sin(th)))) + pi() / 2) / (pi() / 64) - 0.5) AS INTEGER) AS x, n AS depth FROM a), proj AS (SELECT * FROM b WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63),
    zbuf AS (SELECT y, x, frame, min(depth) AS depth FROM proj GROUP BY y, x, frame), ref AS (SELECT y, x, depth AS ref FROM pixels WHERE frame = 0), met AS (SELECT ref.y, ref.x, ref, frame, depth FROM ref LEFT JOIN (SELECT * FROM zbuf WHERE frame <> 0) z ON ref.y = z.y AND ref.x = z.x)"""
_DISP = "(pi() / 2 + atan(-({d} + cos((y + 0.5) * pi() / 64)) / sin((y + 0.5) * pi() / 64)))"
_VOTES = "votes AS (SELECT y, x, min(ref) AS depth, count(*) FILTER (abs({a}) <= {s}) AS support, count(*) FILTER ({a} < -({s})) AS violations, count(*) FILTER ({a} > {s}) AS occlusions, count(depth) AS seen FROM met GROUP BY y, x)"
_APART = f"({_DISP.format(d='depth')} - {_DISP.format(d='ref')})"


def _fusion(spark, sf):
    px = i.pixels(spark, sf)
    return px.filter("frame = 0"), d.zbuffer(d.project(d.unproject(px, 0.25)))


@query("pixel_unproject", f"WITH {_POINTS} SELECT frame, y, x, round(px, 7) + 0.0::DOUBLE AS px, round(py, 7) + 0.0::DOUBLE AS py, round(pz, 7) + 0.0::DOUBLE AS pz FROM cloud")
def pixel_unproject(spark, sf):
    return d.unproject(i.pixels(spark, sf), 0.25).select("frame", "y", "x", *[r(c, 7).alias(c) for c in ("px", "py", "pz")])


@query("pixel_project", f"WITH {_PROJECTED} SELECT frame, sy, sx, y, x, round(depth, 7) AS depth FROM proj")
def pixel_project(spark, sf):
    return d.project(d.unproject(i.pixels(spark, sf), 0.25)).withColumn("depth", r("depth", 7))


@query("disparity_error", f"WITH {i.PIXELS} SELECT frame, y, x, round({_DISP.format(d='depth')}, 8) + 0.0::DOUBLE AS disparity FROM pixels")
def disparity_error(spark, sf):
    theta, _ = d.pixel_angles(F.col("y"), F.col("x"))
    return i.pixels(spark, sf).select("frame", "y", "x", r(g.angular_disparity(F.col("depth"), theta, 1.0), 8).alias("disparity"))


@query("zbuffer", f"WITH {_PROJECTED} SELECT y, x, frame, round(depth, 7) AS depth FROM zbuf")
def zbuffer(spark, sf):
    return _fusion(spark, sf)[1].withColumn("depth", r("depth", 7))


@query("fuse_simple", f"""WITH {_PROJECTED}, votes AS (SELECT y, x, min(ref) AS depth, count(*) FILTER (abs(depth - ref) < 0.02 * ref * ref) AS support, count(depth) AS seen FROM met GROUP BY y, x)
    SELECT y, x, round(depth, 6) AS depth, support, seen FROM votes WHERE (support + 1) / (seen + 1) > 0.9 AND support >= 1""")
def fuse_simple(spark, sf):
    ref, cand = _fusion(spark, sf)
    return d.fuse_simple(ref, cand, 0.9, 1, 0.02).withColumn("depth", r("depth"))


@query("fuse_reference_support", f"WITH {_PROJECTED}, {_VOTES.format(a=_APART, s='2 * pi() / 64')} SELECT y, x, round(depth, 6) AS depth, support FROM votes WHERE (support + 1) / 6 > 0.3 AND support >= 1 AND x BETWEEN 4 AND 59")
def fuse_reference_support(spark, sf):
    ref, cand = _fusion(spark, sf)
    return d.fuse_reference_support(ref, cand, 6, least=1).withColumn("depth", r("depth"))


_TH = "((y + 0.5) * pi() / 64)"
_ERR = f"(sin({_TH}) / pow(sin({_DISP.format(d='depth')} - {_TH}), 2) * pi() / 64)"


@query("fuse_spherical", f"WITH {_PROJECTED}, {_VOTES.format(a=_APART, s='pi() / 64')} SELECT y, x, round(depth, 6) AS depth, support, round(exp(-2 * abs({_ERR})), 6) AS conf FROM votes WHERE (support + 1) / 6 > 0.3 AND support >= 1 AND x BETWEEN 5 AND 58")
def fuse_spherical(spark, sf):
    ref, cand = _fusion(spark, sf)
    out = d.fuse_spherical(ref, cand, 6, least=1)
    return out.withColumns({"depth": r("depth"), "conf": r("conf")})


@query("triangulate", f"""WITH {i.PIXELS}, c AS (SELECT frame, y, x, 0 AS k, depth FROM pixels UNION ALL SELECT frame, y, x - 1, 1, depth FROM pixels UNION ALL SELECT frame, y - 1, x, 2, depth FROM pixels UNION ALL SELECT frame, y - 1, x - 1, 3, depth FROM pixels),
    b AS (SELECT frame, y, x, max(depth) FILTER (k = 0) AS d0, max(depth) FILTER (k = 1) AS d1, max(depth) FILTER (k = 2) AS d2, max(depth) FILTER (k = 3) AS d3, count(*) AS n FROM c GROUP BY frame, y, x HAVING count(*) >= 3),
    t AS (SELECT frame, y, x, unnest(CASE WHEN n = 4 AND abs(d0 - d3) <= abs(d1 - d2) THEN [{{'t': 1, 'j': greatest(d0, d1, d3) - least(d0, d1, d3)}}, {{'t': 4, 'j': greatest(d0, d2, d3) - least(d0, d2, d3)}}]
        WHEN n = 4 THEN [{{'t': 2, 'j': greatest(d0, d1, d2) - least(d0, d1, d2)}}, {{'t': 3, 'j': greatest(d1, d2, d3) - least(d1, d2, d3)}}] WHEN d0 IS NULL THEN [{{'t': 10, 'j': greatest(d1, d2, d3) - least(d1, d2, d3)}}]
        WHEN d1 IS NULL THEN [{{'t': 11, 'j': greatest(d0, d2, d3) - least(d0, d2, d3)}}] WHEN d2 IS NULL THEN [{{'t': 12, 'j': greatest(d0, d1, d3) - least(d0, d1, d3)}}] ELSE [{{'t': 13, 'j': greatest(d0, d1, d2) - least(d0, d1, d2)}}] END) AS s FROM b)
    SELECT frame, y, x, s.t AS t, round(s.j, 6) AS jump FROM t WHERE s.j <= 4.0""")
def triangulate(spark, sf):
    return d.triangulate(i.pixels(spark, sf), 4.0).withColumn("jump", r("jump"))


@query("partner_frames", f"WITH {i.FRAMES} SELECT f.frame, max(g.frame) FILTER (g.frame < f.frame) AS before, min(g.frame) FILTER (g.frame > f.frame) AS after FROM frames f LEFT JOIN frames g ON abs(f.frame - g.frame) BETWEEN 1 AND 50 GROUP BY f.frame")
def partner_frames(spark, sf):
    return d.partners(i.frames(spark, sf))


@query("frame_range_join", f"WITH {i.FRAMES} SELECT f.frame, g.frame AS partner FROM frames f JOIN frames g ON abs(f.frame - g.frame) BETWEEN 1 AND 2")
def frame_range_join(spark, sf):
    return d.within(i.frames(spark, sf))


_SCAN = "scan AS (SELECT y, pos, CASE WHEN v < 3 THEN -1 WHEN v > 5 THEN -2 ELSE CAST(v AS INTEGER) END AS value FROM (SELECT frame * 64 + y AS y, x AS pos, floor(depth) AS v FROM pixels))"


def _scan(spark, sf):
    v = F.floor("depth")
    return i.pixels(spark, sf).select((F.col("frame") * 64 + F.col("y")).alias("y"), F.col("x").alias("pos"), F.when(v < 3, F.lit(-1)).when(v > 5, F.lit(-2)).otherwise(v.cast("int")).alias("value"))


def _dense(scan):
    """Positions counted without gaps, as in a scanline."""
    from pyspark.sql import Window as W

    return scan.withColumn("pos", (F.row_number().over(W.partitionBy("y").orderBy("pos")) - 1).cast("int"))


_DENSE = f"{i.PIXELS}, {_SCAN}, line AS (SELECT y, CAST(row_number() OVER (PARTITION BY y ORDER BY pos) - 1 AS INTEGER) AS pos, value FROM scan)"


@query("rle_encode", f"""WITH {_DENSE}, k AS (SELECT *, CASE value WHEN -1 THEN 'E' WHEN -2 THEN 'F' ELSE 'V' END AS kind FROM line), o AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY y ORDER BY pos) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS opens FROM k),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY y ORDER BY pos) AS run FROM o) SELECT y, min(pos) AS start, count(*) AS length, min(kind) AS kind, CASE WHEN min(kind) = 'V' THEN string_agg(CAST(value AS VARCHAR), ',' ORDER BY pos) END AS items FROM n GROUP BY y, run""")
def rle_encode(spark, sf):
    runs = d.rle_encode(_dense(_scan(spark, sf)))
    return runs.withColumn("items", F.when(F.col("items").isNotNull(), F.array_join(F.transform("items", lambda x: x.cast("string")), ",")))


@query("rle_decode", f"WITH {_DENSE} SELECT y, pos, value FROM line")
def rle_decode(spark, sf):
    return d.rle_decode(d.rle_encode(_dense(_scan(spark, sf))))


@query("consistency_votes", f"""WITH {_PROJECTED}, c AS (SELECT met.y * 64 + met.x AS vid, ref AS depth, depth AS seen, depth > 8 AS sky FROM met WHERE depth IS NOT NULL),
    v AS (SELECT vid, count(*) FILTER (sky) AS sky, count(*) FILTER (NOT sky AND abs(seen - depth) <= 1.0) AS consistent, count(*) FILTER (NOT sky AND seen - depth > 1.0) AS occluded, count(*) FILTER (NOT sky AND seen - depth < -1.0) AS occluding FROM c GROUP BY vid)
    SELECT *, NOT (sky > 3 OR coalesce(occluded / nullif(occluded + consistent, 0), 0) > 0.5) AS kept FROM v""")
def consistency_votes(spark, sf):
    ref, cand = _fusion(spark, sf)
    met = d._against(ref, cand).filter("depth is not null")
    return d.consistency(met.select((F.col("y") * 64 + F.col("x")).alias("vid"), F.col("ref").alias("depth"), F.col("depth").alias("seen"), (F.col("depth") > 8).alias("is_sky"), F.lit(0.25).alias("error")))
