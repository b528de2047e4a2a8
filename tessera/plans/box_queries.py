"""Queries of the box operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import r
from tessera.operators import boxes as b
from tessera.plans import inputs as i
from tessera.plans.registry import query

_DU = "((b.cx - a.cx) * cos({o}.theta) + (b.cy - a.cy) * sin({o}.theta))"
_DV = "((b.cy - a.cy) * cos({o}.theta) - (b.cx - a.cx) * sin({o}.theta))"
_C, _S = "abs(cos(b.theta - a.theta))", "abs(sin(b.theta - a.theta))"
TOUCH2 = " AND ".join(
    f"abs({_DU.format(o=o)}) <= ({o}.lx + {p}.lx * {_C} + {p}.ly * {_S}) / 2 AND abs({_DV.format(o=o)}) <= ({o}.ly + {p}.lx * {_S} + {p}.ly * {_C}) / 2" for o, p in (("a", "b"), ("b", "a"))
)
TOUCH3 = f"{TOUCH2} AND a.bz <= b.bz + b.lz AND b.bz <= a.bz + a.lz"


def _pairs(spark, sf):
    box = i.boxes(spark, sf)
    return box, b.candidate_pairs(box, box).filter("a_obb_id < b_obb_id")


@query("obb_corners", f"""WITH {i.BOXES} SELECT obb_id, CAST(kx + 2 * ky + 4 * kz AS INTEGER) AS k, round(cx + (kx - 0.5) * lx * cos(theta) - (ky - 0.5) * ly * sin(theta), 5) + 0.0::DOUBLE AS x,
    round(cy + (kx - 0.5) * lx * sin(theta) + (ky - 0.5) * ly * cos(theta), 5) + 0.0::DOUBLE AS y, round(bz + kz * lz, 5) AS z FROM boxes, (SELECT unnest([0, 1]) AS kx), (SELECT unnest([0, 1]) AS ky), (SELECT unnest([0, 1]) AS kz)""")
def obb_corners(spark, sf):
    return b.corners(i.boxes(spark, sf)).select("obb_id", "k", r("x", 5).alias("x"), r("y", 5).alias("y"), r("z", 5).alias("z"))


@query("obb_affine_roundtrip", f"WITH {i.BOXES} SELECT obb_id, round(cx, 5) AS cx, round(cy, 5) AS cy, round(lx, 5) AS lx, round(ly, 5) AS ly, round(lx * ly * lz, 5) AS volume, round(cos(theta), 5) + 0.0::DOUBLE AS c, round(sin(theta), 5) + 0.0::DOUBLE AS s FROM boxes")
def obb_affine_roundtrip(spark, sf):
    back = b.from_affine(b.affine(i.boxes(spark, sf)))
    return back.select("obb_id", *[r(c, 5).alias(c) for c in ("cx", "cy", "lx", "ly")], r(b.volume(), 5).alias("volume"), r(F.cos("theta"), 5).alias("c"), r(F.sin("theta"), 5).alias("s"))


@query("obb_extend", f"WITH {i.BOXES} SELECT obb_id, round((lx + 2) * (ly + 2) * (lz + 2.2::DOUBLE), 5) AS grown, round(lx * 1.2::DOUBLE * ly * 1.2::DOUBLE * lz * 1.1::DOUBLE, 5) AS grown_share FROM boxes")
def obb_extend(spark, sf):
    box = i.boxes(spark, sf)
    grown = b.extend(box, 1, 1, 2.2).select("obb_id", r(b.volume(), 5).alias("grown"))
    return grown.join(b.extend_share(box, 0.1, 0.1, 0.1).select("obb_id", r(b.volume(), 5).alias("grown_share")), "obb_id")


@query("obb_sat2d", f"WITH {i.BOXES} SELECT a.obb_id AS a, b.obb_id AS b FROM boxes a JOIN boxes b ON a.obb_id < b.obb_id AND {TOUCH2}")
def obb_sat2d(spark, sf):
    return _pairs(spark, sf)[1].filter(b.touch_2d()).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"))


@query("obb_sat3d", f"WITH {i.BOXES} SELECT a.obb_id AS a, b.obb_id AS b FROM boxes a JOIN boxes b ON a.obb_id < b.obb_id AND {TOUCH3}")
def obb_sat3d(spark, sf):
    return _pairs(spark, sf)[1].filter(b.touch_3d()).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"))


@query("obb_any_hit", f"WITH {i.BOXES} SELECT a.obb_id FROM boxes a WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.category = 0 AND a.category > 0 AND {TOUCH3})")
def obb_any_hit(spark, sf):
    box = i.boxes(spark, sf)
    return b.overlaps(box.filter("category > 0"), box.filter("category = 0")).select(F.col("a_obb_id").alias("obb_id")).distinct()


def _share(a: str, o: str, n: int) -> str:
    """SQL: share of an n^3 grid over box a in box o."""
    m = n - 1
    x, y = f"((gi / {m}.0::DOUBLE - 0.5) * {a}.lx)", f"((gj / {m}.0::DOUBLE - 0.5) * {a}.ly)"
    t = f"({a}.theta - {o}.theta)"
    du = f"(({a}.cx - {o}.cx) * cos({o}.theta) + ({a}.cy - {o}.cy) * sin({o}.theta))"
    dv = f"(({a}.cy - {o}.cy) * cos({o}.theta) - ({a}.cx - {o}.cx) * sin({o}.theta))"
    flat = f"(SELECT count(*) FROM g2 WHERE abs({x} * cos{t} - {y} * sin{t} + {du}) <= {o}.lx / 2 + 1e-9 AND abs({x} * sin{t} + {y} * cos{t} + {dv}) <= {o}.ly / 2 + 1e-9)"
    high = f"(SELECT count(*) FROM g1 WHERE {a}.bz + gk / {m}.0::DOUBLE * {a}.lz BETWEEN {o}.bz - 1e-9 AND {o}.bz + {o}.lz + 1e-9)"
    return f"({flat} * {high} / {float(n**3)}::DOUBLE)"


def _iou_sql(n: int, where: str) -> str:
    return f"""g1 AS (SELECT unnest(range({n})) AS gk), g2 AS (SELECT i.gk AS gi, j.gk AS gj FROM g1 i, g1 j),
    shared AS (SELECT a.obb_id AS a, b.obb_id AS b, a.score AS a_score, b.score AS b_score, a.category AS ac, b.category AS bc, a.theta AS ta, b.theta AS tb, a.lx * a.ly * a.lz AS va, b.lx * b.ly * b.lz AS vb,
        {_share('a', 'b', n)} AS ab, {_share('b', 'a', n)} AS ba FROM boxes a JOIN boxes b ON {where} AND {TOUCH2}),
    iou AS (SELECT *, (ab * va + ba * vb) / 2 AS inter, (ab * va + ba * vb) / 2 / (va + vb - (ab * va + ba * vb) / 2) AS iou FROM shared)"""


@query("obb_iou_grid", f"WITH {i.BOXES}, {_iou_sql(31, 'a.obb_id < b.obb_id')} SELECT a, b, round(inter, 4) AS inter, round(iou, 4) AS iou FROM iou")
def obb_iou_grid(spark, sf):
    return b.iou(_pairs(spark, sf)[1].filter(b.touch_2d())).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"), r("inter", 4).alias("inter"), r("iou", 4).alias("iou"))


_SIM = f"{_iou_sql(31, 'a.category = 0 AND b.category > 0 AND cos(a.theta - b.theta) >= sqrt(0.5)')}, sim AS (SELECT a, b, iou * cos(ta - tb) AS s FROM iou WHERE iou * cos(ta - tb) > 0), best AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM sim)"


@query("best_match", f"WITH {i.BOXES}, {_SIM} SELECT a, b, round(s, 4) AS similarity FROM best WHERE k = 1")
def best_match(spark, sf):
    box = i.boxes(spark, sf)
    m = b.best_match(box.filter("category = 0"), box.filter("category > 0"))
    return m.select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"), r("similarity", 4).alias("similarity"))


@query("unmatched", f"WITH {i.BOXES}, {_SIM} SELECT obb_id FROM boxes WHERE category = 0 AND obb_id NOT IN (SELECT a FROM best WHERE s > 0.15)")
def unmatched(spark, sf):
    box = i.boxes(spark, sf)
    mine = box.filter("category = 0")
    return b.unmatched(mine, b.best_match(mine, box.filter("category > 0")), 0.15).select("obb_id")


_NMS = f"{_iou_sql(31, '(a.score > b.score OR a.score = b.score AND a.obb_id < b.obb_id)')}, beats AS (SELECT a, b FROM iou WHERE inter / vb > 0.05)"


@query("nms_pairs", f"WITH {i.BOXES}, {_NMS} SELECT a, b FROM beats")
def nms_pairs(spark, sf):
    return b.nms_pairs(i.boxes(spark, sf))


@query("nms", f"""WITH RECURSIVE {i.BOXES}, {_NMS}, ranked AS (SELECT obb_id, row_number() OVER (ORDER BY score DESC, obb_id) AS k FROM boxes),
    walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM beats WHERE beats.b = n.obb_id AND list_contains(w.kept, beats.a)) THEN w.kept ELSE list_append(w.kept, n.obb_id) END FROM walk w JOIN ranked n ON n.k = w.k + 1)
    SELECT unnest(kept) AS obb_id FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)""")
def nms(spark, sf):
    box = i.boxes(spark, sf)
    return b.suppress(box, b.nms_pairs(box)).select("obb_id")


@query("vertex_in_box", f"""WITH {i.FACES}, {i.VERTICES}, {i.BOXES} SELECT vid AS pid, obb_id FROM verts JOIN boxes ON abs((x - cx) * cos(theta) + (y - cy) * sin(theta)) <= lx / 2 AND abs((y - cy) * cos(theta) - (x - cx) * sin(theta)) <= ly / 2 AND z >= bz AND z <= bz + lz""")
def vertex_in_box(spark, sf):
    return b.points_in_boxes(i.vertices(spark, sf).withColumnRenamed("vid", "pid"), i.boxes(spark, sf))


@query("scan_steps", f"WITH {i.BOXES} SELECT obb_id, CASE WHEN least(lx, ly) > 8 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sx, round(CASE WHEN least(lx, ly) > 8 THEN 2.0 ELSE 1.0 END * pi() / 180, 6) AS sangle FROM boxes")
def scan_steps(spark, sf):
    return b.step_sizes(i.boxes(spark, sf)).select("obb_id", "sx", r("sangle").alias("sangle"))


@query("obb_from_centre", f"WITH {i.BOXES} SELECT obb_id, round(cx - lx / 2 * cos(theta) + ly / 2 * sin(theta), 6) + 0.0::DOUBLE AS ox, round(cy - lx / 2 * sin(theta) - ly / 2 * cos(theta), 6) + 0.0::DOUBLE AS oy, round(bz - lz / 2, 6) + 0.0::DOUBLE AS oz, round(lx / 8, 6) AS step FROM boxes")
def obb_from_centre(spark, sf):
    out = b.from_centres(i.boxes(spark, sf), (9, 9, 9))
    return out.select("obb_id", *[r(F.col("offset")[k]).alias(f"o{c}") for k, c in enumerate("xyz")], r(F.col("voxel_lengths")[0]).alias("step"))


@query("obb_rescale", f"WITH {i.BOXES} SELECT obb_id, round(lx * 2, 6) AS lx, round(lz * 1.5, 6) AS lz, round(bz + lz / 2 - lz * 1.5 / 2, 6) + 0.0::DOUBLE AS bz, round(bz, 6) AS kept FROM boxes")
def obb_rescale(spark, sf):
    box = i.boxes(spark, sf)
    one = b.rescale(box, 2.0, 1.0, 1.5).select("obb_id", r("lx").alias("lx"), r("lz").alias("lz"), r("bz").alias("bz"))
    return one.join(b.rescale(box, 2.0, 1.0, 1.5, True).select("obb_id", r("bz").alias("kept")), "obb_id")


@query("obb_sat15", f"WITH {i.BOXES} SELECT a.obb_id AS a, b.obb_id AS b FROM boxes a JOIN boxes b ON a.obb_id < b.obb_id AND {TOUCH3}")
def obb_sat15(spark, sf):
    """The fifteen axes on boxes turned about z, where six of them decide."""
    box = i.boxes(spark, sf).select("obb_id", *b.GEOMETRY)
    pairs = b.candidate_pairs(box, box).filter("a_obb_id < b_obb_id AND a_bz <= b_bz + b_lz + 1e-6 AND b_bz <= a_bz + a_lz + 1e-6")
    return b.touch_general(pairs, flat=True).select(F.col("a_obb_id").alias("a"), F.col("b_obb_id").alias("b"))


@query("vector_functions", f"""WITH {i.BOXES}, t AS (SELECT *, theta - 3 AS q, greatest(0, least(1, (theta - 1) / 4)) AS s, lx / sqrt(lx * lx + ly * ly) AS vx, ly / sqrt(lx * lx + ly * ly) AS vy FROM boxes)
    SELECT obb_id, CASE WHEN q < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, round(q - floor(q), 7) AS fract, round(greatest(-1, least(1, q)), 7) + 0.0::DOUBLE AS clamped, round(lx + (ly - lx) * 0.25::DOUBLE, 7) AS mixed, CASE WHEN theta < 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS step,
    round(s * s * (3 - 2 * s), 7) AS smooth, round(vx, 7) AS rx, round(-vy, 7) + 0.0::DOUBLE AS ry, round(CASE WHEN 1 - 2.25 * (1 - vy * vy) < 0 THEN 0 ELSE 1.5 * vx END, 6) + 0.0::DOUBLE AS bent, round(acos(greatest(-1, least(1, vx))), 5) AS angle FROM t""")
def vector_functions(spark, sf):
    box = i.boxes(spark, sf)
    size = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly"))
    v, up = [F.col("lx") / size, F.col("ly") / size, F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    q, mirrored = F.col("theta") - 3, g.reflect(v, up)
    return box.select("obb_id", g.sign(q).alias("sign"), r(g.fract(q), 7).alias("fract"), r(g.clamp(q, -1, 1), 7).alias("clamped"), r(g.mix(F.col("lx"), F.col("ly"), 0.25), 7).alias("mixed"), g.step(2.0, F.col("theta")).alias("step"), r(g.smoothstep(1.0, 5.0, F.col("theta")), 7).alias("smooth"), r(mirrored[0], 7).alias("rx"), r(mirrored[1], 7).alias("ry"), r(g.refract(v, up, 1.5)[0]).alias("bent"), r(g.angle_between(v, [F.lit(1.0), F.lit(0.0), F.lit(0.0)]), 5).alias("angle"))
