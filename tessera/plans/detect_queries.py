"""Queries of the detection operators, and of learning operators that SQL follows step by step."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import r
from tessera.operators import boxes as b
from tessera.operators import detect as t
from tessera.operators import learn as n
from tessera.operators import volume as v
from tessera.plans import inputs as i
from tessera.plans.box_queries import TOUCH2, TOUCH3, _iou_sql
from tessera.plans.learn_queries import _ERRORS, _FEATURES
from tessera.plans.registry import query
from tessera.plans.volume_queries import _CORNERS

SCAN = t.Scan((4.0, 28.0), (6.0, 26.0), (4.0, 5.0, 1.3))
DETECTOR = t.Detector((6.0, 5.0, 4.0), (3, 3, 2), 0.1, 9.0, 0.4, 0.0)
_NX, _NY, _NA = SCAN.counts
_N = _NX * _NY * _NA
_POSES = f"""poses AS (SELECT id AS obb_id, 0 AS category, 4.0::DOUBLE + (id // {_NY * _NA}) * 4.0::DOUBLE AS cx, 6.0::DOUBLE + (id // {_NA} % {_NY}) * 5.0::DOUBLE AS cy, 9.0::DOUBLE AS bz,
    6.0::DOUBLE AS lx, 5.0::DOUBLE AS ly, 4.0::DOUBLE AS lz, (id % {_NA}) * 1.3::DOUBLE AS theta FROM (SELECT unnest(range({_N})) AS id))"""


def _corners(out: str) -> str:
    """The corners' SQL with names of its own."""
    return re.sub(r"\b(o8|snapped|corners|met|pts)\b", rf"{out}_\1", _CORNERS)


def _scores(boxes: str, out: str) -> str:
    """SQL: table ``out`` (obb_id, score) of a table of boxes that enough of is observed."""
    return f"""{out}_own AS (SELECT row_number() OVER (ORDER BY obb_id, ix, iy, iz) AS pid, obb_id, (ix * 3 + iy) * 2 + iz AS idx,
        cx + (ix / 2.0::DOUBLE - 0.5) * lx * cos(theta) - (iy / 2.0::DOUBLE - 0.5) * ly * sin(theta) AS px, cy + (ix / 2.0::DOUBLE - 0.5) * lx * sin(theta) + (iy / 2.0::DOUBLE - 0.5) * ly * cos(theta) AS py, bz + iz * lz AS pz
        FROM {boxes}, (SELECT unnest(range(3)) AS ix), (SELECT unnest(range(3)) AS iy), (SELECT unnest(range(2)) AS iz)), {out}_pts AS (SELECT pid, px, py, pz FROM {out}_own), {_corners(out)},
    {out}_cells AS (SELECT pid, sum(share * d) / sum(share) AS val FROM {out}_met GROUP BY pid HAVING sum(share) > 0.4),
    {out}_feats AS (SELECT obb_id, idx, val FROM {out}_cells JOIN {out}_own USING (pid)),
    {out} AS (SELECT obb_id, sum(val * ((idx * 2 * 37 % 19 - 9) / 10.0::DOUBLE) + ((idx * 2 + 1) * 37 % 19 - 9) / 10.0::DOUBLE) + 0.1 AS score FROM {out}_feats GROUP BY obb_id HAVING count(*) / 18.0 >= 0.4)"""


def _weights(spark):
    return spark.range(36).select(F.col("id").cast("int").alias("feature"), ((F.col("id") * 37 % 19 - 9) / 10.0).alias("wt"))


_FOUND = f"{i.VOX}, {_POSES}, {_scores('poses', 'scored')}, found AS (SELECT poses.*, score FROM poses JOIN scored USING (obb_id) WHERE score > 0)"


@query("pose_codec", f"WITH {_POSES} SELECT obb_id, CAST(obb_id // {_NY * _NA} AS INTEGER) AS ix, CAST(obb_id // {_NA} % {_NY} AS INTEGER) AS iy, CAST(obb_id % {_NA} AS INTEGER) AS ia, obb_id AS again, obb_id AS near FROM poses")
def pose_codec(spark, sf):
    poses = SCAN.boxes(spark, (1.0, 1.0, 1.0))
    ix, iy, ia = SCAN.place(F.col("obb_id"))
    near = SCAN.nearest(F.col("cx") + 0.4, F.col("cy") - 0.4, F.col("theta") + 0.1 + 2 * g.PI)
    return poses.select("obb_id", ix.alias("ix"), iy.alias("iy"), ia.alias("ia"), SCAN.number(ix, iy, ia).alias("again"), SCAN.number(*near).alias("near"))


@query("scan_detect", f"WITH {_FOUND} SELECT obb_id, round(cx, 6) AS cx, round(theta, 6) AS theta, round(score, 6) AS score FROM found")
def scan_detect(spark, sf):
    out = t.detect(i.voxels(spark, sf), SCAN, _weights(spark), DETECTOR, suppress=False)
    return out.select("obb_id", r("cx").alias("cx"), r("theta").alias("theta"), r("score").alias("score"))


def _greedy_sql(boxes: str, beats: str, out: str) -> str:
    """SQL: the ids that greedy suppression keeps of a table, walked one by one."""
    return f"""{out}_rank AS (SELECT obb_id, row_number() OVER (ORDER BY score DESC, obb_id) AS k FROM {boxes}),
    {out}_walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM {beats} x WHERE x.b = n.obb_id AND list_contains(w.kept, x.a)) THEN w.kept ELSE list_append(w.kept, n.obb_id) END FROM {out}_walk w JOIN {out}_rank n ON n.k = w.k + 1),
    {out} AS (SELECT unnest(kept) AS obb_id FROM (SELECT kept FROM {out}_walk ORDER BY k DESC LIMIT 1))"""


def _flat_beats(boxes: str, out: str) -> str:
    side = lambda c: f"greatest(0, least(a.c{c} + a.l{c} / 2, b.c{c} + b.l{c} / 2) - greatest(a.c{c} - a.l{c} / 2, b.c{c} - b.l{c} / 2))"
    inter = f"{side('x')} * {side('y')}"
    return f"{out} AS (SELECT a.obb_id AS a, b.obb_id AS b FROM {boxes} a JOIN {boxes} b ON (a.score > b.score OR a.score = b.score AND a.obb_id < b.obb_id) AND a.theta = b.theta WHERE {inter} / (a.lx * a.ly + b.lx * b.ly - {inter}) > 0.05)"


@query("nms_same_angle", f"WITH RECURSIVE {i.BOXES}, flat AS (SELECT * REPLACE (0.0::DOUBLE AS theta) FROM boxes), {_flat_beats('flat', 'beats')}, {_greedy_sql('flat', 'beats', 'kept')} SELECT obb_id FROM kept")
def nms_same_angle(spark, sf):
    box = i.boxes(spark, sf).withColumn("theta", F.lit(0.0))
    return b.suppress(box, b.nms_same_angle_pairs(box)).select("obb_id")


_IOU11 = _iou_sql(31, "(a.score > b.score OR a.score = b.score AND a.obb_id < b.obb_id)")


@query("detect_and_suppress", f"""WITH RECURSIVE {_FOUND}, {_flat_beats('found', 'flat_beats')}, {_greedy_sql('found', 'flat_beats', 'first')}, boxes AS (SELECT * FROM found WHERE obb_id IN (SELECT obb_id FROM first)),
    {_IOU11}, beats AS (SELECT a, b FROM iou WHERE inter / vb > 0.05), {_greedy_sql('boxes', 'beats', 'kept')} SELECT obb_id FROM kept""")
def detect_and_suppress(spark, sf):
    return t.detect(i.voxels(spark, sf), SCAN, _weights(spark), DETECTOR).select("obb_id")


def _truth(spark, sf):
    return i.boxes(spark, sf).filter("category = 0").withColumns({"cx": F.col("cx") * 0.8, "cy": F.col("cy") * 0.8, "bz": F.lit(9.0)})


_TRUTH = "truth AS (SELECT * REPLACE (cx * 0.8::DOUBLE AS cx, cy * 0.8::DOUBLE AS cy, 9.0::DOUBLE AS bz) FROM boxes WHERE category = 0)"
_MATCH = _iou_sql(31, "a.src = 0 AND b.src = 1 AND cos(a.theta - b.theta) >= sqrt(0.5)").replace("FROM boxes a JOIN boxes b", "FROM all_boxes a JOIN all_boxes b")


@query("mine_negatives", f"""WITH {_FOUND}, {i.BOXES}, {_TRUTH}, all_boxes AS (SELECT 0 AS src, obb_id, category, score, cx, cy, bz, lx, ly, lz, theta FROM found UNION ALL SELECT 1, obb_id, category, score, cx, cy, bz, lx, ly, lz, theta FROM truth),
    {_MATCH}, hit AS (SELECT a, max(iou * cos(ta - tb)) AS s FROM iou GROUP BY a), fresh AS (SELECT obb_id, score FROM found WHERE theta > 0 AND obb_id NOT IN (SELECT a FROM hit WHERE s > 0.02)),
    known AS (SELECT obb_id, 0.5::DOUBLE AS score FROM poses WHERE theta = 0) SELECT obb_id, round(score, 6) AS score FROM (SELECT * FROM fresh UNION ALL SELECT * FROM known) ORDER BY score DESC, obb_id LIMIT 60""")
def mine_negatives(spark, sf):
    known = SCAN.boxes(spark, DETECTOR.template, DETECTOR.bottom).filter("theta = 0").withColumn("score", F.lit(0.5))
    out, _ = t.mine(i.voxels(spark, sf), SCAN, _weights(spark), DETECTOR, _truth(spark, sf), known, 60, 0.02)
    return out.select("obb_id", r("score").alias("score"))


def _few(spark, sf):
    return t.detect(i.voxels(spark, sf), SCAN, _weights(spark), DETECTOR, suppress=False)


_FEW = f"{_FOUND}, few AS (SELECT * EXCLUDE (score) FROM found)"


@query("refine_positions", f"""WITH {_FEW}, moves AS (SELECT f.obb_id AS home, ((a + 1) * 3 + b + 1) * 3 + c + 1 AS k, cx + a * 4.0::DOUBLE AS cx, cy + b * 5.0::DOUBLE AS cy, theta + c * 1.3::DOUBLE AS theta, bz, lx, ly, lz FROM few f, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)),
    tried AS (SELECT home * 100000 + k AS obb_id, * FROM moves), {_scores('tried', 'rescored')}, best AS (SELECT t.*, score, row_number() OVER (PARTITION BY home ORDER BY score DESC, k) AS rk FROM tried t JOIN rescored USING (obb_id)), own AS (SELECT home, score FROM tried JOIN rescored USING (obb_id) WHERE k = 13)
    SELECT f.obb_id, round(CASE WHEN best.score > own.score THEN best.cx ELSE f.cx END, 6) AS cx, round(CASE WHEN best.score > own.score THEN best.theta ELSE f.theta END, 6) + 0.0::DOUBLE AS theta, round(greatest(best.score, own.score), 6) AS score
    FROM few f JOIN own ON own.home = f.obb_id JOIN best ON best.home = f.obb_id AND rk = 1""")
def refine_positions(spark, sf):
    out = t.refine_positions(i.voxels(spark, sf), _few(spark, sf), SCAN, _weights(spark), DETECTOR, steps=1)
    return out.select("obb_id", r("cx").alias("cx"), r("theta").alias("theta"), r("score").alias("score"))


@query("refine_scales", f"""WITH {_FEW}, moves AS (SELECT f.obb_id AS home, (a * 3 + b) * 3 + c AS k, cx, cy, theta, bz, lx * (0.95::DOUBLE + a * 0.05::DOUBLE) AS lx, ly * (0.95::DOUBLE + b * 0.05::DOUBLE) AS ly, lz * (0.95::DOUBLE + c * 0.05::DOUBLE) AS lz FROM few f, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b), (SELECT unnest([0, 1, 2]) AS c)),
    tried AS (SELECT home * 100000 + k AS obb_id, * FROM moves UNION ALL SELECT -1 - obb_id, obb_id, -1, cx, cy, theta, bz, lx, ly, lz FROM few), {_scores('tried', 'rescored')},
    best AS (SELECT t.*, score, row_number() OVER (PARTITION BY home ORDER BY score DESC, k) AS rk FROM tried t JOIN rescored USING (obb_id) WHERE k >= 0), own AS (SELECT home, score FROM tried JOIN rescored USING (obb_id) WHERE k = -1)
    SELECT f.obb_id, round(greatest(coalesce(best.score, own.score), own.score), 6) AS score FROM few f JOIN own ON own.home = f.obb_id LEFT JOIN best ON best.home = f.obb_id AND rk = 1""")
def refine_scales(spark, sf):
    out = t.refine_scales(i.voxels(spark, sf), _few(spark, sf), 0.95, 1.05, _weights(spark), DETECTOR)
    return out.select("obb_id", r("score").alias("score"))


def _labels(cells):
    return cells.select("sample", F.when(F.col("cluster") == 0, F.lit(1)).otherwise(F.lit(-1)).alias("y")).distinct()


def _trained(name: str, features: str, labels: str, rounds: int) -> str:
    """SQL: weights ``name``_w and bias ``name``_b after so many gradient steps."""
    out = f"{name}_n AS (SELECT count(*) AS n FROM {labels}), {name}_w0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS wt FROM {features}), {name}_b0 AS (SELECT 0.0::DOUBLE AS bias)"
    for k in range(rounds):
        out += f""", {name}_p{k} AS (SELECT sample, (CASE WHEN y > 0 THEN 10.0 ELSE 1.0 END) * -y / (1 + exp(y * s)) AS g FROM (SELECT f.sample, any_value(l.y) AS y, sum(x * wt) + (SELECT bias FROM {name}_b{k}) AS s FROM {features} f JOIN {name}_w{k} USING (feature) JOIN {labels} l USING (sample) GROUP BY f.sample)),
        {name}_w{k + 1} AS (SELECT feature, any_value(w.wt) * 0.99 - 0.5 * sum(x * g) / (SELECT n FROM {name}_n) AS wt FROM {features} f JOIN {name}_p{k} USING (sample) JOIN {name}_w{k} w USING (feature) GROUP BY feature),
        {name}_b{k + 1} AS (SELECT bias - 0.5 * (SELECT sum(g) FROM {name}_p{k}) / (SELECT n FROM {name}_n) AS bias FROM {name}_b{k})"""
    return f"{out}, {name}_w AS (SELECT * FROM {name}_w{rounds}), {name}_b AS (SELECT * FROM {name}_b{rounds})"


_LABELLED = f"{i.CELLS}, {_FEATURES}, labels AS (SELECT DISTINCT sample, CASE WHEN cluster = 0 THEN 1 ELSE -1 END AS y FROM cells)"


@query("train_linear", f"WITH {_LABELLED}, {_trained('t', 'features', 'labels', 3)} SELECT feature, round(wt, 5) + 0.0::DOUBLE AS wt, round((SELECT bias FROM t_b), 5) AS bias FROM t_w")
def train_linear(spark, sf):
    c = i.cells(spark, sf)
    weights, bias = n.train_linear(n.feature_rows(c), _labels(c), rounds=3)
    return weights.select("feature", r("wt", 5).alias("wt"), r(F.lit(bias), 5).alias("bias"))


_FOLDS = ", ".join(f"f{k} AS (SELECT * FROM features WHERE sample % 2 <> {k}), l{k} AS (SELECT * FROM labels WHERE sample % 2 <> {k}), {_trained(f't{k}', f'f{k}', f'l{k}', 2)}, s{k} AS (SELECT sample, any_value(y) AS y, sum(x * wt) + (SELECT bias FROM t{k}_b) AS s FROM features JOIN t{k}_w USING (feature) JOIN labels USING (sample) WHERE sample % 2 = {k} GROUP BY sample)" for k in (0, 1))


@query("cross_validate", f"WITH {_LABELLED}, {_FOLDS} " + " UNION ALL ".join(f"SELECT {k} AS fold, count(*) AS n, round(avg(CASE WHEN (CASE WHEN s > 0 THEN 1 ELSE -1 END) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((s - y) * (s - y)), 4) AS mse FROM s{k}" for k in (0, 1)))
def cross_validate(spark, sf):
    c = i.cells(spark, sf)
    return t.cross_validate(n.feature_rows(c), _labels(c), 2, 2).withColumns({"accuracy": r("accuracy"), "mse": r("mse", 4)})


@query("squared_correlation", f"WITH {i.BOXES} SELECT count(*) AS n, round(avg((lx - ly) * (lx - ly)), 6) AS mse, round(pow(corr(lx, ly), 2), 8) AS r2 FROM boxes")
def squared_correlation(spark, sf):
    return t.squared_correlation(i.boxes(spark, sf), "lx", "ly").withColumns({"mse": r("mse"), "r2": r("r2", 8)})


_ROUND = """mean{k} AS (SELECT cluster, idx, sum(val * w) / sum(w) AS mean FROM c{k} SEMI JOIN (SELECT cluster, idx FROM c{k} WHERE w > 0 GROUP BY cluster, idx HAVING count(*) >= 2) USING (cluster, idx) GROUP BY cluster, idx HAVING sum(w) > 0),
    err{k} AS (SELECT sample, m.cluster, sum(c.w * (val - mean) * (val - mean)) AS error FROM c{k} c JOIN mean{k} m USING (idx) WHERE c.w > 0 GROUP BY sample, m.cluster),
    as{k} AS (SELECT sample, cluster, error FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY error, cluster) AS rk FROM err{k}) WHERE rk = 1), c{n} AS (SELECT a.sample, a.cluster, idx, val, w FROM cells JOIN as{k} a USING (sample))"""
_JOINT = f"{i.CELLS}, c0 AS (SELECT * FROM cells), " + ", ".join(_ROUND.format(k=k, n=k + 1) for k in range(3))


@query("joint_models", f"WITH {_JOINT} SELECT sample, cluster, round(error, 6) AS error FROM as2")
def joint_models(spark, sf):
    return n.joint_models(i.cells(spark, sf))[1].select("sample", "cluster", r("error").alias("error"))


@query("cluster_members", f"WITH {_ERRORS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY error, cluster) AS k FROM errors) SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY sample) - 1 AS INTEGER) AS place, sample FROM k WHERE k = 1 AND sqrt(error) <= 1.2")
def cluster_members(spark, sf):
    c = i.cells(spark, sf)
    a = n.assign_clusters(n.cluster_errors(c, n.cell_mean(c)), 1.2)
    return t.cluster_members(a, a.filter("gamma > 0"))


@query("cluster_sides", f"WITH {i.BOXES} SELECT obb_id % 4 AS cluster, round(avg(lx), 6) AS lx, round(avg(ly), 6) AS ly, round(avg(lz), 6) AS lz FROM boxes GROUP BY 1")
def cluster_sides(spark, sf):
    box = i.boxes(spark, sf)
    return t.mean_sides(box, box.select(F.col("obb_id").alias("sample"), (F.col("obb_id") % 4).alias("cluster"))).select("cluster", *[r(c).alias(c) for c in ("lx", "ly", "lz")])


_U, _T = "(vx * cos(0.4) + vy * sin(0.4))", "(vy * cos(0.4) - vx * sin(0.4))"


@query("major_box", f"""WITH {i.VOX}, o AS (SELECT {_U} AS u, {_T} AS t, vz FROM vox WHERE label = 2), a AS (SELECT count(*) AS n, min(u) AS u0, max(u) AS u1, min(t) AS t0, max(t) AS t1, min(vz) AS z0, max(vz) AS z1 FROM o),
    h AS (SELECT CAST(floor((u - u0) / 4) AS INTEGER) AS hx, CAST(floor((t - t0) / 4) AS INTEGER) AS hy, count(*) AS n FROM o, a GROUP BY 1, 2), gx AS (SELECT CAST(unnest(range(CAST((SELECT max(hx) FROM h) AS BIGINT) + 1)) AS INTEGER) AS x), gy AS (SELECT CAST(unnest(range(CAST((SELECT max(hy) FROM h) AS BIGINT) + 1)) AS INTEGER) AS y),
    c AS (SELECT x, y, coalesce(n, 0) AS n FROM gx, gy LEFT JOIN h ON hx = x AND hy = y), integral AS (SELECT p.x, p.y, sum(q.n) AS t FROM c p JOIN c q ON q.x <= p.x AND q.y <= p.y GROUP BY ALL),
    z AS (SELECT x, y, t FROM integral UNION ALL SELECT x, -1, 0 FROM gx UNION ALL SELECT -1, y, 0 FROM gy UNION ALL SELECT -1, -1, 0),
    e AS (SELECT l.x + 1 AS x0, b.y + 1 AS y0, r.x AS x1, r.y AS y1, r.t - l2.t - b.t + l.t AS held FROM z r JOIN z l ON l.x < r.x AND l.y < r.y JOIN z l2 ON l2.x = l.x AND l2.y = r.y JOIN z b ON b.x = r.x AND b.y = l.y),
    best AS (SELECT * FROM e, a WHERE held >= ceil(0.6 * n) ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1), x0, y0, x1, y1 LIMIT 1)
    SELECT round((u0 + x0 * 4 + (x1 - x0 + 1) * 2) * cos(0.4) - (t0 + y0 * 4 + (y1 - y0 + 1) * 2) * sin(0.4), 6) AS cx, round((x1 - x0 + 1) * 4.0::DOUBLE, 6) AS lx, round((y1 - y0 + 1) * 4.0::DOUBLE, 6) AS ly, CAST(z1 - z0 AS DOUBLE) AS lz FROM best""")
def major_box(spark, sf):
    return t.major_box(i.voxels(spark, sf), 2, 0.4, 4, 0.6).select(r("cx").alias("cx"), r("lx").alias("lx"), r("ly").alias("ly"), "lz")


_DRAW = "(CAST('0x' || substr(md5(concat_ws('|', {k})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"


def _draw(*keys: str) -> str:
    return "(" + _DRAW.format(k=", ".join(f"CAST({k} AS VARCHAR)" for k in keys)) + ")"


def _normal(*keys: str) -> str:
    return f"(sqrt(-2 * ln({_draw(*keys, '1')})) * cos(2 * pi() * {_draw(*keys, '2')}))"


@query("jitter_boxes", f"""WITH {i.BOXES} SELECT obb_id, copy, round(cx + {_normal('obb_id', 'copy', '0', '0')} * 0.1 * lx, 6) AS cx, round(cy + {_normal('obb_id', 'copy', '0', '1')} * 0.1 * ly, 6) AS cy, round(theta + (2 * {_draw('obb_id', 'copy', '0', '2')} - 1) * pi() / 16, 6) AS theta
    FROM boxes, (SELECT CAST(unnest(range(5)) AS INTEGER) AS copy)""")
def jitter_boxes(spark, sf):
    return b.jitter(i.boxes(spark, sf), 5).select("obb_id", "copy", *[r(c).alias(c) for c in ("cx", "cy", "theta")])


@query("random_negatives", f"""WITH {i.BOXES}, draws AS (SELECT -id - 1 AS obb_id, 60 * {_draw('id', '0', '0')} AS cx, 60 * {_draw('id', '0', '1')} AS cy, 0.0::DOUBLE AS bz, 2.0::DOUBLE AS lx, 2.0::DOUBLE AS ly, 2.0::DOUBLE AS lz, {_draw('id', '0', '2')} * 2 * pi() AS theta FROM (SELECT unnest(range(400)) AS id))
    SELECT obb_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(theta, 6) AS theta FROM draws a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE {TOUCH3}) ORDER BY obb_id DESC LIMIT 200""")
def random_negatives(spark, sf):
    return b.random_negatives(i.boxes(spark, sf), (2.0, 2.0, 2.0), (0.0, 0.0), (60.0, 60.0), 200).select("obb_id", *[r(c).alias(c) for c in ("cx", "cy", "theta")])


_C, _S = "cos(0.3)", "sin(0.3)"


@query("transform_volume", f"""WITH {i.VOX}, moved AS (SELECT CAST(round_even(vx * {_C} - vy * {_S} + 2, 0) AS INTEGER) AS vx, CAST(round_even(vx * {_S} + vy * {_C} - 1, 0) AS INTEGER) AS vy, CAST(round_even(vz + 3.0, 0) AS INTEGER) AS vz FROM vox),
    k AS (SELECT DISTINCT vx & -8 AS x, vy & -8 AS y, vz & -8 AS z FROM moved), tg AS (SELECT CAST(x + a AS INTEGER) AS tx, CAST(y + b AS INTEGER) AS ty, CAST(z + c AS INTEGER) AS tz FROM k, (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b), (SELECT unnest(range(8)) AS c)),
    numbered AS (SELECT row_number() OVER () AS pid, * FROM tg), pts AS (SELECT pid, (tx - 2.0) * {_C} + (ty + 1.0) * {_S} AS px, (ty + 1.0) * {_C} - (tx - 2.0) * {_S} AS py, CAST(tz - 3.0 AS DOUBLE) AS pz FROM numbered), {_CORNERS},
    t AS (SELECT pid, sum(share * d) / sum(share) AS d, sum(share * w) / sum(share) AS w FROM met GROUP BY pid HAVING sum(share) > 0.4) SELECT tx AS vx, ty AS vy, tz AS vz, round(d, 6) + 0.0::DOUBLE AS d, round(w, 6) AS w FROM t JOIN numbered USING (pid)""")
def transform_volume(spark, sf):
    return v.transform(i.voxels(spark, sf), 0.3, (2.0, -1.0, 3.0)).select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))
