"""Closed-form fixtures, properties and metamorphic checks."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import boxes as b
from tessera.operators import depth as d
from tessera.operators import mesh as m
from tessera.operators import volume as v
from tessera.plans.components import connected_components
from tessera.sources import text as sources
from tessera.streaming.fusion import VolumeSink, empty_state, fold_batch

OBS = "seq long, vx int, vy int, vz int, d double, w double"


def observed(spark, steps):
    return spark.createDataFrame([(i, 0, 0, 0, float(x), float(w)) for i, (x, w) in enumerate(steps)], OBS)


def fold(steps):
    x, w = 0.0, 0.0
    for y, u in steps:
        if u > 0 and -1.0 <= y <= 1.2:
            x, w = (x * w + y * u) / (w + u), min(w + u, 5.0)
    return x, w


def test_saturating_fold(spark):
    r = v.fuse(observed(spark, [(1, 3), (0, 4), (1, 1)])).first()
    assert r["d"] == pytest.approx(11 / 21) and r["w"] == 5


def test_fold_rejects(spark):
    assert v.fuse(observed(spark, [(2, 1), (0.5, 0)])).count() == 0
    assert v.fuse(observed(spark, [])).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1, 1.2), st.floats(0.01, 4)), min_size=1, max_size=30), st.integers(1, 7))
def test_fold_in_parts_is_the_fold(spark, steps, chunk):
    r = v.fuse(observed(spark, steps), chunk=chunk).first()
    x, w = fold(steps)
    assert r["d"] == pytest.approx(x, abs=1e-9) and r["w"] == pytest.approx(w)


def test_brick_mask(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-9, -8, -1, 0, 7, 8)], "v int").select(g.brick("v")).collect()]
    assert got == [-16, -8, -8, 0, 0, 8]


def cube(spark, keep=range(8)):
    cells = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    return spark.createDataFrame([(*cells[i], float(cells[i][0] + 2 * cells[i][1] + 4 * cells[i][2]), 1.0) for i in keep], "vx int, vy int, vz int, d double, w double")


def test_trilinear_and_gradient(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "pid long, px double, py double, pz double")
    assert v.trilinear(p, cube(spark)).first()["d"] == pytest.approx(3.5)
    r = v.gradient(p, cube(spark)).first()
    assert (r["gx"], r["gy"], r["gz"]) == pytest.approx((1, 2, 4))
    assert v.trilinear(p, cube(spark, [0, 3, 6])).count() == 0  # 0.375 of the weight isn't enough
    assert v.gradient(p, cube(spark, range(7))).count() == 0


def test_weight_ramp(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, -0.04, -0.6, -1.0)], "x double").select(g.ramp_weight(F.col("x"))).collect()]
    assert got == pytest.approx([1, 1, 0.05, 0])


def test_slice_and_rest_are_all(spark):
    vox = cube(spark)
    p = F.col("vx") > 0
    assert v.select(vox, p).unionByName(v.outside(vox, p)).count() == vox.count()


def test_transform_identity(spark):
    vox = cube(spark)
    back = {tuple(r)[:3]: r["d"] for r in v.transform(vox, 0.0, (0, 0, 0)).collect()}
    assert back == {tuple(r)[:3]: r["d"] for r in vox.collect()}


def box(spark, *rows):
    return spark.createDataFrame([(i, 0, float(s), float(x), 0.0, 0.0, 1.0, 1.0, 1.0, 0.0) for i, (s, x) in enumerate(rows)], "obb_id long, category int, score double, cx double, cy double, bz double, lx double, ly double, lz double, theta double")


def test_iou(spark):
    x = box(spark, (1, 0), (1, 0), (1, 3))
    pairs = b.candidate_pairs(x, x).filter("a_obb_id < b_obb_id")
    got = {(r["a_obb_id"], r["b_obb_id"]): r["iou"] for r in b.iou(pairs.filter(b.touch_3d())).collect()}
    assert got == {(0, 1): pytest.approx(1.0)}


def test_nms_chain_and_idempotence(spark):
    x = box(spark, (3, 0), (2, 0.6), (1, 1.2))
    kept = b.suppress(x, b.nms_pairs(x))
    assert sorted(r["obb_id"] for r in kept.collect()) == [0, 2]
    assert b.suppress(kept, b.nms_pairs(kept)).count() == 2


def test_affine_roundtrip(spark):
    x = box(spark, (1, 2)).withColumn("theta", F.lit(0.7))
    r = b.from_affine(b.affine(x)).first()
    assert (r["cx"], r["lx"], r["theta"]) == pytest.approx((2, 1, 0.7))


def test_depth_quad(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 1.1), (0, 0, 1, 2.0), (0, 1, 0, 2.05)], "frame int, y int, x int, depth double")
    # |d0 - d3| = 0.1 and |d1 - d2| = 0.05: the split runs along 1-2
    assert sorted(r["t"] for r in d.triangulate(px).collect()) == [2, 3]


def test_rle(spark):
    scan = spark.createDataFrame([(0, i, x) for i, x in enumerate([-1, -1, 7, 9, 9, -2, -2, -2])], "y int, pos int, value int")
    runs = d.rle_encode(scan)
    assert [(r["kind"], r["length"]) for r in runs.orderBy("start").collect()] == [("E", 2), ("V", 3), ("F", 3)]
    assert sorted(map(tuple, d.rle_decode(runs).collect())) == sorted(map(tuple, scan.collect()))


def test_component_sizes(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 10, 11, 12)], "fid long, v0 long, v1 long, v2 long")
    assert sorted(r["fid"] for r in m.keep_components(f, -1).collect()) == [0, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_a_long_path(spark):
    path = spark.range(700).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path).filter("component <> 0").count() == 0


def test_smallest_rectangle(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, (5, 5))
    hist = spark.createDataFrame([(x, y, int(h[x, y])) for x in range(5) for y in range(5)], "hx int, hy int, n long")
    best = min(((x1 - x0 + 1) * (y1 - y0 + 1), x0, y0, x1, y1) for x0 in range(5) for x1 in range(x0, 5) for y0 in range(5) for y1 in range(y0, 5) if h[x0 : x1 + 1, y0 : y1 + 1].sum() >= 9)
    r = v.smallest_rectangle(v.integral2d(hist, 5, 5), 9).first()
    assert (r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) == best


def test_streamed_fusion(spark, tmp_path):
    steps = [(math.sin(i), 0.3 + i % 3) for i in range(40)]
    obs = observed(spark, steps)
    sink = VolumeSink(str(tmp_path / "volume"))
    for n, part in enumerate((obs.filter("seq < 13"), obs.filter("seq between 13 and 29"), obs.filter("seq > 29"))):
        sink(part, n)
        sink(part, n)  # delivered again
    whole = v.fuse(obs).first()
    r = sink.state(spark).first()
    assert (r["d"], r["w"]) == pytest.approx((whole["d"], whole["w"]))
    assert fold_batch(empty_state(spark), obs).first()["d"] == pytest.approx(whole["d"])


def test_streamed_versions_hold_touched_voxels_and_are_merged(spark, tmp_path):
    rows = [(i, i * 7 % 5, 0, 0, math.sin(i), 0.3 + i % 3) for i in range(60)]
    obs = spark.createDataFrame(rows, OBS)
    folder = tmp_path / "volume"
    sink = VolumeSink(str(folder), merge_every=2)
    for n in range(7):
        part = obs.filter(F.col("seq").between(n * 9, n * 9 + 8)).filter(F.lit(n != 3) | (F.col("vx") == 1))
        sink(part, n)
        sink(part, n)
        if n == 3:
            sole = spark.read.parquet(str(folder / "v000000000003"))
            assert [r["vx"] for r in sole.select("vx").collect()] == [1]
    kept = obs.filter("seq not between 27 and 35 or vx = 1")
    whole = {r["vx"]: (r["d"], r["w"]) for r in v.fuse(kept).collect()}
    got = {r["vx"]: (r["d"], r["w"]) for r in sink.state(spark).collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
    # whole volumes at 1, 3 and 5: what the one at 3 replaced is gone
    assert sorted(p.name[0] + str(int(p.name[1:])) for p in folder.iterdir() if p.is_dir()) == ["v4", "v5", "v6", "w3", "w5"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2 3\n1 0 2\n0 0 5\n")
    got = sorted(map(tuple, sources.matrix(spark, str(tmp_path / "m.txt")).collect()))
    assert got == [(0, 0, 1.0), (0, 2, 2.0), (1, 2, 5.0)]
    (tmp_path / "b.txt").write_text("".join(f"{c}\n3 4\n1 0 0 {c}\n0 1 0 0\n0 0 1 0\n" for c in (2, 0)))
    assert [(r["category"], r["m"][3]) for r in sources.annotated_boxes(spark, str(tmp_path / "b.txt")).orderBy("ordinal").collect()] == [(2, 2.0), (0, 0.0)]
    numbers = " ".join(str(i) for i in range(54))
    (tmp_path / "c.txt").write_text("t1 0.1\nt2 3\ntn 64\np1 -1\np2 1\npn 64\n" + numbers)
    r = sources.cameras(spark, str(tmp_path / "c.txt")).first()
    assert r["theta_n"] == 64 and r["r1"][0] == 0 and r["tr"][-1] == 53
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "fid long, v0 long, v1 long, v2 long")
    sources.write_obj(vertices, faces, str(tmp_path / "obj"))
    whole = "\n".join(p.read_text().strip() for p in sorted((tmp_path / "obj").glob("part-*")))
    (tmp_path / "one.obj").write_text(whole)
    vs, fs = sources.obj_mesh(spark, str(tmp_path / "one.obj"))
    assert vs.count() == 3 and tuple(fs.select("v0", "v1", "v2").first()) == (0, 1, 2)


def test_surface_of_a_ball_is_closed_and_turned_outwards(spark):
    from tessera.operators import surface

    cells = [(x, y, z, float(np.sqrt((x - 4.1) ** 2 + (y - 4.2) ** 2 + (z - 3.9) ** 2) - 2.7), 1.0) for x in range(9) for y in range(9) for z in range(9)]
    t = surface.extract(spark.createDataFrame(cells, "vx int, vy int, vz int, d double, w double")).toPandas()
    corners = [[tuple(np.round(t.loc[i, [f"{c}{k}" for c in "xyz"]].to_numpy(float), 7)) for k in range(3)] for i in t.index]
    once = {}
    for tri in corners:
        for k in range(3):
            e = (tri[k], tri[(k + 1) % 3])
            once[e] = once.get(e, 0) + 1
    assert all(once.get((b, a), 0) == n == 1 for (a, b), n in once.items())
    outside = [np.dot(np.cross(np.subtract(b, a), np.subtract(c, a)), np.mean([a, b, c], 0) - [4.1, 4.2, 3.9]) for a, b, c in corners]
    assert min(outside) > 0


def test_random_steps_repeat_and_avoid(spark):
    x = box(spark, (1, 0), (1, 5))
    moved = b.jitter(x, 40)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, b.jitter(x.repartition(3), 40).collect()))
    assert len({round(r["cx"] - 5 * r["obb_id"], 9) for r in moved.collect()}) == 80
    free = b.random_negatives(x, (1, 1, 1), (-2, -2), (8, 2), 30)
    assert free.count() == 30 and b.overlaps(free, x).count() == 0


def test_shared_volume_equals_a_count_of_the_grid_points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0.0, *rng.uniform(0, 4, 2).tolist(), float(rng.uniform(0, 1)), *(rng.integers(1, 5, 3) * 1.0).tolist(), float(rng.integers(0, 8) * np.pi / 4 if i % 2 else rng.uniform(0, 6))) for i in range(12)]
    x = spark.createDataFrame(rows, "obb_id long, category int, score double, cx double, cy double, bz double, lx double, ly double, lz double, theta double")
    n, k = 9, np.arange(9) / 8

    def share(a, o):
        u, v = ((k - 0.5) * a["lx"])[:, None], ((k - 0.5) * a["ly"])[None]
        px, py = a["cx"] + u * np.cos(a["theta"]) - v * np.sin(a["theta"]) - o["cx"], a["cy"] + u * np.sin(a["theta"]) + v * np.cos(a["theta"]) - o["cy"]
        c, s, z = np.cos(o["theta"]), np.sin(o["theta"]), a["bz"] + k * a["lz"]
        flat = (np.abs(px * c + py * s) <= o["lx"] / 2 + 1e-9) & (np.abs(py * c - px * s) <= o["ly"] / 2 + 1e-9)
        return flat.sum() * ((z >= o["bz"] - 1e-9) & (z <= o["bz"] + o["lz"] + 1e-9)).sum() / n**3

    got = b.iou(b.candidate_pairs(x, x), n).collect()
    assert len(got) > 50
    for p in got:
        a, o = ({c: p[f"{t}_{c}"] for c in b.GEOMETRY} for t in "ab")
        assert (p["a_in_b"], p["b_in_a"]) == pytest.approx((share(a, o), share(o, a)), abs=1e-12)


def test_shared_volume_of_many_pairs(spark):
    """Two million grid points a thousand pairs: a fold for each pair took minutes for these 90,000 pairs."""
    import time

    side = spark.range(300).selectExpr("id as obb_id", "0 as category", "id / 300 as score", "id % 7 * 0.1 as cx", "id % 5 * 0.1 as cy", "0.0D as bz", "3.0D as lx", "2.0D as ly", "1.0D as lz", "id * 0.37 as theta")
    began = time.monotonic()
    assert b.iou(b.candidate_pairs(side, side)).filter("inter > 0").count() == 90_000
    assert time.monotonic() - began < 40


def test_dealt_shares_of_a_cell_give_the_same_pairs(spark, monkeypatch):
    x = box(spark, *[(i, i * 0.4) for i in range(30)])
    want = sorted(tuple(r) for r in b.candidate_pairs(x, x).select("a_obb_id", "b_obb_id").collect())
    monkeypatch.setattr(b, "SENT", 7)
    assert sorted(tuple(r) for r in b.candidate_pairs(x, x).select("a_obb_id", "b_obb_id").collect()) == want and len(want) > 30


@pytest.mark.parametrize("walked", [0, 20, 10**6])
def test_thinned_suppression_keeps_what_the_greedy_walk_keeps(spark, walked):
    rng = np.random.default_rng(3)
    score = rng.permutation(60)
    order = np.argsort(-score)
    pairs = [(int(order[i]), int(order[j])) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.08]
    x = box(spark, *[(int(s), 0.0) for s in score])
    kept = b.suppress(x, spark.createDataFrame(pairs, "a long, b long"), walked)
    assert {r["obb_id"] for r in kept.collect()} == b._greedy(pairs, order.tolist())
