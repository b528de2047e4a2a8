"""More operators on triangle meshes: welding, cleaning, transforms, distances, rays, voxelising and alignment.

Faces are (fid, v0, v1, v2), vertices (vid, x, y, z) as in ``mesh``.  What is
near what is found by grid cells: a thing is put into every cell it can reach,
and things meet in cells by equi-join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import mesh as m
from tessera.operators.boxes import uniform
from tessera.plans.components import connected_components, settle

Vector = list[Column]


def vector(prefix: str, suffix: str = "") -> Vector:
    return [F.col(f"{prefix}{c}{suffix}") for c in "xyz"]


def minus(a: Vector, b: Vector) -> Vector:
    return [p - q for p, q in zip(a, b, strict=True)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance): pairs of points (pid, x, y, z) no further apart than the radius, a < b."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    spread = points.select(F.col("pid").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    for c in "xyz":
        spread = spread.withColumn(f"k{c}", F.explode(F.array(*[F.col(f"k{c}") + i for i in (-1, 0, 1)])))
    there = points.select(F.col("pid").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    met = spread.join(there, ["kx", "ky", "kz"]).filter("a < b")
    return met.select("a", "b", norm(minus(vector("a"), vector("b"))).alias("distance")).filter(F.col("distance") <= radius)


def weld_radius(vertices: DataFrame, radius: float) -> DataFrame:
    """(vid, target): in order of vid, a vertex that no earlier representative has taken becomes one and takes all within the radius.

    A vertex that several take goes to the last of them.  Who takes whom
    depends on vertices that close pairs connect only: components are walked
    side by side.
    """
    pairs = settle(close_pairs(vertices.withColumnRenamed("vid", "pid"), radius).select("a", "b"), "weld-pairs")
    inside = connected_components(pairs).withColumnRenamed("component", "group")
    edges = pairs.join(inside, pairs["a"] == inside["node"]).select("group", "a", "b")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        target: dict[int, int] = {}
        for v in sorted(near):
            if v not in target:
                target[v] = v
                target.update((o, v) for o in near[v])
        return pd.DataFrame({"vid": list(target), "target": list(target.values())}, dtype="int64")

    taken = edges.groupBy("group").applyInPandas(walk, "vid long, target long")
    return vertices.select("vid").join(taken, "vid", "left").select("vid", F.coalesce("target", "vid").alias("target"))


def merged(vertices: DataFrame, targets: DataFrame, radius: float, *means: str) -> DataFrame:
    """(vid, x, y, z, means..): each representative at the mean of all vertices within the radius, with the means of other columns."""
    pairs = close_pairs(vertices.withColumnRenamed("vid", "pid"), radius).select("a", "b")
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(vertices.select(F.col("vid").alias("a"), F.col("vid").alias("b")))
    mine = near.join(targets.filter("vid = target").select(F.col("vid").alias("a")), "a", "left_semi")
    columns = ["x", "y", "z", *means]
    return mine.join(vertices.select(F.col("vid").alias("b"), *columns), "b").groupBy(F.col("a").alias("vid")).agg(*[F.avg(c).alias(c) for c in columns])


def drop_lone_faces(faces: DataFrame, vertices: DataFrame, reach: float, most: int) -> DataFrame:
    """The faces but for clusters of ``most`` faces or fewer; faces whose centroids lie within ``reach`` are of one cluster."""
    centres = m.face_geometry(faces, vertices).select(F.col("fid").alias("pid"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    found = connected_components(close_pairs(centres, reach).select("a", "b"))
    large = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    kept = found.join(large, "component", "left_semi").select(F.col("node").alias("fid"))
    alone = centres.select(F.col("pid").alias("fid")).join(found.select(F.col("node").alias("fid")), "fid", "left_anti") if most < 1 else None
    return faces.join(kept if alone is None else kept.unionByName(alone), "fid", "left_semi")


def moved(vertices: DataFrame, matrix: list[float]) -> DataFrame:
    """Vertices under a row-major 3 x 4 map: turns, scales and shifts are such maps."""
    x = vector("")
    return vertices.withColumns({c: dot([F.lit(float(k)) for k in matrix[4 * i : 4 * i + 3]], x) + float(matrix[4 * i + 3]) for i, c in enumerate("xyz")})


def flipped(faces: DataFrame) -> DataFrame:
    """Faces turned inside out."""
    return faces.withColumns({"v1": F.col("v2"), "v2": F.col("v1")})


def inflated(faces: DataFrame, vertices: DataFrame, amount: float) -> DataFrame:
    """Vertices moved along their normals."""
    n = m.vertex_normals(faces, vertices)
    return vertices.join(n, "vid", "left").select("vid", *[(F.col(c) + amount * F.coalesce(f"n{c}", F.lit(0.0))).alias(c) for c in "xyz"])


def noisy(vertices: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """Vertices moved by up to ``amount`` along each axis, the same in every run."""
    return vertices.withColumns({c: F.col(c) + amount * (2 * uniform(F.col("vid"), F.lit(seed), F.lit(i)) - 1) for i, c in enumerate("xyz")})


def bounds(vertices: DataFrame) -> DataFrame:
    """One row: least and largest coordinates, centre and radius of the sphere around the box's centre that holds all."""
    box = vertices.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    mid = [(F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"]
    far = vertices.crossJoin(F.broadcast(box)).agg(F.max(norm(minus(vector(""), mid))).alias("radius"))
    return box.crossJoin(far).withColumns({f"mid_{c}": k for c, k in zip("xyz", mid, strict=True)})


def box_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The least box (min_x .. max_z) around two boxes, each of one row."""
    both = a.unionByName(b)
    return both.agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def box_distance(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """(pid, distance) of points to an axis-aligned box; 0 inside."""
    gaps = [F.greatest(F.lit(float(a)) - F.col(c), F.lit(0.0), F.col(c) - float(z)) for c, a, z in zip("xyz", low, high, strict=True)]
    return points.select("pid", norm(gaps).alias("distance"))


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, length) of the distinct edges."""
    e = m.edges(faces).select("a", "b").distinct()
    p = lambda s: vertices.select(F.col("vid").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"])
    return e.join(p("a"), "a").join(p("b"), "b").select("a", "b", norm(minus(vector("a"), vector("b"))).alias("length"))


def feature_size(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: the median length of the distinct edges, exact."""
    return edge_lengths(faces, vertices).agg(F.percentile("length", 0.5).alias("size"))


def corner_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, k, angle): the angle at each corner of each face."""
    p = m.with_points(faces, vertices)
    points = [vector("", str(k)) for k in range(3)]

    def at(k: int) -> Column:
        u, w = minus(points[(k + 1) % 3], points[k]), minus(points[(k + 2) % 3], points[k])
        return F.atan2(norm(cross(u, w)), dot(u, w))

    return p.select("fid", F.posexplode(F.array(*[at(k) for k in range(3)])).alias("k", "angle"))


def dihedrals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, angle): the angle between the normals of the two faces on an edge; edges of other numbers of faces are left out."""
    n = m.face_geometry(faces, vertices).select("fid", "nx", "ny", "nz")
    e = m.edges(faces).join(n, "fid").groupBy("a", "b").agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("p"), F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("q")).filter("n = 2")
    p, q = ([F.col(f"{s}.n{c}") for c in "xyz"] for s in "pq")
    return e.select("a", "b", F.atan2(norm(cross(p, q)), dot(p, q)).alias("angle"))


def edge_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, n, nx, ny, nz): each edge's faces counted and their unit normals summed; n = 1 is the boundary."""
    n = m.face_geometry(faces, vertices).select("fid", "nx", "ny", "nz")
    return m.edges(faces).join(n, "fid").groupBy("a", "b").agg(F.count("*").alias("n"), *[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])


def weighted_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): area vectors summed at each corner over the product of its two edges' squared lengths, to unit length."""
    p = m.with_points(faces, vertices)
    points = [vector("", str(k)) for k in range(3)]
    area = cross(minus(points[1], points[0]), minus(points[2], points[0]))

    def at(k: int) -> Column:
        u, w = minus(points[(k + 1) % 3], points[k]), minus(points[(k + 2) % 3], points[k])
        weight = F.nullif(dot(u, u) * dot(w, w), F.lit(0.0))
        return F.struct(F.col(f"v{k}").alias("vid"), *[(a / weight).alias(f"n{c}") for a, c in zip(area, "xyz", strict=True)])

    s = p.select(F.explode(F.array(*[at(k) for k in range(3)])).alias("c")).groupBy("c.vid").agg(*[F.sum(f"c.n{c}").alias(f"n{c}") for c in "xyz"])
    size = norm(vector("n"))
    return s.withColumn("size", size).filter("size > 0").select("vid", *[(F.col(f"n{c}") / F.col("size")).alias(f"n{c}") for c in "xyz"])


def point_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, area): a third of the faces' areas around each vertex."""
    f = m.face_geometry(faces, vertices)
    return f.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), (F.col("area") / 3).alias("a")).groupBy("vid").agg(F.sum("a").alias("area"))


def curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, curvature): what a vertex's corner angles lack of a full turn, over its area; vertices on the boundary are left out."""
    angles = corner_angles(faces, vertices).join(faces.select("fid", F.array("v0", "v1", "v2").alias("v")), "fid").select(F.get("v", "k").alias("vid"), "angle")
    rim = m.boundary(faces)
    rim = rim.select(F.col("a").alias("vid")).unionByName(rim.select(F.col("b").alias("vid"))).distinct()
    turn = angles.groupBy("vid").agg(F.sum("angle").alias("turn")).join(rim, "vid", "left_anti")
    return turn.join(point_areas(faces, vertices), "vid").select("vid", ((2 * g.PI - F.col("turn")) / F.col("area")).alias("curvature"))


def diffused(faces: DataFrame, values: DataFrame, rounds: int = 1, share: float = 0.5) -> DataFrame:
    """(vid, value): values on vertices moved towards the mean of their neighbours', again and again."""
    e = m.edges(faces).select("a", "b").distinct()
    both = e.select(F.col("a").alias("vid"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("vid"), F.col("a").alias("o")))
    for i in range(rounds):
        mean = both.join(values.select(F.col("vid").alias("o"), F.col("value").alias("there")), "o").groupBy("vid").agg(F.avg("there").alias("mean"))
        values = values.join(mean, "vid", "left").select("vid", (F.col("value") + share * (F.coalesce("mean", "value") - F.col("value"))).alias("value"))
        if i % 3 == 2:
            values = settle(values, "diffused")
    return values


def slanted(faces: DataFrame, vertices: DataFrame, ratio: float | None = None, eye: tuple[float, float, float] | None = None, cosine: float = 0.1) -> DataFrame:
    """(fid): faces whose longest edge is more than ``ratio`` times the shortest, or that the eye sees from the side."""
    p = m.with_points(faces, vertices)
    points = [vector("", str(k)) for k in range(3)]
    sides = [norm(minus(points[(k + 1) % 3], points[k])) for k in range(3)]
    bad = F.lit(False)
    if ratio is not None:
        bad = bad | (F.greatest(*sides) > ratio * F.least(*sides))
    if eye is not None:
        ray = minus([F.lit(float(c)) for c in eye], points[0])
        n = cross(minus(points[1], points[0]), minus(points[2], points[0]))
        bad = bad | (F.abs(dot(n, ray)) < cosine * norm(n) * norm(ray))
    return p.filter(bad).select("fid")


def clean_triangles(faces: DataFrame, vertices: DataFrame, ratio: float, eye: tuple[float, float, float], cosine: float) -> DataFrame:
    """A depth map's faces without slanted ones and all that touch them: by edge ratio first, then by the angle to the eye among those left."""
    left = m.drop_slanted(faces, slanted(faces, vertices, ratio))
    return m.drop_slanted(left, slanted(left, vertices, None, eye, cosine))


def to_triangles(pairs: DataFrame) -> DataFrame:
    """pairs of a point (px, py, pz) and a triangle (x0 .. z2) with distance, side and edge.

    side is above 0 in front of the triangle; edge is the nearest edge's
    number where the nearest point isn't inside, else -1.  Each step's columns
    come from a generator, so that the next one doesn't repeat their
    expressions.
    """
    p, t = vector("p"), [vector("", str(k)) for k in range(3)]
    one = F.struct(*[x.alias(f"n{c}") for c, x in zip("xyz", cross(minus(t[1], t[0]), minus(t[2], t[0])), strict=True)])
    with_normal = pairs.select("*", F.inline(F.array(one)))
    n = vector("n")

    def to_edge(k: int) -> Column:
        a, e = minus(p, t[k]), minus(t[(k + 1) % 3], t[k])
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot(a, e) / F.nullif(dot(e, e), F.lit(0.0)), F.lit(0.0))))
        return share.alias(f"s{k}")

    turns = [dot(cross(minus(t[(k + 1) % 3], t[k]), minus(p, t[k])), n) >= 0 for k in range(3)]
    two = F.struct(*[to_edge(k) for k in range(3)], reduce(lambda a, b: a & b, turns).alias("over"), dot(minus(p, t[0]), n).alias("side"), F.nullif(norm(n), F.lit(0.0)).alias("size"))
    placed = with_normal.select("*", F.inline(F.array(two)))
    far = [norm([q - F.col(f"s{k}") * r for q, r in zip(minus(p, t[k]), minus(t[(k + 1) % 3], t[k]), strict=True)]) for k in range(3)]
    three = F.struct((F.col("over") & F.col("size").isNotNull()).alias("inside"), F.array(*far).alias("edges"))
    measured = placed.select("*", F.inline(F.array(three)))
    nearest = F.array_min("edges")
    distance = F.when(F.col("inside"), F.abs("side") / F.col("size")).otherwise(nearest)
    edge = F.when(F.col("inside"), F.lit(-1)).otherwise((F.array_position("edges", nearest) - 1).cast("int"))
    return measured.select(*pairs.columns, distance.alias("distance"), "side", edge.alias("edge"))


def _spread_faces(faces: DataFrame, vertices: DataFrame, reach: float, cell: float) -> DataFrame:
    """Faces with their corners' coordinates in every cell within reach of their box."""
    p = m.with_points(faces, vertices)
    for c in "xyz":
        low, high = F.least(*[F.col(f"{c}{k}") for k in range(3)]) - reach, F.greatest(*[F.col(f"{c}{k}") for k in range(3)]) + reach
        p = p.withColumn(f"k{c}", F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))))
    return p


def closest_triangles(points: DataFrame, faces: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(pid, fid, distance, side, edge): the nearest triangle of each point (pid, px, py, pz) within reach; of equals the smallest face."""
    keyed = points.select("pid", "px", "py", "pz", *[F.floor(F.col(f"p{c}") / reach).cast("long").alias(f"k{c}") for c in "xyz"])
    met = to_triangles(keyed.join(_spread_faces(faces, vertices, reach, reach), ["kx", "ky", "kz"])).filter(F.col("distance") <= reach)
    best = met.groupBy("pid").agg(F.min_by(F.struct("fid", "distance", "side", "edge"), F.struct("distance", "fid")).alias("b"))
    return best.select("pid", "b.*")


def ray_hits(rays: DataFrame, faces: DataFrame, vertices: DataFrame, cell: float = 4.0) -> DataFrame:
    """(pid, fid, share): the first triangle that each ray (pid, px, py, pz, dx, dy, dz) hits between its start and its end p + d, at that share of its length."""
    keyed = rays
    for c in "xyz":
        ends = [F.col(f"p{c}"), F.col(f"p{c}") + F.col(f"d{c}")]
        keyed = keyed.withColumn(f"k{c}", F.explode(F.sequence(F.floor(F.least(*ends) / cell).cast("long"), F.floor(F.greatest(*ends) / cell).cast("long"))))
    p, d, t = vector("p"), vector("d"), [vector("", str(k)) for k in range(3)]
    u, w = minus(t[1], t[0]), minus(t[2], t[0])
    h = cross(d, w)
    det = F.nullif(dot(u, h), F.lit(0.0))
    s = minus(p, t[0])
    q = cross(s, u)
    a, b, at = dot(s, h) / det, dot(d, q) / det, dot(w, q) / det
    met = keyed.join(_spread_faces(faces, vertices, 0.0, cell), ["kx", "ky", "kz"]).select("pid", "fid", a.alias("a"), b.alias("b"), at.alias("share"))
    hit = met.filter("a >= 0 and b >= 0 and a + b <= 1 and share >= 0 and share <= 1")
    return hit.groupBy("pid").agg(F.min_by(F.struct("fid", "share"), F.struct("share", "fid")).alias("h")).select("pid", "h.*")


def voxelize(faces: DataFrame, vertices: DataFrame, length: float, ramp: float) -> DataFrame:
    """(vx, vy, vz, d, w): signed distances to the nearest triangle at the voxels within ``ramp``, in front of it above 0.

    Where the nearest point is on the mesh's boundary the sign is no evidence:
    w is 0 there, else 1.
    """
    p = m.with_points(faces, vertices)
    for c in "xyz":
        low, high = F.least(*[F.col(f"{c}{k}") for k in range(3)]) - ramp, F.greatest(*[F.col(f"{c}{k}") for k in range(3)]) + ramp
        p = p.withColumn(f"v{c}", F.explode(F.sequence(F.ceil(low / length).cast("int"), F.floor(high / length).cast("int"))))
    p = p.withColumns({f"p{c}": F.col(f"v{c}") * length for c in "xyz"})
    met = to_triangles(p).filter(F.col("distance") <= ramp)
    best = met.groupBy("vx", "vy", "vz").agg(F.min_by(F.struct("distance", "side", "edge", "v0", "v1", "v2"), F.struct("distance", "fid")).alias("b")).select("vx", "vy", "vz", "b.*")
    rim = m.boundary(faces).select("a", "b", F.lit(0.0).alias("w"))
    v = F.array("v0", "v1", "v2")
    ends = [F.get(v, F.col("edge")), F.get(v, (F.col("edge") + 1) % 3)]
    on_edge = best.withColumns({"a": F.when(F.col("edge") >= 0, F.least(*ends)), "b": F.when(F.col("edge") >= 0, F.greatest(*ends))})
    return on_edge.join(rim, ["a", "b"], "left").select("vx", "vy", "vz", (F.when(F.col("side") >= 0, F.col("distance")).otherwise(-F.col("distance"))).alias("d"), F.coalesce("w", F.lit(1.0)).alias("w"))


def quantized(voxels: DataFrame, ramp: float) -> DataFrame:
    """(vx, vy, vz, value, weight): distances and weights as 16-bit numbers; a distance of 0 is half of 65535."""
    value = F.round((0.5 - F.col("d") / (2 * ramp)) * 65535).cast("int")
    return voxels.select("vx", "vy", "vz", F.greatest(F.lit(0), F.least(F.lit(65535), value)).alias("value"), F.round(F.least(F.col("w"), F.lit(1.0)) * 65535).cast("int").alias("weight"))


def dequantized(cells: DataFrame, ramp: float) -> DataFrame:
    """(vx, vy, vz, d, w) from 16-bit values and weights; cells without weight go."""
    return cells.filter("weight > 0").select("vx", "vy", "vz", (-(F.col("value") / 65535.0 - 0.5) * 2 * ramp).alias("d"), (F.col("weight") / 65535.0).alias("w"))


def _nearest_others(points: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """(pid, oid, distance, p.., q..): each point's nearest other within reach."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    spread = points.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    for c in "xyz":
        spread = spread.withColumn(f"k{c}", F.explode(F.array(*[F.col(f"k{c}") + i for i in (-1, 0, 1)])))
    there = others.select(F.col("pid").alias("oid"), *[F.col(c).alias(f"q{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    met = spread.join(there, ["kx", "ky", "kz"]).withColumn("distance", norm(minus(vector("p"), vector("q")))).filter(F.col("distance") <= reach)
    kept = ["oid", "distance", *[f"{s}{c}" for s in "pq" for c in "xyz"]]
    return met.groupBy("pid").agg(F.min_by(F.struct(*kept), F.struct("distance", "oid")).alias("b")).select("pid", "b.*")


def correspondences(points: DataFrame, others: DataFrame, reach: float, reject: float = 2.5) -> DataFrame:
    """(pid, oid, distance, p.., q..): each point's nearest other within reach, but for those further than ``reject`` times the median distance."""
    best = _nearest_others(points, others, reach)
    return best.crossJoin(F.broadcast(best.agg(F.percentile("distance", 0.5).alias("median")))).filter(F.col("distance") <= reject * F.col("median")).drop("median")


def rigid_step(matches: DataFrame) -> np.ndarray:
    """The 3 x 4 rigid map that carries p onto q best: sixteen sums meet at the driver."""
    sums = matches.agg(F.count("*").alias("n"), *[F.sum(f"{s}{c}").alias(f"{s}{c}") for s in "pq" for c in "xyz"], *[F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"]).first()
    n = sums["n"]
    if n < 3:
        return np.eye(3, 4)
    p, q = (np.array([sums[f"{s}{c}"] for c in "xyz"]) / n for s in "pq")
    h = np.array([[sums[a + b] for b in "xyz"] for a in "xyz"]) / n - np.outer(p, q)
    u, _, vt = np.linalg.svd(h)
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return np.hstack([turn, (q - turn @ p)[:, None]])


def principal_map(points: DataFrame, others: DataFrame) -> np.ndarray | None:
    """The 4 x 4 rigid map of the points' centre and principal axes onto the others', of the least turn; None where there are too few points."""
    if points.limit(4).count() < 4 or others.limit(4).count() < 4:
        return None
    (p, _, a), (q, _, c) = principal_axes(points), principal_axes(others)
    if not (np.isfinite(a).all() and np.isfinite(c).all()):
        return None
    turns = [c.T @ np.diag([i, j, k]) @ a for i in (1, -1) for j in (1, -1) for k in (1, -1)]
    turn = max((m for m in turns if np.linalg.det(m) > 0), key=np.trace)
    return np.vstack([np.hstack([turn, (q - turn @ p)[:, None]]), [0, 0, 0, 1]])


def align(points: DataFrame, others: DataFrame, reach: float, rounds: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """(3 x 4 map, moved points): nearest pairs and the rigid map that fits them, in turn, until it stands still.

    It starts from where the points are, or from their principal axes laid on
    the others' where that brings more of them within reach, or as many and
    closer: a small turn moves the far end of a long set beyond any reach.
    """

    def fit(m):
        met = _nearest_others(moved(points, m[:3].ravel().tolist()), others, reach).agg(F.count("*").alias("n"), F.avg("distance").alias("d")).first()
        return met["n"], -(met["d"] or 0.0)

    starts = [m for m in (np.eye(4), principal_map(points, others)) if m is not None]
    whole = starts[0] if len(starts) == 1 else max(starts, key=fit)
    now = moved(points, whole[:3].ravel().tolist())
    for _ in range(rounds):
        step = np.vstack([rigid_step(correspondences(now, others, reach)), [0, 0, 0, 1]])
        whole = step @ whole
        now = moved(points, whole[:3].ravel().tolist())
        if np.abs(step - np.eye(4)).max() < tolerance:
            break
    return whole[:3], now


def principal_axes(vertices: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, variances, axes): principal axes of the vertices, the largest variance first; ten sums meet at the driver."""
    s = vertices.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a in "xyz" for b in "xyz" if a <= b]).first()
    centre = np.array([s[c] for c in "xyz"]) / s["n"]
    cov = np.array([[s[min(a, b) + max(a, b)] for b in "xyz"] for a in "xyz"]) / s["n"] - np.outer(centre, centre)
    values, axes = np.linalg.eigh(cov)
    return centre, values[::-1], axes[:, ::-1].T


def turned_to_axes(vertices: DataFrame) -> DataFrame:
    """Vertices on their own principal axes, the centre at the origin; each axis points to its larger extent."""
    centre, _, axes = principal_axes(vertices)
    matrix = np.hstack([axes, -(axes @ centre)[:, None]])
    out = moved(vertices, matrix.ravel().tolist())
    far = out.agg(*[(F.max(c) + F.min(c)).alias(c) for c in "xyz"]).first()
    return out.withColumns({c: F.col(c) * (-1.0 if far[c] < 0 else 1.0) for c in "xyz"})


def normalized_variance(vertices: DataFrame) -> DataFrame:
    """Vertices about their centre, scaled so that their mean squared distance from it is 1."""
    centre, values, _ = principal_axes(vertices)
    scale = 1 / np.sqrt(values.sum())
    return vertices.withColumns({c: (F.col(c) - float(k)) * float(scale) for c, k in zip("xyz", centre, strict=True)})


def box_mesh(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of boxes from their corners (obb_id, k, x, y, z): two triangles a side."""
    vertices = corners.select("obb_id", F.col("k").alias("vid"), "x", "y", "z")
    sides = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    triangles = [t for a, b, c, d in sides for t in ((a, b, c), (a, c, d))]
    made = F.posexplode(F.array(*[F.struct(*[F.lit(v).alias(f"v{k}") for k, v in enumerate(t)]) for t in triangles])).alias("fid", "t")
    return vertices, corners.select("obb_id").distinct().select("obb_id", made).select("obb_id", "fid", "t.v0", "t.v1", "t.v2")
