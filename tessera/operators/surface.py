"""Surface extraction: the zero level of a volume as triangles.

Each cell with eight observed corners is cut into six tetrahedra around its
main diagonal, one for each order of the axes.  A tetrahedron's crossing
follows from its corners' signs alone, so no case table is needed, and
neighbouring cells cut their common face alike: the surface has no gaps.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.volume import KEY, _corners
from tessera.plans.components import settle


def _tetrahedra() -> list[list[int]]:
    """Corner numbers (4 x + 2 y + z) of the six tetrahedra: from corner 0 along the axes in each order."""
    out = []
    for order in permutations((4, 2, 1)):
        corner, path = 0, [0]
        for step in order:
            corner += step
            path.append(corner)
        out.append(path)
    return out


def cells(voxels: DataFrame, least_weight: float = 0.0) -> DataFrame:
    """(vx, vy, vz, d): cells by their lowest voxel, d the eight corners' distances in order; cells with an unobserved corner are left out."""
    offsets = [F.struct(*[(F.col(c) - o).alias(c) for c, o in zip(KEY, off, strict=True)], F.lit(4 * off[0] + 2 * off[1] + off[2]).alias("k")) for off in product((0, 1), repeat=3)]
    corners = voxels.filter(F.col("w") > least_weight).select("d", F.explode(F.array(*offsets)).alias("o")).select(*[F.col(f"o.{c}").alias(c) for c in KEY], "o.k", "d")
    grouped = corners.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("d"))).alias(f"d{k}") for k in range(8)])
    return grouped.filter("n = 8").select(*KEY, F.array(*[f"d{k}" for k in range(8)]).alias("d"))


def extract(voxels: DataFrame, least_weight: float = 0.0, iso: float = 0.0) -> DataFrame:
    """(vx, vy, vz, tet, t, x0..z2): triangles in voxel coordinates, turned so that their normals point to larger distances."""
    c = cells(voxels, least_weight)
    # cells that the level doesn't pass are dropped before anything is made of them
    c = c.filter((F.array_min("d") < iso) & (F.array_max("d") >= iso))
    corner = lambda k: F.struct((F.col("d")[k] - iso).alias("d"), *[(F.col(v) + F.lit(k >> s & 1)).cast("double").alias(x) for v, s, x in zip(KEY, (2, 1, 0), "xyz", strict=True)])
    tets = F.posexplode(F.array(*[F.array(*[corner(k) for k in t]) for t in _tetrahedra()])).alias("tet", "c")
    each = c.select(*KEY, tets)
    each = each.withColumns({"lo": F.filter("c", lambda p: p["d"] < 0), "hi": F.filter("c", lambda p: p["d"] >= 0)}).filter("size(lo) > 0 and size(hi) > 0")

    def meet(a, b):
        share = a["d"] / (a["d"] - b["d"])
        return F.struct(*[(a[x] + (b[x] - a[x]) * share).alias(x) for x in "xyz"])

    lo, hi = (lambda i: F.col("lo")[i]), (lambda i: F.col("hi")[i])
    tri = lambda *p: F.array(*p)
    quad = [meet(lo(0), hi(0)), meet(lo(0), hi(1)), meet(lo(1), hi(1)), meet(lo(1), hi(0))]
    made = (
        F.when(F.size("lo") == 1, F.array(tri(meet(lo(0), hi(0)), meet(lo(0), hi(1)), meet(lo(0), hi(2)))))
        .when(F.size("lo") == 3, F.array(tri(meet(lo(0), hi(0)), meet(lo(1), hi(0)), meet(lo(2), hi(0)))))
        .otherwise(F.array(tri(quad[0], quad[1], quad[2]), tri(quad[0], quad[2], quad[3])))
    )
    out = each.select(*KEY, "tet", "lo", "hi", F.posexplode(made).alias("t", "p"))
    p = lambda i, x: F.col("p")[i][x]
    u, w = {x: p(1, x) - p(0, x) for x in "xyz"}, {x: p(2, x) - p(0, x) for x in "xyz"}
    normal = {"x": u["y"] * w["z"] - u["z"] * w["y"], "y": u["z"] * w["x"] - u["x"] * w["z"], "z": u["x"] * w["y"] - u["y"] * w["x"]}
    mean = lambda side, x: F.aggregate(side, F.lit(0.0), lambda a, q: a + q[x]) / F.size(side)
    faces_out = sum((normal[x] * (mean("hi", x) - mean("lo", x)) for x in "xyz"), F.lit(0.0)) >= 0
    second, third = F.when(faces_out, F.col("p")[1]).otherwise(F.col("p")[2]), F.when(faces_out, F.col("p")[2]).otherwise(F.col("p")[1])
    turned = out.select(*KEY, "tet", "t", F.col("p")[0].alias("a"), second.alias("b"), third.alias("c"))
    return turned.select(*KEY, "tet", "t", *[F.col(f"{s}.{x}").alias(f"{x}{k}") for k, s in enumerate("abc") for x in "xyz"])


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((fid, v0, v1, v2), (vid, x, y, z)): the triangles on shared vertices.

    Neighbouring cells compute a common corner from the same two voxels, so
    equal corners are equal to the last bit; a vertex is named by their hash.
    Triangles that lose a corner go.
    """
    name = lambda k: F.xxhash64(*[F.col(f"{c}{k}") + F.lit(0.0) for c in "xyz"])
    faces = triangles.select(F.xxhash64(*KEY, "tet", "t").alias("fid"), *[name(k).alias(f"v{k}") for k in range(3)]).filter("v0 <> v1 and v1 <> v2 and v2 <> v0")
    corners = triangles.select(F.explode(F.array(*[F.struct(name(k).alias("vid"), *[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(3)])).alias("p"))
    return faces, corners.groupBy("p.vid").agg(*[F.first(f"p.{c}").alias(c) for c in "xyz"])


def coloured(vertices: DataFrame, colours: DataFrame) -> DataFrame:
    """(vid, x, y, z, r, g, b): vertices with the colours (vx, vy, vz, r, g, b) around them, mixed by nearness and cut to whole numbers; black where there are none."""
    met = _corners(vertices.select("vid", *[F.col(c).alias(f"p{c}") for c in "xyz"]), "vid").join(colours.select(*KEY, "r", "g", "b"), KEY)
    mixed = met.filter("share > 0").groupBy("vid").agg(*[F.floor(F.sum(F.col("share") * F.col(c)) / F.sum("share") + 1e-9).cast("int").alias(c) for c in "rgb"])
    return vertices.join(mixed, "vid", "left").select("vid", "x", "y", "z", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


def clean_volume(voxels: DataFrame, least: int, low: int = -1, high: int = 2) -> DataFrame:
    """The volume without what lies near small parts of its surface.

    The surface's parts of fewer than ``least`` faces (below 0: all but the
    largest) go, and the voxels within [low, high) steps of their vertices.
    """
    from tessera.operators import mesh, volume

    faces, vertices = indexed(extract(voxels))
    faces, vertices = settle(faces, "surface-faces"), settle(vertices, "surface-vertices")
    kept = mesh.keep_components(faces, least)
    gone = faces.join(kept.select("fid"), "fid", "left_anti").select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    near = vertices.join(gone, "vid", "left_semi").select(*[F.col(c).alias(f"p{c}") for c in "xyz"])
    return volume.clear_near(voxels, near, low, high)
