"""Operators on triangle meshes: faces (fid, v0, v1, v2) and vertices (vid, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import connected_components


def edges(faces: DataFrame) -> DataFrame:
    """(a, b, fid): the three undirected edges of each face, a < b."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return faces.select("fid", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select("e.a", "e.b", "fid")


def adjacency(faces: DataFrame) -> DataFrame:
    """(a, b): faces that share an edge, a < b.

    Of the faces on an edge each is paired with the first: enough to connect
    them all, and linear even where many meet.
    """
    e = edges(faces)
    first = e.groupBy("a", "b").agg(F.min("fid").alias("first"))
    return e.join(first, ["a", "b"]).filter("fid <> first").select(F.col("first").alias("a"), F.col("fid").alias("b")).distinct()


def face_components(faces: DataFrame) -> DataFrame:
    """(fid, component): faces connected over edges; component is the smallest face."""
    found = connected_components(adjacency(faces)).select(F.col("node").alias("fid"), "component")
    return faces.select("fid").join(found, "fid", "left").select("fid", F.coalesce("component", "fid").alias("component"))


def vertex_components(faces: DataFrame) -> DataFrame:
    """(vid, component): vertices connected over edges."""
    return connected_components(edges(faces).select("a", "b")).select(F.col("node").alias("vid"), "component")


def keep_components(faces: DataFrame, least: int) -> DataFrame:
    """Faces of components of ``least`` faces or more; below 0: of the largest size."""
    found = face_components(faces)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    good = sizes.filter(F.col("size") >= least) if least >= 0 else sizes.join(sizes.agg(F.max("size").alias("size")), "size")
    return faces.join(found.join(good.select("component"), "component", "left_semi").select("fid"), "fid", "left_semi")


def component_ranks(faces: DataFrame) -> DataFrame:
    """(component, size, rank): components of faces from the largest, which is 0, on; of equals the one with the smallest face first."""
    from pyspark.sql import Window as W

    sizes = face_components(faces).groupBy("component").agg(F.count("*").alias("size"))
    # components of one size are ranked among themselves, behind all larger ones
    larger = sizes.groupBy("size").agg(F.count("*").alias("n"))
    ahead = larger.withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("size", "ahead")
    own = sizes.withColumn("own", F.row_number().over(W.partitionBy("size").orderBy("component")) - 1)
    return own.join(ahead, "size").select("component", "size", (F.col("ahead") + F.col("own")).alias("rank"))


def boundary(faces: DataFrame) -> DataFrame:
    """(a, b): edges of one face only."""
    return edges(faces).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 1").select("a", "b")


def strip_boundary(faces: DataFrame, rounds: int) -> DataFrame:
    """The faces left after taking away those at a boundary vertex, ``rounds`` times."""
    for _ in range(rounds):
        edge = boundary(faces)
        rim = edge.select(F.col("a").alias("vid")).unionByName(edge.select(F.col("b").alias("vid"))).distinct()
        faces = without_vertices(faces, rim)
    return faces


def without_vertices(faces: DataFrame, gone: DataFrame) -> DataFrame:
    """Faces with none of the vertices (vid): one pass over the corners."""
    corners = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    bad = corners.join(gone.select("vid"), "vid", "left_semi").select("fid").distinct()
    return faces.join(bad, "fid", "left_anti")


def drop_slanted(faces: DataFrame, bad: DataFrame) -> DataFrame:
    """Without the bad faces (fid) and every face that shares a vertex with one."""
    touched = faces.join(bad.select("fid"), "fid", "left_semi").select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return without_vertices(faces, touched)


def with_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, v0, v1, v2, x0..z2): faces with their corners' coordinates, by one join over the corners."""
    corners = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).join(vertices.select("vid", "x", "y", "z"), "vid")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = corners.groupBy("fid").agg(*[at(k, "vid").alias(f"v{k}") for k in range(3)], *[at(k, c).alias(f"{c}{k}") for k in range(3) for c in "xyz"], F.count("*").alias("n"))
    return wide.filter("n = 3").drop("n")


def cross() -> tuple[Column, Column, Column]:
    """Twice the face's area vector, on the columns of ``with_points``."""
    u = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    w = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    return u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, v0, v1, v2, nx, ny, nz, area, cx, cy, cz): unit normal, area, centroid; faces without area go."""
    a, b, c = cross()
    p = with_points(faces, vertices).withColumns({"nx": a, "ny": b, "nz": c})
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    p = p.withColumn("size", size).filter("size > 0")
    mean = {f"c{k}": (F.col(f"{k}0") + F.col(f"{k}1") + F.col(f"{k}2")) / 3 for k in "xyz"}
    return p.withColumns({"area": F.col("size") / 2, **{f"n{k}": F.col(f"n{k}") / F.col("size") for k in "xyz"}, **mean}).select("fid", "v0", "v1", "v2", "nx", "ny", "nz", "area", "cx", "cy", "cz")


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): the unweighted sum of the unit normals around a vertex, to unit length."""
    f = face_geometry(faces, vertices)
    s = f.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return s.withColumn("size", size).filter("size > 0").select("vid", *[(F.col(f"n{k}") / F.col("size")).alias(f"n{k}") for k in "xyz"])


def centre_of_mass(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: area-weighted centre, and total area."""
    f = face_geometry(faces, vertices)
    return f.agg(F.sum("area").alias("area"), *[(F.sum(F.col("area") * F.col(f"c{k}")) / F.sum("area")).alias(f"c{k}") for k in "xyz"])


def second_moments(vertices: DataFrame) -> DataFrame:
    """One row: mean products of coordinates, not centred."""
    return vertices.agg(*[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def statistics(values: DataFrame, column: str) -> DataFrame:
    """One row of minimum, maximum, mean, mean size, root mean square, median, population deviation and total."""
    c = F.col(column)
    return values.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.avg(F.abs(c)).alias("mean_abs"), F.sqrt(F.avg(c * c)).alias("rms"), F.percentile(c, 0.5).alias("median"), F.stddev_pop(c).alias("stdev"), F.sum(c).alias("total"))


def valences(faces: DataFrame) -> DataFrame:
    """(vid, valence): distinct neighbours."""
    e = edges(faces).select("a", "b").distinct()
    return e.select(F.col("a").alias("vid")).unionByName(e.select(F.col("b").alias("vid"))).groupBy("vid").agg(F.count("*").alias("valence"))


def laplacian(faces: DataFrame, vertices: DataFrame, step: float = 0.5) -> DataFrame:
    """(vid, x, y, z): each vertex moved towards the mean of its neighbours; boundary vertices stay."""
    e = edges(faces).select("a", "b").distinct()
    both = e.select(F.col("a").alias("vid"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("vid"), F.col("a").alias("o")))
    mean = both.join(vertices.select(F.col("vid").alias("o"), "x", "y", "z"), "o").groupBy("vid").agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    rim = boundary(faces)
    rim = rim.select(F.col("a").alias("vid")).unionByName(rim.select(F.col("b").alias("vid"))).distinct().withColumn("rim", F.lit(True))
    m = vertices.join(mean, "vid", "left").join(rim, "vid", "left")
    free = F.col("rim").isNull() & F.col("mx").isNotNull()
    return m.select("vid", *[F.when(free, F.col(k) + step * (F.col(f"m{k}") - F.col(k))).otherwise(F.col(k)).alias(k) for k in "xyz"])


def taubin(faces: DataFrame, vertices: DataFrame, rounds: int = 1) -> DataFrame:
    """Smoothing without shrinking: steps of 0.330 and -0.331 in turn."""
    for _ in range(rounds):
        vertices = laplacian(faces, laplacian(faces, vertices, 0.330), -0.331)
    return vertices


def subdivide(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each face into four at its edges' midpoints; a midpoint is named by its edge."""
    e = edges(faces).select("a", "b").distinct()
    name = lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    va, vb = (vertices.select(F.col("vid").alias(s), *[F.col(k).alias(f"{s}{k}") for k in "xyz"]) for s in "ab")
    middle = e.join(va, "a").join(vb, "b").select(name(F.col("a"), F.col("b")).alias("vid"), *[((F.col(f"a{k}") + F.col(f"b{k}")) / 2).alias(k) for k in "xyz"])
    points = vertices.select(F.col("vid").cast("string").alias("vid"), "x", "y", "z").unionByName(middle)
    v = [F.col(f"v{k}") for k in range(3)]
    old, mid = [x.cast("string") for x in v], [name(v[k], v[(k + 1) % 3]) for k in range(3)]
    tri = lambda *t: F.struct(*[x.alias(f"v{k}") for k, x in enumerate(t)])
    made = F.posexplode(F.array(tri(old[0], mid[0], mid[2]), tri(mid[0], old[1], mid[1]), tri(mid[2], mid[1], old[2]), tri(*mid))).alias("k", "t")
    return faces.select("fid", made).select((F.col("fid") * 4 + F.col("k")).alias("fid"), "t.v0", "t.v1", "t.v2"), points


def flatten(faces: DataFrame, targets: DataFrame) -> DataFrame:
    """Faces on the welded vertices (vid, target), as ``meshtools.weld_radius`` gives them; those that lose a corner go."""
    corners = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).join(targets, "vid")
    wide = corners.groupBy("fid").agg(*[F.max(F.when(F.col("k") == k, F.col("target"))).alias(f"v{k}") for k in range(3)])
    return wide.filter("v0 <> v1 and v1 <> v2 and v2 <> v0")


def compact(faces: DataFrame) -> DataFrame:
    """(vid, new): the used vertices numbered from 0 in order, without one global sort.

    Vertices are cut into ranges of ids; ranges are counted, and a vertex's
    number is its range's offset and its rank within.
    """
    from pyspark.sql import Window as W

    size = 1 << 16
    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().withColumn("part", F.floor(F.col("vid") / size))
    counts = used.groupBy("part").agg(F.count("*").alias("n"))
    offset = counts.withColumn("offset", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = used.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("vid")) - 1)
    return ranked.join(offset, "part").select("vid", (F.col("offset") + F.col("rank")).alias("new"))
