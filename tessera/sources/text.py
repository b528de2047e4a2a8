"""Text formats: cameras, boxes, matrices and meshes, read and written with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, tokens): each file's white-space separated tokens."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("tokens"))


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(path, theta1, theta2, theta_n, phi1, phi2, phi_n, r1, r2, p1, p2, tr): six named values, then the matrices, row by row."""
    f = whole_files(spark, path)
    number = lambda i: F.col("tokens")[i].cast("double")
    part = lambda at, n: F.transform(F.slice("tokens", at + 1, n), lambda t: t.cast("double"))
    names = ("theta1", "theta2", "theta_n", "phi1", "phi2", "phi_n")
    at, matrices = 12, []
    for name, n in (("r1", 9), ("r2", 9), ("p1", 12), ("p2", 12), ("tr", 12)):
        matrices.append(part(at, n).alias(name))
        at += n
    return f.select("path", *[number(2 * i + 1).alias(n) for i, n in enumerate(names)], *matrices)


def matrix(spark: SparkSession, path: str, sparse: bool = True) -> DataFrame:
    """(row, col, val) of a text matrix with a "rows cols" header; sparse: zeros are left out."""
    f = whole_files(spark, path).select(F.col("tokens")[1].cast("int").alias("n"), F.posexplode(F.slice("tokens", 3, 1 << 30)).alias("k", "v"))
    out = f.select(F.floor(F.col("k") / F.col("n")).cast("int").alias("row"), (F.col("k") % F.col("n")).alias("col"), F.col("v").cast("double").alias("val"))
    return out.filter("val <> 0") if sparse else out


def annotated_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, category, m): repeated category, "3 4" and a 3 x 4 matrix; all of them are kept, whatever their order."""
    f = whole_files(spark, path)
    count = F.floor(F.size("tokens") / 15).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    one = F.posexplode(F.transform(starts, lambda i: F.struct(F.col("tokens")[i * 15].cast("int").alias("category"), F.transform(F.slice("tokens", i * 15 + 4, 12), lambda t: t.cast("double")).alias("m"))))
    return f.select("path", one.alias("ordinal", "b")).select("path", "ordinal", "b.category", "b.m")


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, vid, x, y, z), (path, fid, v0, v1, v2)) of OBJ files; vertices count from 0, polygons become fans."""
    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    tokens = lambda mark: f.select("path", F.posexplode(F.filter("lines", lambda s: s.startswith(mark))).alias("k", "line")).withColumn("t", F.split(F.trim("line"), r"\s+"))
    vertices = tokens("v ").select("path", F.col("k").alias("vid"), *[F.col("t")[i].cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    corner = lambda t: F.split(t, "/")[0].cast("int") - 1
    polygons = tokens("f ").select("path", "k", F.transform(F.slice("t", 2, 1 << 30), corner).alias("c"))
    fans = polygons.select("path", "k", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("i"))
    return vertices, fans.select("path", (F.col("k") * 64 + F.col("i")).alias("fid"), F.col("c")[0].alias("v0"), F.col("c")[F.col("i")].alias("v1"), F.col("c")[F.col("i") + 1].alias("v2"))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh as OBJ text: vertices 0..n-1 in order, then faces."""
    number = lambda c: F.col(c).cast("string")
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").cast("long").alias("at"), F.concat_ws(" ", F.lit("v"), number("x"), number("y"), number("z")).alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")]).alias("value"))
    v.unionByName(f).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.text(path)


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes as text: id, category, score and the twelve numbers of the map (obb_id, category, score, m)."""
    line = F.concat_ws(" ", F.col("obb_id").cast("string"), F.col("category").cast("string"), F.col("score").cast("string"), F.array_join(F.transform("m", lambda x: x.cast("string")), " "))
    boxes.select(line.alias("value")).write.text(path)


def tagged_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, offset, orientation, sides, voxel_lengths, model, train): boxes of named fields; a box without "train:" is one for training."""
    number = r"([-+0-9.eE]+)"
    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"(?=offset:)")).alias("k", "block")).filter("k > 0")
    numbers = lambda name, n: F.transform(F.slice(F.split(F.trim(F.regexp_extract("block", name + r":\s*((?:" + number + r"\s*){" + str(n) + "})", 1)), r"\s+"), 1, n), lambda t: t.cast("double"))
    train = F.regexp_extract("block", r"train:\s*(\d)", 1)
    return f.select("path", (F.col("k") - 1).alias("ordinal"), numbers("offset", 3).alias("offset"), numbers("orientation", 9).alias("orientation"), numbers("side_lengths", 3).alias("sides"), numbers("voxel_length", 3).alias("voxel_lengths"), F.regexp_extract("block", r"model:\s*(-?\d+)", 1).cast("int").alias("model"), (train != "0").alias("train"))


def _one_file(lines: DataFrame, path: str) -> None:
    """Lines (part, at, value) as one text file in order: one task writes it, from sorted rows that spill."""
    lines.repartition(1).sortWithinPartitions("part", "at").select("value").write.text(path)


def write_tagged_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes (ordinal, offset, orientation, sides, voxel_lengths, model, train) in the format that ``tagged_boxes`` reads."""
    n = boxes.count()
    head = boxes.sparkSession.createDataFrame([(0, 0, str(n))], "part int, at long, value string")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    fields = [F.col("ordinal").cast("string")]
    fields += [F.concat(F.lit(f"{name}: "), join(c)) for name, c in (("offset", "offset"), ("orientation", "orientation"), ("side_lengths", "sides"), ("voxel_length", "voxel_lengths"))]
    fields += [F.concat(F.lit("model: "), F.col("model").cast("string")), F.concat(F.lit("train: "), F.col("train").cast("int").cast("string")), F.lit("")]
    _one_file(head.unionByName(boxes.select(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("at"), F.concat_ws("\n", *fields).alias("value"))), path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, category, obb_id, score, m): a count, then for each sample its number, category, box number, score, "3 4" and a 3 x 4 matrix."""
    f = whole_files(spark, path)
    one = F.transform(F.sequence(F.lit(0), F.col("tokens")[0].cast("int") - 1), lambda i: F.slice("tokens", i * 18 + 2, 18))
    rows = f.filter(F.col("tokens")[0].cast("int") > 0).select("path", F.explode(one).alias("t"))
    return rows.select("path", F.col("t")[0].cast("int").alias("ordinal"), F.col("t")[1].cast("int").alias("category"), F.col("t")[2].cast("long").alias("obb_id"), F.col("t")[3].cast("double").alias("score"), F.transform(F.slice("t", 7, 12), lambda x: x.cast("double")).alias("m"))


def write_samples(boxes: DataFrame, path: str) -> None:
    """Samples (ordinal, category, obb_id, score, m) in the format that ``samples`` reads."""
    n = boxes.count()
    head = boxes.sparkSession.createDataFrame([(0, 0, str(n))], "part int, at long, value string")
    value = F.concat_ws("\n", *[F.col(c).cast("string") for c in ("ordinal", "category", "obb_id", "score")], F.lit("3 4"), F.array_join(F.transform("m", lambda x: x.cast("string")), " "))
    _one_file(head.unionByName(boxes.select(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("at"), value.alias("value"))), path)


def write_matrix(entries: DataFrame, rows: int, columns: int, path: str) -> None:
    """A matrix (row, col, val) as text with a "rows cols" header, zeros written out: a row of it is one group."""
    spark = entries.sparkSession
    head = spark.createDataFrame([(0, 0, f"{rows} {columns}")], "part int, at long, value string")
    given = entries.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("held"))
    whole = spark.range(rows).select(F.col("id").cast("int").alias("row")).join(given, "row", "left")
    cell = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0.0)).cast("string"))
    _one_file(head.unionByName(whole.select(F.lit(1).alias("part"), F.col("row").cast("long").alias("at"), F.array_join(cell, " ").alias("value"))), path)


def write_features(features: DataFrame, size: int, path: str) -> None:
    """A line for each sample: its number and its ``size`` dense features."""
    dense = features.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("held"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0.0)).cast("string"))
    dense.select(F.concat_ws(" ", F.col("sample").cast("string"), F.array_join(cell, " ")).alias("value")).write.text(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """(sample, feature, x) of ``write_features``'s lines; zeros are left out."""
    t = spark.read.text(path).select(F.split("value", " ").alias("t"))
    return t.select(F.col("t")[0].cast("long").alias("sample"), F.posexplode(F.slice("t", 2, 1 << 30)).alias("feature", "x")).withColumn("x", F.col("x").cast("double")).filter("x <> 0")


def write_assignment(assignment: DataFrame, scales: DataFrame, path: str) -> None:
    """Samples (sample, cluster, gamma, error), a line each, then the clusters' mean sides (cluster, lx, ly, lz)."""
    one = assignment.select(F.lit(0).alias("part"), F.col("sample").cast("long").alias("at"), F.format_string("%8d \t%8d \tgamma: %10.7f\tassign_error: %10.7f", "sample", "cluster", "gamma", "error").alias("value"))
    two = scales.select(F.lit(1).alias("part"), F.col("cluster").cast("long").alias("at"), F.format_string("%dth model, scale-x-y-z: %f %f %f", "cluster", "lx", "ly", "lz").alias("value"))
    _one_file(one.unionByName(two), path)


def assignment(spark: SparkSession, path: str) -> DataFrame:
    """(sample, cluster, gamma, error) of ``write_assignment``'s lines."""
    line = spark.read.text(path).filter(F.col("value").contains("gamma:"))
    at = lambda k: F.regexp_extract("value", r"(\d+)\s+(\d+)\s+gamma:\s*(\S+)\s+assign_error:\s*(\S+)", k)
    return line.select(at(1).cast("long").alias("sample"), at(2).cast("int").alias("cluster"), at(3).cast("double").alias("gamma"), at(4).cast("double").alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, path): the lines "m <mesh>" and "e <edges>" of a list of things to show."""
    line = spark.read.text(path).filter(F.col("value").rlike("^[me] "))
    return line.select(F.substring("value", 1, 1).alias("kind"), F.trim(F.expr("substring(value, 3)")).alias("path"))


def write_manifest(things: DataFrame, path: str) -> None:
    """(at, kind, path) rows as such a list."""
    _one_file(things.select(F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), F.concat_ws(" ", "kind", "path").alias("value")), path)


def vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): the numbers of files of numbers, in order."""
    f = whole_files(spark, path)
    return f.select("path", F.posexplode("tokens").alias("at", "t")).select("path", "at", F.col("t").cast("double").alias("value"))


def label_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, ordinal, label, x, y, w, h): labelled rectangles of files "<key> <image>", then "object: n", "<housenumber>: label" and "bbox: x,y,w,h" again and again."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^\s*\S+\s+(\S+)", 1).alias("image"), F.posexplode(F.split("value", r"(?=object:)")).alias("ordinal", "block")).filter("ordinal > 0")
    at = lambda k: F.regexp_extract("block", r"<housenumber>:\s*(\d+)\s+bbox:\s*(-?\d+),(-?\d+),(\d+),(\d+)", k).cast("int")
    return f.select("image", "ordinal", *[at(k).alias(c) for k, c in enumerate(("label", "x", "y", "w", "h"), 1)])


def paint_labels(boxes: DataFrame) -> DataFrame:
    """(image, y, x, label): the pixels of labelled rectangles; a later one is painted over an earlier one."""
    pixels = boxes.withColumn("py", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1))).withColumn("px", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)))
    return pixels.groupBy("image", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max_by("label", "ordinal").alias("label"))


def write_slice(plane: DataFrame, width: int, height: int, path: str, low: float = -1.0, high: float = 1.2) -> None:
    """A slice (a, b, d, w) as a grey PGM text image, a line for each b; unobserved cells are 0, others 1 to 255."""
    grey = F.greatest(F.lit(1), F.least(F.lit(255), F.round((F.col("d") - low) / (high - low) * 254).cast("int") + 1))
    spark = plane.sparkSession
    rows = plane.filter((F.col("w") > 0) & F.col("a").between(0, width - 1)).groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("a", grey.alias("v")))).alias("held"))
    whole = spark.range(height).select(F.col("id").cast("int").alias("b")).join(rows, "b", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.coalesce(F.try_element_at("held", a), F.lit(0)).cast("string")), " ")
    head = spark.createDataFrame([(0, 0, f"P2 {width} {height} 255")], "part int, at long, value string")
    _one_file(head.unionByName(whole.select(F.lit(1).alias("part"), F.col("b").cast("long").alias("at"), line.alias("value"))), path)


def read_slice(spark: SparkSession, path: str) -> DataFrame:
    """(b, a, grey) of such images, cells of 0 left out."""
    f = whole_files(spark, path).select(F.col("tokens")[1].cast("int").alias("width"), F.posexplode(F.slice("tokens", 5, 1 << 30)).alias("k", "t"))
    return f.select(F.floor(F.col("k") / F.col("width")).cast("int").alias("b"), (F.col("k") % F.col("width")).alias("a"), F.col("t").cast("int").alias("grey")).filter("grey > 0")


def write_coloured_points(voxels: DataFrame, path: str, low: float = -1.0, high: float = 1.2) -> None:
    """Observed voxels as lines "x y z r g b d w", coloured by distance."""
    from tessera.functions.geometry import jet

    colours = jet((F.col("d") - low) / (high - low))
    voxels.filter("w > 0").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("vx", "vy", "vz")], *[c.cast("string") for c in colours], F.col("d").cast("string"), F.col("w").cast("string")).alias("value")).write.text(path)


def coloured_points(spark: SparkSession, path: str) -> DataFrame:
    """(vx, vy, vz, r, g, b, d, w) of such lines."""
    t = spark.read.text(path).select(F.split("value", " ").alias("t"))
    return t.select(*[F.col("t")[k].cast("int").alias(c) for k, c in enumerate(("vx", "vy", "vz", "r", "g", "b"))], F.col("t")[6].cast("double").alias("d"), F.col("t")[7].cast("double").alias("w"))
