"""Queries that write a format into the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.geometry import r
from tessera.operators import boxes as b
from tessera.operators import learn as n
from tessera.operators import mesh as m
from tessera.operators import meshtools as mt
from tessera.operators import volume as v
from tessera.plans import inputs as i
from tessera.plans.components import shared_folder
from tessera.plans.learn_queries import _ERRORS
from tessera.plans.registry import query
from tessera.sources import grid, listing, ply, png, text


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_ORDERED = f"{i.FACES}, {i.VERTICES}, num AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS k FROM verts)"


def _numbered(spark, sf):
    """The mesh with vertices from 0 on without gaps."""
    f, p = i.faces(spark, sf), i.vertices(spark, sf)
    new = m.compact(f)
    points = p.join(new, "vid").select(F.col("new").alias("vid"), "x", "y", "z", (F.col("new") % 256).cast("int").alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b"))
    return m.flatten(f, new.withColumnRenamed("new", "target")), points


@query("ply_vertices", f"WITH {_ORDERED} SELECT k AS vid, x, y, round(z, 9) AS z, CAST(k % 256 AS INTEGER) AS r, 7 AS g FROM verts JOIN num USING (vid)")
def ply_vertices(spark, sf):
    f, p = _numbered(spark, sf)
    ply.write(p, f, path := _place(spark, "ply"))
    return ply.read(spark, path)[0].select("vid", "x", "y", r("z", 9).alias("z"), "r", "g")


@query("ply_faces", f"WITH {_ORDERED} SELECT a.k AS v0, b.k AS v1, c.k AS v2 FROM faces JOIN num a ON a.vid = v0 JOIN num b ON b.vid = v1 JOIN num c ON c.vid = v2")
def ply_faces(spark, sf):
    f, p = _numbered(spark, sf)
    ply.write(p, f, path := _place(spark, "ply"))
    return ply.read(spark, path)[1].select("v0", "v1", "v2")


@query("obj_vertices", f"WITH {_ORDERED} SELECT count(*) AS n, round(sum(x), 4) AS x, round(sum(z), 4) AS z FROM verts")
def obj_vertices(spark, sf):
    f, p = _numbered(spark, sf)
    text.write_obj(p, f, path := _place(spark, "obj"))
    return text.obj_mesh(spark, path)[0].agg(F.count("*").alias("n"), r(F.sum("x"), 4).alias("x"), r(F.sum("z"), 4).alias("z"))


def _tagged(spark, sf):
    unit = lambda *x: F.array(*[F.lit(float(k)) for k in x])
    c, s = F.cos("theta"), F.sin("theta")
    zero, one = F.lit(0.0), F.lit(1.0)
    return i.boxes(spark, sf).select(F.col("obb_id").alias("ordinal"), F.array("cx", "cy", "bz").alias("offset"), F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("orientation"), F.array("lx", "ly", "lz").alias("sides"), unit(0.2, 0.2, 0.2).alias("voxel_lengths"), F.col("category").alias("model"), (F.col("category") > 0).alias("train"))


@query("tagged_boxes", f"WITH {i.BOXES} SELECT round(cx, 7) AS x, round(cy, 7) AS y, round(cos(theta), 7) + 0.0::DOUBLE AS c, round(-sin(theta), 7) + 0.0::DOUBLE AS s, lx, lz, category AS model, category > 0 AS train FROM boxes")
def tagged_boxes(spark, sf):
    text.write_tagged_boxes(_tagged(spark, sf), path := _place(spark, "tagged-boxes"))
    t = text.tagged_boxes(spark, path)
    at = lambda c, k: F.col(c)[k]
    return t.select(r(at("offset", 0), 7).alias("x"), r(at("offset", 1), 7).alias("y"), r(at("orientation", 0), 7).alias("c"), r(at("orientation", 1), 7).alias("s"), at("sides", 0).alias("lx"), at("sides", 2).alias("lz"), "model", "train")


@query("sample_collection", f"WITH {i.BOXES} SELECT obb_id, category, round(score, 7) AS score, round(cx, 7) AS cx, round(lz, 7) AS lz FROM boxes")
def sample_collection(spark, sf):
    box = i.boxes(spark, sf)
    rows = box.join(b.affine(box), "obb_id").withColumn("ordinal", F.col("obb_id") - 1)
    text.write_samples(rows, path := _place(spark, "samples"))
    return text.samples(spark, path).select("obb_id", "category", r("score", 7).alias("score"), r(F.col("m")[3], 7).alias("cx"), r(F.col("m")[10], 7).alias("lz"))


@query("matrix_text", f"WITH {i.CELLS} SELECT CAST(dense_rank() OVER (ORDER BY sample) - 1 AS INTEGER) AS row, idx AS col, round(val * w, 7) AS val FROM cells QUALIFY val * w <> 0")
def matrix_text(spark, sf):
    c = i.cells(spark, sf)
    # samples are numbered without gaps from their smallest on
    low, rows = c.agg(F.min("sample"), F.countDistinct("sample")).first()
    entries = c.select((F.col("sample") - low).cast("int").alias("row"), F.col("idx").alias("col"), (F.col("val") * F.col("w")).alias("val"))
    text.write_matrix(entries, rows, 64, path := _place(spark, "matrix"))
    return text.matrix(spark, path).withColumn("val", r("val", 7))


@query("feature_text", f"WITH {i.CELLS} SELECT sample, count(*) FILTER (val <> 0) + count(*) AS n, round(sum(val) + count(*), 6) AS total FROM cells WHERE w > 0 GROUP BY sample")
def feature_text(spark, sf):
    text.write_features(n.feature_rows(i.cells(spark, sf)), 128, path := _place(spark, "features"))
    return text.features(spark, path).groupBy("sample").agg(F.count("*").alias("n"), r(F.sum("x")).alias("total"))


@query("assignment_text", f"WITH {_ERRORS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY error, cluster) AS k FROM errors) SELECT sample, cluster, round(round(error, 7), 5) AS error FROM k WHERE k = 1")
def assignment_text(spark, sf):
    c = i.cells(spark, sf)
    a = n.assign_clusters(n.cluster_errors(c, n.cell_mean(c)))
    scales = i.boxes(spark, sf).groupBy(F.col("category").alias("cluster")).agg(*[F.avg(k).alias(k) for k in ("lx", "ly", "lz")])
    text.write_assignment(a, scales, path := _place(spark, "assignment"))
    return text.assignment(spark, path).select("sample", "cluster", r("error", 5).alias("error"))


@query("manifest_text", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE 'e' END AS kind, 'box_' || s_suppkey || '.ply' AS path FROM supplier")
def manifest_text(spark, sf):
    k = F.col("s_suppkey")
    things = i.read(spark, sf, "supplier").select(k.alias("at"), F.when(k % 2 == 0, F.lit("m")).otherwise(F.lit("e")).alias("kind"), F.concat(F.lit("box_"), k.cast("string"), F.lit(".ply")).alias("path"))
    text.write_manifest(things, path := _place(spark, "manifest"))
    return text.manifest(spark, path)


@query("label_raster", """WITH b AS (SELECT 'im' || s_nationkey AS image, s_suppkey AS ordinal, CAST(s_suppkey % 9 + 1 AS INTEGER) AS label, CAST(s_suppkey * 7 % 40 AS INTEGER) AS x, CAST(s_suppkey * 3 % 30 AS INTEGER) AS y, CAST(s_suppkey % 6 + 1 AS INTEGER) AS w, CAST(s_suppkey % 4 + 1 AS INTEGER) AS h FROM supplier),
    p AS (SELECT image, ordinal, label, CAST(unnest(range(y, y + h)) AS INTEGER) AS py, x, w FROM b), q AS (SELECT image, ordinal, label, py, CAST(unnest(range(x, x + w)) AS INTEGER) AS px FROM p) SELECT image, py AS y, px AS x, arg_max(label, ordinal) AS label FROM q GROUP BY image, py, px""")
def label_raster(spark, sf):
    k = F.col("s_suppkey")
    s = i.read(spark, sf, "supplier").select(F.concat(F.lit("im"), F.col("s_nationkey").cast("string")).alias("image"), "s_suppkey", F.format_string("object: %d\n<housenumber>: %d\nbbox: %d,%d,%d,%d\n\n", k, k % 9 + 1, k * 7 % 40, k * 3 % 30, k % 6 + 1, k % 4 + 1).alias("block"))
    # one file of text for each image
    files = s.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "block"))), lambda x: x["block"]), "").alias("blocks"))
    files.select(F.concat(F.lit("file "), "image", F.lit("\n"), "blocks").alias("value"), "image").write.partitionBy("image").text(path := _place(spark, "labels"))
    return text.paint_labels(text.label_boxes(spark, f"{path}/*/*.txt"))


@query("slice_image", f"WITH {i.VOX} SELECT vy AS b, vx AS a, CAST(greatest(1, least(255, CAST(round((d + 1.0) / 2.2 * 254) AS INTEGER) + 1)) AS INTEGER) AS grey FROM vox WHERE vz = 12")
def slice_image(spark, sf):
    text.write_slice(v.plane(i.voxels(spark, sf), "z", 12), 32, 32, path := _place(spark, "slice"))
    return text.read_slice(spark, path)


@query("coloured_points", f"WITH {i.VOX}, t AS (SELECT *, (d + 1.0) / 2.2 AS h FROM vox) SELECT vx, vy, vz, CAST(floor(255 * greatest(0, least(1, 1.5 - abs(4 * h - 3)))) AS INTEGER) AS r, round(d, 9) + 0.0::DOUBLE AS d FROM t")
def coloured_points(spark, sf):
    text.write_coloured_points(i.voxels(spark, sf), path := _place(spark, "points"))
    return text.coloured_points(spark, path).select("vx", "vy", "vz", "r", r("d", 9).alias("d"))


def _grids(spark, sf):
    """Each frame's quantised depths as a grid file: a scanline for each row of the image."""
    px = i.pixels(spark, sf).select("frame", "y", "x", F.floor("depth").cast("int").alias("value"))
    whole = spark.range(6 * 64 * 64).select((F.floor(F.col("id") / 4096) % 6).cast("int").alias("frame"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"))
    line = whole.join(px, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("value", F.lit(0)).alias("value"), F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.lit(65535)).alias("weight"))
    from pyspark.sql import Window as W

    w = W.partitionBy("frame", "y").orderBy("x")
    marked = line.withColumn("varying", F.col("weight") > 0).withColumn("opens", (F.coalesce(F.lag("varying").over(w), ~F.col("varying")) != F.col("varying")).cast("int"))
    runs = marked.withColumn("run", F.sum("opens").over(w)).groupBy("frame", "y", "run", "varying").agg(F.count("*").cast("int").alias("length"), F.sort_array(F.collect_list(F.struct("x", "value", "weight"))).alias("items"))
    items = F.transform(F.when(F.col("varying"), F.col("items")).otherwise(F.slice("items", 1, 1)), lambda e: F.struct(e["value"].alias("value"), e["weight"].alias("weight")))
    runs = runs.select("frame", F.struct("y", "run", F.lit(0).alias("z"), "length", "varying", items.alias("items")).alias("q")).groupBy("frame").agg(F.array_sort(F.collect_list("q")).alias("runs"))
    return runs.select(F.format_string("%d.vri", "frame").alias("name"), F.array(F.lit(64), F.lit(64), F.lit(1)).alias("size"), "runs", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("origin"), F.lit(0.5).alias("resolution"))


def _read_grids(spark, sf):
    grid.write(_grids(spark, sf), path := _place(spark, "grids"))
    return grid.read_runs(spark, path).withColumn("frame", F.regexp_extract("path", r"(\d+)\.vri", 1).cast("int"))


@query("grid_file_volume", f"WITH {i.PIXELS} SELECT frame, x AS vx, y AS vy, 0 AS vz, round(-(CAST(floor(depth) AS INTEGER) / 65535.0 - 0.5) * 6, 8) AS d, 1.0::DOUBLE AS w FROM pixels")
def grid_file_volume(spark, sf):
    c = grid.cells(_read_grids(spark, sf)).select(F.regexp_extract("path", r"(\d+)\.vri", 1).cast("int").alias("frame"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), "value", "weight")
    out = c.filter("weight > 0")
    return out.select("frame", "vx", "vy", "vz", r(-(F.col("value") / 65535.0 - 0.5) * 6, 8).alias("d"), (F.col("weight") / 65535.0).alias("w"))


@query("grid_file_statistics", f"""WITH {i.PIXELS}, full_ AS (SELECT f AS frame, yy AS y, xx AS x, EXISTS (SELECT 1 FROM pixels p WHERE p.frame = f AND p.y = yy AND p.x = xx) AS varying FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS f), (SELECT CAST(unnest(range(64)) AS INTEGER) AS yy), (SELECT CAST(unnest(range(64)) AS INTEGER) AS xx)),
    o AS (SELECT *, lag(varying) OVER (PARTITION BY frame, y ORDER BY x) IS DISTINCT FROM varying AS opens FROM full_) SELECT frame, count(*) FILTER (opens) AS runs, count(*) FILTER (opens AND varying) AS varying, count(*) FILTER (varying) AS cells FROM o GROUP BY frame""")
def grid_file_statistics(spark, sf):
    s = grid.statistics(_read_grids(spark, sf))
    return s.select(F.regexp_extract("path", r"(\d+)\.vri", 1).cast("int").alias("frame"), "runs", "varying", "cells")


@query("side_partners", "WITH p AS (SELECT CAST(o_orderkey AS INTEGER) AS frame, CAST(o_orderkey + o_custkey % 41 - 20 AS INTEGER) AS partner FROM orders), n AS (SELECT frame, partner, row_number() OVER (PARTITION BY frame, partner > frame ORDER BY abs(partner - frame)) AS k FROM p WHERE abs(partner - frame) BETWEEN 1 AND 19) SELECT frame, partner FROM n WHERE k = 1")
def side_partners(spark, sf):
    p = i.read(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("frame"), (F.col("o_orderkey") + F.col("o_custkey") % 41 - 20).cast("int").alias("partner"))
    return listing.side_partners(p.select("frame").distinct(), p)


@query("file_names", "SELECT p_partkey, regexp_replace(p_name, '\\.[^./]*$', '') || '.png' AS renamed, starts_with(lower(p_name), 'part') AS begins, ends_with(lower(p_name), '7') AS ends FROM part")
def file_names(spark, sf):
    name = F.col("p_name")
    return i.read(spark, sf, "part").select("p_partkey", listing.replace_extension(name, "png").alias("renamed"), listing.begins_with(name, "PART").alias("begins"), listing.ends_with(name, "7").alias("ends"))


@query("sampled_volumes_written", f"WITH {i.CELLS} SELECT sample, count(*) AS n, round(sum(val), 6) + 0.0::DOUBLE AS total FROM cells WHERE w >= 1 GROUP BY sample")
def sampled_volumes_written(spark, sf):
    """A feature matrix's volumes, written apart by sample group and read again."""
    out = v.to_columns(i.cells(spark, sf), 4, 4, 1.0).withColumn("part", F.col("sample") % 8)
    out.write.partitionBy("part").parquet(path := _place(spark, "volumes"))
    return spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"), r(F.sum("d")).alias("total"))


@query("quantized_grid_cells", f"WITH {i.VOX} SELECT vx, vy, vz, CAST(round((0.5 - d / 2.4) * 65535) AS INTEGER) AS value, CAST(round(least(w, 1.0) * 65535) AS INTEGER) AS weight FROM vox")
def quantized_grid_cells(spark, sf):
    return mt.quantized(i.voxels(spark, sf), 1.2)


@query("depth_images", f"WITH {i.PIXELS} SELECT frame, y, x, round(CAST(round(depth * (65535 / 30.0)) AS INTEGER) * (30.0 / 65535), 7) AS depth FROM pixels")
def depth_images(spark, sf):
    """Depth maps through 16-bit images."""
    png.write_depths(i.pixels(spark, sf), path := _place(spark, "depths"), 64, 64)
    return png.depths(spark, path).select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("int").alias("frame"), "y", "x", r("depth", 7).alias("depth"))
