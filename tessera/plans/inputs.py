"""Spatial inputs derived from the relational test tables, each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signed distances are kept between these.
TRUNC_NEG, TRUNC_POS = -1.0, 1.2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """(seq, vx, vy, vz, d, w, r, g, b, label): distance observations in order; coarse ones meet often in a voxel."""
    e = read(spark, sf_dir, "events")
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    user = F.col("user_id").cast("int")
    key = [user.bitwiseAND(7), F.floor(day / 8).cast("int"), F.floor(hour / 6).cast("int")] if coarse else [user.bitwiseAND(31), day, hour]
    number = F.col("event_id")
    out = e.select(
        number.alias("seq"),
        *[k.alias(n) for k, n in zip(key, ("vx", "vy", "vz"), strict=True)],
        ((F.col("value") - 100) / 100).alias("d"),
        (0.25 + (number % 8) / 8.0).alias("w"),
        (number % 256).cast("int").alias("r"),
        (number * 7 % 256).cast("int").alias("g"),
        (number * 13 % 256).cast("int").alias("b"),
        (number % 5).cast("int").alias("label"),
    )
    return out.filter(F.col("d").between(TRUNC_NEG, TRUNC_POS))


def _observations_sql(vx: str, vy: str, vz: str) -> str:
    return f"""SELECT event_id AS seq, CAST({vx} AS INTEGER) AS vx, CAST({vy} AS INTEGER) AS vy, CAST({vz} AS INTEGER) AS vz,
        (value - 100) / 100 AS d, 0.25 + (event_id % 8) / 8.0::DOUBLE AS w,
        CAST(event_id % 256 AS INTEGER) AS r, CAST(event_id * 7 % 256 AS INTEGER) AS g, CAST(event_id * 13 % 256 AS INTEGER) AS b,
        CAST(event_id % 5 AS INTEGER) AS label
    FROM events WHERE (value - 100) / 100 BETWEEN -1.0 AND 1.2"""


OBS = "obs AS (" + _observations_sql("user_id & 31", "day(ts)", "hour(ts)") + ")"
OBS_COARSE = "obs AS (" + _observations_sql("user_id & 7", "day(ts) // 8", "hour(ts) // 6") + ")"

_FOLD = """list_reduce(list_prepend({'d': 0.0::DOUBLE, 'w': 0.0::DOUBLE}, list({'d': d, 'w': w} ORDER BY seq)),
        lambda a, x: {'d': (a.d * a.w + x.d * x.w) / (a.w + x.w), 'w': least(a.w + x.w, 5.0)})"""

#: Fused voxels: (vx, vy, vz, d, w, label).
VOX_BODY = f"""fused AS (SELECT vx, vy, vz, {_FOLD} AS s, coalesce(arg_max(label, seq) FILTER (label > 0), -1) AS label FROM obs GROUP BY vx, vy, vz),
    vox AS (SELECT vx, vy, vz, s.d AS d, s.w AS w, label FROM fused)"""
VOX = f"{OBS}, {VOX_BODY}"
VOX_COARSE = f"{OBS_COARSE}, {VOX_BODY}"


def voxels(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """(vx, vy, vz, d, w, label): the observations fused."""
    from tessera.operators.volume import fuse

    return fuse(observations(spark, sf_dir, coarse))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, px, py, pz): query points, in voxel coordinates among the fine voxels."""
    e = F.col("embedding")
    scale = lambda i, mid, span: (e[i].cast("double") * span + mid)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), scale(0, 16.0, 40.0).alias("px"), scale(1, 15.0, 40.0).alias("py"), scale(2, 12.0, 30.0).alias("pz"))


POINTS = """pts AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) * 40.0::DOUBLE + 16.0::DOUBLE AS px, CAST(embedding[2] AS DOUBLE) * 40.0::DOUBLE + 15.0::DOUBLE AS py,
    CAST(embedding[3] AS DOUBLE) * 30.0::DOUBLE + 12.0::DOUBLE AS pz FROM embeddings)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obb_id, category, score, cx, cy, bz, lx, ly, lz, theta): one box for each supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("obb_id"),
        (k % 3).cast("int").alias("category"),
        (F.col("s_acctbal") / 10000).alias("score"),
        ((k * 37 % 101) * 0.3).alias("cx"),
        ((k * 53 % 97) * 0.3).alias("cy"),
        ((k % 7) * 0.5).alias("bz"),
        (2.0 + k % 5).alias("lx"),
        (1.0 + k % 4).alias("ly"),
        (1.5 + k % 3).alias("lz"),
        ((k * 31 % 360) * F.lit(0.017453292519943295)).alias("theta"),
    )


BOXES = """boxes AS (SELECT s_suppkey AS obb_id, CAST(s_suppkey % 3 AS INTEGER) AS category, s_acctbal / 10000 AS score,
    (s_suppkey * 37 % 101) * 0.3::DOUBLE AS cx, (s_suppkey * 53 % 97) * 0.3::DOUBLE AS cy, (s_suppkey % 7) * 0.5::DOUBLE AS bz,
    2.0::DOUBLE + s_suppkey % 5 AS lx, 1.0::DOUBLE + s_suppkey % 4 AS ly, 1.5::DOUBLE + s_suppkey % 3 AS lz,
    (s_suppkey * 31 % 360) * 0.017453292519943295::DOUBLE AS theta FROM supplier)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, depth): one depth for each pixel of six frames, 64 x 64."""
    l = read(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_orderkey") % 6).cast("int").alias("frame"), F.floor(F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") * 7 % 64).cast("int").alias("x")).agg((F.min("l_extendedprice") / 10000 + 1).alias("depth"))


PIXELS = """pixels AS (SELECT CAST(l_orderkey % 6 AS INTEGER) AS frame, CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey * 7 % 64 AS INTEGER) AS x,
    min(l_extendedprice) / 10000 + 1 AS depth FROM lineitem GROUP BY 1, 2, 3)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, cluster, idx, val, w): feature cells of samples; weight 0 where unobserved."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("cluster"), F.posexplode("embedding").alias("idx", "v"))
    return e.select("sample", "cluster", "idx", F.col("v").cast("double").alias("val"), F.floor((F.col("sample") * 7 + F.col("idx") * 3) % 5).cast("double").alias("w"))


CELLS = """cells AS (SELECT vec_id AS sample, label AS cluster, i AS idx, CAST(embedding[i + 1] AS DOUBLE) AS val, CAST((vec_id * 7 + i * 3) % 5 AS DOUBLE) AS w
    FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i))"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, v0, v1, v2): triangles of a 40-wide grid; orders of status P are holes."""
    k = F.col("o_orderkey")
    base = read(spark, sf_dir, "orders").select(k.alias("k"), "o_orderstatus", "o_totalprice").filter("o_orderstatus <> 'P' and k % 40 < 39")
    return base.selectExpr("k * 2 as fid", "k as v0", "k + 1 as v1", "k + 40 as v2").unionByName(base.filter("o_totalprice > 100000").selectExpr("k * 2 + 1 as fid", "k + 1 as v0", "k + 41 as v1", "k + 40 as v2"))


FACES = """grid AS (SELECT o_orderkey AS k, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 40 < 39),
    faces AS (SELECT k * 2 AS fid, k AS v0, k + 1 AS v1, k + 40 AS v2 FROM grid UNION ALL SELECT k * 2 + 1, k + 1, k + 41, k + 40 FROM grid WHERE o_totalprice > 100000)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, x, y, z): the grid's vertices with a height."""
    used = faces(spark, sf_dir).select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    v = F.col("vid")
    return used.select("vid", (v % 40 * 1.0).alias("x"), F.floor(v / 40).cast("double").alias("y"), ((v * 13 % 17) * 0.1).alias("z"))


VERTICES = """verts AS (SELECT DISTINCT vid, CAST(vid % 40 AS DOUBLE) AS x, CAST(vid // 40 AS DOUBLE) AS y, (vid * 13 % 17) * 0.1::DOUBLE AS z
    FROM (SELECT unnest([v0, v1, v2]) AS vid FROM faces))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame): distinct frame numbers with gaps."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(days.cast("int").alias("frame")).distinct()


FRAMES = "frames AS (SELECT DISTINCT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS frame FROM orders)"
