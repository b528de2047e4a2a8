"""Queries of the learning operators, of listings and of incremental fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geometry import r
from tessera.operators import learn as n
from tessera.plans import inputs as i
from tessera.plans.registry import query

_MEAN = f"{i.CELLS}, size AS (SELECT cluster, count(DISTINCT sample) AS n FROM cells GROUP BY cluster), mean AS (SELECT cluster, idx, sum(val * w) / sum(w) AS mean, sum(w) / max(n) AS w FROM cells JOIN size USING (cluster) GROUP BY cluster, idx HAVING sum(w) > 0)"
_FEATURES = "features AS (SELECT sample, idx * 2 AS feature, val AS x FROM cells WHERE w > 0 UNION ALL SELECT sample, idx * 2 + 1, 1.0 FROM cells WHERE w > 0)"
_WEIGHTS = "weights AS (SELECT CAST(unnest(range(128)) AS INTEGER) AS feature), wts AS (SELECT feature, (feature * 37 % 19 - 9) / 10.0::DOUBLE AS wt FROM weights)"


def _weights(spark):
    return spark.range(128).select(F.col("id").cast("int").alias("feature"), ((F.col("id") * 37 % 19 - 9) / 10.0).alias("wt"))


def _scored(spark, sf):
    return n.linear_score(n.feature_rows(i.cells(spark, sf)), _weights(spark), 0.1)


@query("occupied_ratio", f"WITH {i.CELLS} SELECT sample, round(count(*) FILTER (w > 0) / 64.0::DOUBLE, 6) AS ratio FROM cells GROUP BY sample")
def occupied_ratio(spark, sf):
    return n.occupied_ratio(i.cells(spark, sf), 64).withColumn("ratio", r("ratio"))


@query("feature_rows", f"WITH {i.CELLS}, {_FEATURES} SELECT feature, count(*) AS n, round(sum(x), 6) + 0.0::DOUBLE AS total FROM features GROUP BY feature")
def feature_rows(spark, sf):
    return n.feature_rows(i.cells(spark, sf)).groupBy("feature").agg(F.count("*").alias("n"), r(F.sum("x")).alias("total"))


_SCORED = f"{i.CELLS}, {_FEATURES}, {_WEIGHTS}, scored AS (SELECT sample, sum(x * wt) + 0.1 AS score FROM features JOIN wts USING (feature) GROUP BY sample)"


@query("linear_score", f"WITH {_SCORED} SELECT sample, round(score, 6) AS score, CASE WHEN score > 0 THEN 1 ELSE -1 END AS label FROM scored")
def linear_score(spark, sf):
    return _scored(spark, sf).withColumn("score", r("score"))


@query("primal_weights", f"WITH {i.CELLS}, {_FEATURES} SELECT feature, round(sum(x * (sample % 7 - 3)), 6) + 0.0::DOUBLE AS wt FROM features GROUP BY feature")
def primal_weights(spark, sf):
    c = i.cells(spark, sf)
    alphas = c.select("sample").distinct().withColumn("alpha", (F.col("sample") % 7 - 3).cast("double"))
    return n.primal_weights(n.feature_rows(c), alphas).withColumn("wt", r("wt"))


@query("top_detections", f"WITH {_SCORED} SELECT sample, round(score, 6) AS score FROM scored ORDER BY score DESC, sample LIMIT 25")
def top_detections(spark, sf):
    return n.top(_scored(spark, sf), 25).select("sample", r("score").alias("score"))


@query("hard_negatives", f"WITH {_SCORED} SELECT sample, round(score, 6) AS score FROM scored WHERE sample NOT IN (SELECT vec_id FROM embeddings WHERE label = 0) ORDER BY score DESC, sample LIMIT 40")
def hard_negatives(spark, sf):
    known = i.read(spark, sf, "embeddings").filter("label = 0").select(F.col("vec_id").alias("sample"))
    return n.hard_negatives(_scored(spark, sf), known, 40).select("sample", r("score").alias("score"))


@query("cell_mean", f"WITH {_MEAN} SELECT cluster, idx, round(mean, 8) + 0.0::DOUBLE AS mean, round(w, 6) AS w FROM mean")
def cell_mean(spark, sf):
    return n.cell_mean(i.cells(spark, sf)).withColumns({"mean": r("mean", 8), "w": r("w")})


@query("cell_clean", f"WITH {i.CELLS}, k AS (SELECT cluster, idx FROM cells WHERE w > 0 GROUP BY cluster, idx HAVING count(*) >= 38) SELECT cluster, idx, count(*) AS n FROM cells SEMI JOIN k USING (cluster, idx) GROUP BY cluster, idx")
def cell_clean(spark, sf):
    return n.clean_cells(i.cells(spark, sf), 38).groupBy("cluster", "idx").agg(F.count("*").alias("n"))


_ERRORS = f"{_MEAN}, errors AS (SELECT sample, mean.cluster, sum(cells.w * (val - mean) * (val - mean)) AS error FROM cells JOIN mean USING (idx) WHERE cells.w > 0 GROUP BY sample, mean.cluster)"


@query("cluster_errors", f"WITH {_ERRORS} SELECT sample, cluster, round(error, 7) AS error FROM errors")
def cluster_errors(spark, sf):
    c = i.cells(spark, sf)
    return n.cluster_errors(c, n.cell_mean(c)).withColumn("error", r("error", 7))


@query("assign_cluster", f"WITH {_ERRORS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY error, cluster) AS k FROM errors) SELECT sample, cluster, round(error, 7) AS error, round(greatest(0, sqrt(error) - 0.9), 7) + 0.0::DOUBLE AS gamma FROM k WHERE k = 1")
def assign_cluster(spark, sf):
    c = i.cells(spark, sf)
    return n.assign_clusters(n.cluster_errors(c, n.cell_mean(c)), 0.9).withColumns({"error": r("error", 7), "gamma": r("gamma", 7)})


_E0 = f"{_MEAN}, data AS (SELECT cluster, sample, idx, val - mean AS val, cells.w AS w FROM cells JOIN mean USING (cluster, idx) WHERE cells.w > 0), k0 AS (SELECT cluster, sample, sum(w * val) / sum(w) AS coeff FROM data GROUP BY cluster, sample)"


@query("pca_expectation", f"WITH {_E0} SELECT cluster, sample, round(coeff, 8) + 0.0::DOUBLE AS coeff FROM k0")
def pca_expectation(spark, sf):
    c = i.cells(spark, sf)
    means = n.cell_mean(c)
    return n.expectation(n.centred(c, means), means.select("cluster", "idx", F.lit(1.0).alias("base"))).withColumn("coeff", r("coeff", 8))


_M1 = f"{_E0}, raw AS (SELECT cluster, idx, sum(w * val * coeff) / sum(w * coeff * coeff) AS b FROM data JOIN k0 USING (cluster, sample) GROUP BY cluster, idx), len AS (SELECT cluster, sqrt(sum(b * b)) AS size FROM raw GROUP BY cluster), base AS (SELECT cluster, idx, b / size AS base FROM raw JOIN len USING (cluster)), k1 AS (SELECT cluster, sample, sum(w * val * base) / sum(w * base * base) AS coeff FROM data JOIN base USING (cluster, idx) GROUP BY cluster, sample)"


@query("pca_first_component", f"WITH {_M1} SELECT cluster, sample, round(coeff, 7) + 0.0::DOUBLE AS coeff FROM k1")
def pca_first_component(spark, sf):
    return n.first_component(i.cells(spark, sf), 1)[2].withColumn("coeff", r("coeff", 7))


@query("pca_reconstruct", f"WITH {_M1} SELECT sample, count(*) AS n, round(sum(mean + base * coeff), 6) + 0.0::DOUBLE AS total FROM k1 JOIN mean USING (cluster) JOIN base USING (cluster, idx) GROUP BY sample")
def pca_reconstruct(spark, sf):
    return n.reconstruct(*n.first_component(i.cells(spark, sf), 1)).groupBy("sample").agg(F.count("*").alias("n"), r(F.sum("val")).alias("total"))


@query("pca_components")
def pca_components(spark, sf):
    return n.components_by_cluster(i.cells(spark, sf)).withColumn("base", r("base", 4))


@query("cluster_mean_scale", f"WITH {i.BOXES} SELECT category, round(avg(lx), 6) AS lx, round(avg(ly), 6) AS ly, round(avg(lz), 6) AS lz FROM boxes GROUP BY category")
def cluster_mean_scale(spark, sf):
    return i.boxes(spark, sf).groupBy("category").agg(*[r(F.avg(c)).alias(c) for c in ("lx", "ly", "lz")])


@query("nearest_points", f"""WITH {i.POINTS}, d AS (SELECT a.pid, b.pid AS oid, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS distance FROM pts a JOIN pts b ON a.pid <> b.pid), k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, oid) AS rank FROM d WHERE distance <= 4.0)
    SELECT pid, oid, round(distance, 7) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def nearest_points(spark, sf):
    p = i.points(spark, sf)
    return n.nearest_neighbours(p, p.withColumnRenamed("pid", "oid"), 4.0, 3).withColumn("distance", r("distance", 7))


_STEMS = "stems AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '_' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS stem FROM orders)"


@query("file_stems", f"WITH {_STEMS}, have AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS frame FROM lineitem) SELECT stem, coalesce('depth/' || stem || '.png', '') AS image, CASE WHEN frame IS NULL THEN '' ELSE 'params/' || stem || '.txt' END AS params FROM stems LEFT JOIN have ON frame = left(stem, 10)")
def file_stems(spark, sf):
    from tessera.sources.listing import partner_paths, stem

    stems = i.read(spark, sf, "orders").select(stem("o_orderkey", "o_custkey").alias("stem"))
    have = i.read(spark, sf, "lineitem").select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("frame")).distinct()
    return partner_paths(stems, have)


@query("incremental_fusion", f"WITH {i.VOX_COARSE} SELECT vx, vy, vz, round(d, 6) AS d, round(w, 6) AS w FROM vox")
def incremental_fusion(spark, sf):
    """Three batches folded one after the other into a state: the same as all at once."""
    from tessera.streaming.fusion import empty_state, fold_batch

    o = i.observations(spark, sf, True)
    bounds = o.agg(F.percentile_approx("seq", [0.33, 0.66])).first()[0] or [0, 0]
    state = empty_state(spark)
    for part in (o.filter(F.col("seq") <= bounds[0]), o.filter((F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1])), o.filter(F.col("seq") > bounds[1])):
        state = fold_batch(state, part)
    return state.select("vx", "vy", "vz", r("d").alias("d"), r("w").alias("w"))
