"""Samples as long rows (sample, cluster, idx, val, w): scoring, cluster models, components.

A feature matrix stays in long form; a cell without a row, or of weight 0, is
unobserved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_rows(cells: DataFrame, least: float = 0.0) -> DataFrame:
    """(sample, feature, x): an observed cell i is feature 2i, its value, and feature 2i + 1, its occupancy."""
    seen = cells.filter(F.col("w") > least)
    pair = F.explode(F.array(F.struct((F.col("idx") * 2).alias("feature"), F.col("val").alias("x")), F.struct((F.col("idx") * 2 + 1).alias("feature"), F.lit(1.0).alias("x"))))
    return seen.select("sample", pair.alias("f")).select("sample", "f.feature", "f.x")


def occupied_ratio(cells: DataFrame, size: int) -> DataFrame:
    """(sample, ratio): observed cells over all."""
    return cells.groupBy("sample").agg((F.count_if(F.col("w") > 0) / float(size)).alias("ratio"))


def primal_weights(support: DataFrame, alphas: DataFrame) -> DataFrame:
    """(feature, wt): the sum of alpha times the support vectors (sample, feature, x)."""
    return support.join(alphas.select("sample", "alpha"), "sample").groupBy("feature").agg(F.sum(F.col("alpha") * F.col("x")).alias("wt"))


def linear_score(features: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(sample, score, label): the dot product with the weights, plus the bias; label is its sign.

    The weights are as many as a sample has features: Spark sends them to every executor while they are small.
    """
    out = features.join(weights, "feature", "left").groupBy("sample").agg((F.sum(F.col("x") * F.coalesce("wt", F.lit(0.0))) + bias).alias("score"))
    return out.withColumn("label", F.when(F.col("score") > 0, F.lit(1)).otherwise(F.lit(-1)))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n highest scores; of equals the smallest sample."""
    return scored.orderBy(F.col("score").desc(), "sample").limit(n)


def hard_negatives(scored: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The n highest-scoring samples that are not known yet."""
    return top(scored.join(known.select("sample"), "sample", "left_anti"), n)


def cell_mean(cells: DataFrame) -> DataFrame:
    """(cluster, idx, mean, w): weighted mean over the samples that observe the cell, and mean weight over all samples."""
    size = cells.groupBy("cluster").agg(F.countDistinct("sample").alias("n"))
    sums = cells.groupBy("cluster", "idx").agg(F.sum(F.col("val") * F.col("w")).alias("vw"), F.sum("w").alias("ww")).filter("ww > 0")
    return sums.join(size, "cluster").select("cluster", "idx", (F.col("vw") / F.col("ww")).alias("mean"), (F.col("ww") / F.col("n")).alias("w"))


def clean_cells(cells: DataFrame, least: int) -> DataFrame:
    """Cells that ``least`` samples of their cluster or more observe."""
    common = cells.filter("w > 0").groupBy("cluster", "idx").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return cells.join(common.select("cluster", "idx"), ["cluster", "idx"], "left_semi")


def cluster_errors(cells: DataFrame, means: DataFrame) -> DataFrame:
    """(sample, cluster, error): weighted squared distance of each sample to each cluster's mean.

    Rows meet on the cell index, not sample by sample: each cell row is joined
    to the clusters' means of that cell, and sums are combined before the
    shuffle.
    """
    m = means.select("idx", F.col("cluster").alias("to"), "mean")
    met = cells.filter("w > 0").select("sample", "idx", "val", "w").join(m, "idx")
    return met.groupBy("sample", F.col("to").alias("cluster")).agg(F.sum(F.col("w") * (F.col("val") - F.col("mean")) * (F.col("val") - F.col("mean"))).alias("error"))


def assign_clusters(errors: DataFrame, outlier: float = 0.0) -> DataFrame:
    """(sample, cluster, error, gamma): the nearest cluster, the smallest number of equals; gamma is how far it is beyond the outlier bound."""
    best = errors.groupBy("sample").agg(F.min_by(F.struct("cluster", "error"), F.struct("error", "cluster")).alias("b"))
    return best.select("sample", "b.cluster", "b.error", F.greatest(F.lit(0.0), F.sqrt("b.error") - outlier).alias("gamma"))


def centred(cells: DataFrame, means: DataFrame) -> DataFrame:
    """(cluster, sample, idx, val, w): observed values less their cluster's mean."""
    return cells.filter("w > 0").join(means.select("cluster", "idx", "mean"), ["cluster", "idx"]).select("cluster", "sample", "idx", (F.col("val") - F.col("mean")).alias("val"), "w")


def expectation(data: DataFrame, base: DataFrame) -> DataFrame:
    """(cluster, sample, coeff): the weighted projection on one base vector per cluster (cluster, idx, base)."""
    met = data.join(base, ["cluster", "idx"])
    return met.groupBy("cluster", "sample").agg((F.sum(F.col("w") * F.col("val") * F.col("base")) / F.nullif(F.sum(F.col("w") * F.col("base") * F.col("base")), F.lit(0.0))).alias("c")).select("cluster", "sample", F.coalesce("c", F.lit(0.0)).alias("coeff"))


def maximization(data: DataFrame, coeffs: DataFrame) -> DataFrame:
    """(cluster, idx, base): the weighted base vector for given coefficients, to unit length."""
    met = data.join(coeffs, ["cluster", "sample"])
    raw = met.groupBy("cluster", "idx").agg((F.sum(F.col("w") * F.col("val") * F.col("coeff")) / F.nullif(F.sum(F.col("w") * F.col("coeff") * F.col("coeff")), F.lit(0.0))).alias("b")).select("cluster", "idx", F.coalesce("b", F.lit(0.0)).alias("b"))
    size = raw.groupBy("cluster").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("size"))
    return raw.join(size, "cluster").select("cluster", "idx", F.when(F.col("size") > 0, F.col("b") / F.col("size")).otherwise(0.0).alias("base"))


def first_component(cells: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(means, base, coeffs): one weighted principal component per cluster by expectation and maximisation from a constant start."""
    means = cell_mean(cells)
    data = centred(cells, means)
    base = means.select("cluster", "idx", F.lit(1.0).alias("base"))
    coeffs = expectation(data, base)
    for _ in range(rounds):
        base = maximization(data, coeffs)
        coeffs = expectation(data, base)
    return means, base, coeffs


def reconstruct(means: DataFrame, base: DataFrame, coeffs: DataFrame) -> DataFrame:
    """(cluster, sample, idx, val): mean + base * coeff."""
    model = means.select("cluster", "idx", "mean").join(base, ["cluster", "idx"], "left")
    return coeffs.join(model, "cluster").select("cluster", "sample", "idx", (F.col("mean") + F.coalesce(F.col("base") * F.col("coeff"), F.lit(0.0))).alias("val"))


def joint_models(cells: DataFrame, rounds: int = 3, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(means, assignment): de-noise, model and re-assign in turn, from the clusters given."""
    from tessera.plans.components import settle

    current = cells
    for _ in range(rounds):
        means = settle(cell_mean(clean_cells(current, least)), "means")
        assignment = settle(assign_clusters(cluster_errors(current, means)), "assignment")
        current = cells.drop("cluster").join(assignment.select("sample", "cluster"), "sample")
    return means, assignment


def components_by_cluster(cells: DataFrame, k: int = 3, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(cluster, k, idx, base): k weighted components of each cluster, one after the other, each made orthogonal to the earlier ones.

    A cluster's samples are one group in NumPy: a dense block of its cells.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        samples, rows = np.unique(pdf["sample"], return_inverse=True)
        idx, columns = np.unique(pdf["idx"], return_inverse=True)
        x, w = np.zeros((len(samples), len(idx))), np.zeros((len(samples), len(idx)))
        x[rows, columns], w[rows, columns] = pdf["val"], pdf["w"]
        found: list[np.ndarray] = []
        for _ in range(min(k, len(samples))):
            b = np.ones(len(idx)) / np.sqrt(len(idx))
            for _ in range(rounds):
                c = (w * x) @ b / np.maximum(w @ (b * b), 1e-12)
                new = (w * x).T @ c / np.maximum(w.T @ (c * c), 1e-12)
                for e in found:
                    new -= (new @ e) * e
                size = np.linalg.norm(new)
                new = new / size if size > 0 else new
                if np.abs(new - b).max() < tolerance:
                    b = new
                    break
                b = new
            x = x - np.outer((w * x) @ b / np.maximum(w @ (b * b), 1e-12), b)
            found.append(b)
        out = [(int(pdf["cluster"].iloc[0]), n, int(i), float(v)) for n, b in enumerate(found) for i, v in zip(idx, b, strict=True)]
        return pd.DataFrame(out, columns=["cluster", "k", "idx", "base"])

    return centred(cells, cell_mean(cells)).groupBy("cluster").applyInPandas(solve, "cluster int, k int, idx int, base double")


def train_linear(features: DataFrame, labels: DataFrame, positive_weight: float = 10.0, regularization: float = 0.01, rounds: int = 30) -> tuple[DataFrame, float]:
    """((feature, wt), bias) of a linear classifier: logistic loss by gradient steps, positives weighted.

    labels: (sample, y) with y 1 or -1.  Every step is one join and two sums.
    """
    from tessera.plans.components import settle

    spark = features.sparkSession
    n = labels.count()
    weights = settle(features.select("feature").distinct().withColumn("wt", F.lit(0.0)), "weights")
    bias = 0.0
    for _ in range(rounds):
        score = linear_score(features, weights, bias).join(labels, "sample")
        pull = score.select("sample", (F.when(F.col("y") > 0, F.lit(positive_weight)).otherwise(F.lit(1.0)) * -F.col("y") / (1 + F.exp(F.col("y") * F.col("score")))).alias("g"))
        pull = settle(pull, "pull")
        grad = features.join(pull, "sample").groupBy("feature").agg((F.sum(F.col("x") * F.col("g")) / n).alias("grad"))
        weights = settle(weights.join(grad, "feature", "left").select("feature", (F.col("wt") * (1 - regularization) - 0.5 * F.coalesce("grad", F.lit(0.0))).alias("wt")), "weights")
        bias -= 0.5 * (pull.agg(F.sum("g")).first()[0] or 0.0) / max(1, n)
    del spark
    return weights, bias


def nearest_neighbours(points: DataFrame, others: DataFrame, radius: float, k: int) -> DataFrame:
    """(pid, oid, distance, rank): the k nearest others (oid, px, py, pz) of each point within the radius: a range join by grid cells."""
    from pyspark.sql import Window as W

    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    spread = points.select("pid", "px", "py", "pz")
    for c in "xyz":
        spread = spread.withColumn(f"k{c}", F.explode(F.array(*[cell(f"p{c}") + i for i in (-1, 0, 1)])))
    there = others.select("oid", *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"], *[cell(f"p{c}").alias(f"k{c}") for c in "xyz"])
    apart = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0)))
    met = spread.join(there, ["kx", "ky", "kz"]).select("pid", "oid", apart.alias("distance")).filter((F.col("distance") <= radius) & (F.col("pid") != F.col("oid")))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy("distance", "oid"))).filter(F.col("rank") <= k)
