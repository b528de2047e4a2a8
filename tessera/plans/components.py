"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.plans.skew import hot_keys, join_unique


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder where it is unset, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _summary(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()


#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) over these edges, for each node but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[left], label[right]
        open_ = x != y
        if not open_.any():
            break
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Edges that one task contracts to the end instead of rounds of joins: 4 MB.
AT_ONCE = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges as stars within each task's share of them: the same components, fewer edges, short ways."""
    kind = edges.schema["a"].dataType
    if not isinstance(kind, IntegralType) or kind != edges.schema["b"].dataType:
        return edges

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)

    def made(held):
        found = star(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(found, (arrow, arrow), strict=True)], ["a", "b"])

    arrow = pa.int32() if kind.simpleString() == "int" else pa.int64()
    return edges.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}") if kind.simpleString() in ("int", "bigint") else edges


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Each task first contracts the edges that it has to stars.  If ``at_once``
    edges of whole numbers at most are left, one task contracts all of them.
    Otherwise large-star and small-star in turn: each node hands its larger neighbours
    to its smallest one, then its smaller neighbours.  The edges become stars
    around the smallest nodes in about log(n) rounds, whatever the graph's
    diameter, and never grow in number.  A finished star takes no part in the
    joins: its centre has no smaller neighbour and its leaves only one; the
    edges of a hub that does take part are not dealt to one task.  It ends
    when a round changes no edge, and raises after ``max_rounds``.  An edge
    with a null end is ignored.
    """
    real = edges.filter("a is not null and b is not null")
    # a > b throughout
    stars = settle(_contracted(real.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "edges")
    before = _summary(stars)
    few = before["n"] <= min(at_once, CHUNK) and _contracted(stars) is not stars
    if few:
        stars = settle(_contracted(stars.coalesce(1)), "stars")
    for _ in range(0 if few else max_rounds):
        # large: b's larger neighbours go to its smallest one
        low = stars.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "b")
        large = settle(join_unique(stars, low, "b", "left", hot_keys(stars, "b", before["n"])).select("a", F.coalesce("low", "b").alias("b")).distinct(), "large-stars")
        # small: a's smaller neighbours go to its smallest one
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        several = least.filter("low < high").select("a", "low")
        handed = join_unique(large, several, "a", hot=hot_keys(large, "a", before["n"])).filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = settle(least.select("a", F.col("low").alias("b")).unionByName(handed).distinct(), "stars")
        after = _summary(stars)
        if after == before:
            break
        before = after
    else:
        if not few:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    ends = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    loops = real.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return ends.unionByName(loops.join(ends, "node", "left_anti"))
