"""Observations folded into a volume batch by batch: the streaming form of ``fuse``.

The state is a voxel table with the weight and distance of what has been
folded so far, which is itself the first observation of the next batch: a
saturated prefix acts through its (d, w) only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.volume import KEY, fuse

STATE = "vx int, vy int, vz int, d double, w double"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def fold_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch (seq, vx, vy, vz, d, w); voxels the batch doesn't touch pass by."""
    before = F.lit(-(1 << 40)).cast("long").alias("seq")
    seen = state.select(*KEY, "d", "w", before).unionByName(batch.select(*KEY, "d", "w", "seq"))
    return fuse(seen).select(*KEY, "d", "w")


class VolumeSink:
    """foreachBatch sink: keeps the volume as Parquet, a version for each batch.

    A version holds the voxels that its batch touches, and the volume is the
    latest row of each voxel.  After ``merge_every`` versions the whole volume
    is written; what it replaces is deleted with the next one, so that readers
    of the one before can finish.  A batch that is delivered again finds its
    version written and is not folded twice.
    """

    def __init__(self, folder: str, merge_every: int = 16):
        self.folder = folder.rstrip("/")
        self.merge_every = merge_every

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}{version:012d}"

    def _written(self, spark: SparkSession, kind: str) -> list[int]:
        """The complete versions: of kind "v" a batch's voxels, of kind "w" the whole volume."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith(kind) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def versions(self, spark: SparkSession) -> list[int]:
        """The batches that are folded and not deleted yet."""
        return sorted({*self._written(spark, "v"), *self._written(spark, "w")})

    def _current(self, spark: SparkSession) -> list[tuple[str, int]]:
        """The last whole volume, if there is one, and the versions after it."""
        whole = self._written(spark, "w")[-1:]
        return [*(("w", n) for n in whole), *(("v", n) for n in self._written(spark, "v") if not whole or n > whole[0])]

    def state(self, spark: SparkSession) -> DataFrame:
        tables = [spark.read.schema(STATE).parquet(self._path(*c)) for c in self._current(spark)]
        if not tables:
            return empty_state(spark)
        if len(tables) == 1:
            return tables[0]
        numbered = [t.withColumn("version", F.lit(n)) for n, t in enumerate(tables)]
        return reduce(DataFrame.unionByName, numbered).groupBy(*KEY).agg(F.max_by(F.struct("d", "w"), "version").alias("s")).select(*KEY, "s.d", "s.w")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= max(self.versions(spark), default=-1):
            return
        batch = batch.persist()
        try:
            touched = self.state(spark).join(batch.select(*KEY).distinct(), KEY, "left_semi")
            fold_batch(touched, batch).write.mode("overwrite").parquet(self._path("v", batch_id))
        finally:
            batch.unpersist()
        if sum(kind == "v" for kind, _ in self._current(spark)) >= self.merge_every:
            self._merge(spark, batch_id)

    def _merge(self, spark: SparkSession, batch_id: int) -> None:
        before = self._written(spark, "w")
        self.state(spark).write.mode("overwrite").parquet(self._path("w", batch_id))
        if not before:
            return
        old = [*(("w", n) for n in before[:-1]), *(("v", n) for n in self._written(spark, "v") if n <= before[-1])]
        for kind, n in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, n))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
