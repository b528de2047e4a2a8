"""Spark helpers of this subpackage: shared tables, bounded samples, folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.plans.components import shared_folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(key: str | Column, n: int) -> Column:
    """crc32(key as text) mod n; null for a null key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows of ``df`` (all, if it has no more), drawn by a hash of ``key``: the same rows in every run."""
    rows = df.count()
    if rows <= n:
        return df
    share = int(n / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < share)


#: Numeric keys up to this number (of 8 bytes each) are sent to every executor; a larger set, or keys of another type, are joined by shuffle.
BROADCAST_IDS = 500_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` (a table of keys), marked for broadcast where its counted rows are few and their size is known."""
    fixed = all(isinstance(f.dataType, NumericType) for f in ids.schema.fields)
    return F.broadcast(ids) if fixed and ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column of that name)."""
    return df.join(small(ids), key, "left_semi")


def version(text: str | Column) -> Column:
    """A text's 64-bit hash: with the id it names a row's content where ids repeat."""
    return F.xxhash64(text)


def drop_rows(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``df`` whose id and text are not in ``found`` (id, version); a null id equals a null id."""
    gone = small(found.toDF("__id", "__version"))
    return df.join(gone, df[id_col].eqNullSafe(F.col("__id")) & (version(df[text_col]) == F.col("__version")), "left_anti")


#: Bytes of one Arrow batch handed to Python: long documents must not add up in a worker.
ARROW_BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes as well as in rows.

    The bound is a setting of the session, read when the plan runs; it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return df.mapInArrow(function, schema)
