"""The corpus pipeline: from raw documents to encoded training text.

Every stage takes the documents that its predecessor kept, with all columns of
``documents``; the last one encodes them.  A text that a stage changes gets
its ``n_chars`` anew.

Stages drop rows, not ids: where an id repeats with different texts, only the
rows whose own text is rejected go, and of rows that repeat an id and a text
one stays in its group of near-duplicates.  A null doc_id is an id like others
except to line_dedup, which neither changes nor drops its rows.  A null or
empty text is scored like any text, is in no group and holds no benchmark
passage; a very long one is read whole by every stage.  Columns beyond those
of ``documents`` are kept up to the last stage.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, linededup, minmax, quality
from tessera.llm.queries import read, tokenizer_path
from tessera.llm.runtime import fold, materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns as in op2."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document holds; a document that nothing is left of goes."""
    cut = linededup.dedup_lines(docs, added="__removed")
    emptied = (F.col("__removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r]", " "))) == 0)
    left = cut.filter(~emptied)
    return left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minmax.one_of_each_group(docs, minmax.Params())


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text they decode to."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


#: (name, stage); a stage takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Learned scores have no SQL: tests/llm compares the rows with a brute-force version of all stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
