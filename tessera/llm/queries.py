"""The operators of this subpackage applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontam, langid, linededup, minmax, quality, sketch, tokencount, toxicity
from tessera.llm.runtime import fold, materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(quality.text_features(read(spark, sf_dir, "documents"), "doc_id", "text"), "quality-features")
    ranker = quality.fit_features(known, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score_features(known, ranker)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that holds benchmark passages; items: the passages' numbers, as text."""
    found = decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), items.alias("items"), F.max("words").alias("matched_words"), F.sum("windows").alias("n_windows"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_edits(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: how many lines and characters it has lost, and a digest of what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("before"))
    left = F.coalesce("text", F.lit(""))
    return linededup.dedup_lines(docs).select("doc_id", F.col("lines_removed").cast("long").alias("n_lines_removed"), (F.coalesce("before", F.lit(0)) - F.length(left)).cast("long").alias("n_chars_removed"), F.sha2(left, 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = langid.predict(docs, langid.fit(docs, fold("doc_id", 4) != 2))
    return predicted.select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(2)) == 2).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(2)) == 2).alias("held_out"), "score", "predicted")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), minmax.CONTRACT)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_decontamination, op4_fingerprints, op5_line_dedup, op6_language, op7_toxicity, op8_near_duplicates, op9_chat, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.OVERLAPS_SQL, "op5_line_dedup": linededup.LINES_SQL, "op8_near_duplicates": minmax.COMPONENTS_SQL, "op9_chat": chat.ROTATE_SQL}
