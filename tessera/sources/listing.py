"""Listings of frame files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stem(frame: str, partner: str) -> Column:
    """File stem of a frame and its partner: ten digits each."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    return F.concat(pad(frame), F.lit("_"), pad(partner))


def partner_paths(stems: DataFrame, have: DataFrame) -> DataFrame:
    """(stem, image, params): the image always, the parameter file or "" where there is none for the frame."""
    met = stems.join(have, F.substring("stem", 1, 10) == F.col("frame"), "left")
    return met.select("stem", F.concat(F.lit("depth/"), "stem", F.lit(".png")).alias("image"), F.when(F.col("frame").isNull(), F.lit("")).otherwise(F.concat(F.lit("params/"), "stem", F.lit(".txt"))).alias("params"))


def files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, name): a folder's files of that extension whose names begin with a digit, in order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder).select("path")
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.filter(F.col("name").rlike("^[0-9]")).orderBy("name")


def folders(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(name): the folders right below ``path`` that hold a file and whose names begin with the prefix, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.split("path", "/").alias("parts"))
    depth = len([p for p in path.rstrip("/").split("/") if p])
    # a file's URI has a scheme in front of the folders
    name = F.element_at(F.filter("parts", lambda p: p != ""), F.lit(depth + 2))
    return found.filter(F.size(F.filter("parts", lambda p: p != "")) > depth + 2).select(name.alias("name")).distinct().filter(F.col("name").startswith(prefix)).orderBy("name")


def side_partners(frames: DataFrame, pairs: DataFrame, sides: int = 3, reach: int = 19) -> DataFrame:
    """(frame, partner): the nearest partner on each wanted side of a frame among its pairs (frame, partner); bit 1 of sides wants the later, bit 2 the earlier."""
    apart = F.col("partner") - F.col("frame")
    near = pairs.join(frames.select("frame"), "frame", "left_semi").filter(F.abs(apart).between(1, reach))
    wanted = near.filter(((apart > 0) & F.lit(bool(sides & 1))) | ((apart < 0) & F.lit(bool(sides & 2))))
    return wanted.groupBy("frame", (apart > 0).alias("later")).agg(F.min_by("partner", F.abs(apart)).alias("partner")).select("frame", "partner")


def replace_extension(name: Column, extension: str) -> Column:
    """A file name with another extension; one without any gets it."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(f".{extension}"))


def begins_with(text: Column, start: str) -> Column:
    return F.lower(text).startswith(start.lower())


def ends_with(text: Column, end: str) -> Column:
    return F.lower(text).endswith(end.lower())
