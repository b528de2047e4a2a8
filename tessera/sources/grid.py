"""Run-length grid files: scanlines of 16-bit values and weights, big-endian.

A file holds three sizes, axis, flip, origin, resolution and two byte counts,
then the scanlines in order of z and y.  A scanline is runs up to the end mark:
a length whose top bit tells a varying run, with an element for each cell, from
a constant one, with one element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
END, VARYING = 65535, 32768
HEAD = np.dtype([("size", ">i4", 3), ("axis", ">i4"), ("flip", ">i4"), ("origin", ">f4", 3), ("resolution", ">f4"), ("lengths", ">i4"), ("elements", ">i4")])

RUNS = "path string, y int, z int, start int, length int, varying boolean, items array<struct<value:int,weight:int>>, origin array<double>, resolution double"


def runs_of(content: bytes) -> Iterator[tuple[int, int, int, int, bool, np.ndarray]]:
    """(y, z, start, length, varying, items) of one file."""
    head = np.frombuffer(content, HEAD, 1)[0]
    words = np.frombuffer(content, ">u2", offset=HEAD.itemsize)
    at = 0
    for z in range(int(head["size"][2])):
        for y in range(int(head["size"][1])):
            start = 0
            while True:
                word = int(words[at])
                at += 1
                if word == END:
                    break
                length, varying = word & ~VARYING, bool(word & VARYING)
                n = length if varying else 1
                yield y, z, start, length, varying, words[at : at + 2 * n].reshape(n, 2)
                at += 2 * n
                start += length


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of run-length grid files; a file is read by one task, and its rows are runs, not cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                head = np.frombuffer(content, HEAD, 1)[0]
                origin, resolution = [float(x) for x in head["origin"]], float(head["resolution"])
                rows = []
                for y, z, start, length, varying, items in runs_of(content):
                    rows.append((p, y, z, start, length, varying, [{"value": int(a), "weight": int(b)} for a, b in items], origin, resolution))
                    if len(rows) >= 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "y", "z", "start", "length", "varying", "items", "origin", "resolution"]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RUNS)


def cells(runs: DataFrame) -> DataFrame:
    """(path, x, y, z, value, weight) of every cell."""
    items = F.when(F.col("varying"), F.col("items")).otherwise(F.array_repeat(F.col("items")[0], F.col("length")))
    return runs.select("path", "y", "z", "start", F.posexplode(items).alias("k", "e")).select("path", (F.col("start") + F.col("k")).alias("x"), "y", "z", "e.value", "e.weight")


def cell(runs: DataFrame, x: int, y: int, z: int) -> DataFrame:
    """(path, value, weight) of one cell: the run that holds it, without expanding any."""
    held = runs.filter((F.col("y") == y) & (F.col("z") == z) & (F.col("start") <= x) & (F.lit(x) < F.col("start") + F.col("length")))
    item = F.when(F.col("varying"), F.get("items", F.lit(x) - F.col("start"))).otherwise(F.col("items")[0])
    return held.select("path", item.alias("e")).select("path", "e.value", "e.weight")


def statistics(runs: DataFrame) -> DataFrame:
    """(path, runs, varying, constant, cells): how many runs of either kind, and the cells of varying ones, of each file."""
    return runs.groupBy("path").agg(F.count("*").alias("runs"), F.count_if("varying").alias("varying"), F.count_if(~F.col("varying")).alias("constant"), F.sum(F.when(F.col("varying"), F.col("length")).otherwise(0)).alias("cells"))


def encode(size: tuple[int, int, int], runs: list[tuple], origin: tuple[float, float, float] = (0.0, 0.0, 0.0), resolution: float = 1.0) -> bytes:
    """One file's bytes from its runs (y, z, length, varying, [(value, weight), ..]) in order; longest run 32766 cells."""
    by_line: dict[tuple[int, int], list] = {}
    for y, z, length, varying, items in runs:
        by_line.setdefault((z, y), []).append((length, varying, items))
    words: list[int] = []
    lengths = elements = 0
    for z in range(size[2]):
        for y in range(size[1]):
            for length, varying, items in by_line.get((z, y), []):
                words.append(length | VARYING if varying else length)
                words += [w for item in items for w in item]
                lengths += 2
                elements += 4 * len(items)
            words.append(END)
            lengths += 2
    head = np.zeros(1, HEAD)
    head["size"], head["origin"], head["resolution"], head["lengths"], head["elements"] = size, origin, resolution, lengths, elements
    return head.tobytes() + np.array(words, ">u2").tobytes()


def write(files: DataFrame, folder: str) -> None:
    """Grid files from (name, size, runs, origin, resolution) rows: each is put into the shared folder by the task that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.itertuples():
                runs = [(q["y"], q["z"], q["length"], q["varying"], [(e["value"], e["weight"]) for e in q["items"]]) for q in row.runs]
                with fs.open_output_stream(f"{base}/{row.name}") as out:
                    out.write(encode(tuple(row.size), runs, tuple(row.origin), row.resolution))
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "size", "runs", "origin", "resolution").mapInPandas(run, "n long").agg(F.sum("n")).collect()
