"""PLY meshes: text and binary files of either byte order, read as DataFrames; text written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its type names and NumPy's.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    """(encoding, elements, where the data begins); an element is (name, rows, properties), a property (name, type) or (name, count type, type)."""
    end = content.index(b"end_header")
    start = content.index(b"\n", end) + 1
    encoding, elements = "ascii", []
    for line in content[:end].decode("latin-1").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            encoding = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:2] == ["property", "list"]:
            elements[-1][2].append((word[4], TYPES[word[2]], TYPES[word[3]]))
        elif word[:1] == ["property"]:
            elements[-1][2].append((word[2], TYPES[word[1]]))
    return encoding, elements, start


def _text_rows(content: bytes, start: int, elements: list) -> Iterator[tuple[str, dict[str, list]]]:
    tokens, at = content[start:].split(), 0
    for name, rows, properties in elements:
        columns: dict[str, list] = {p[0]: [] for p in properties}
        for _ in range(rows):
            for p in properties:
                if len(p) == 3:
                    n = int(tokens[at])
                    columns[p[0]].append([int(x) for x in tokens[at + 1 : at + 1 + n]])
                    at += 1 + n
                else:
                    columns[p[0]].append(float(tokens[at]))
                    at += 1
        yield name, columns


def _binary_rows(content: bytes, start: int, elements: list, order: str) -> Iterator[tuple[str, dict[str, list]]]:
    at = start
    for name, rows, properties in elements:
        if all(len(p) == 2 for p in properties):
            kind = np.dtype([(p[0], order + p[1]) for p in properties])
            found = np.frombuffer(content, kind, rows, at)
            at += kind.itemsize * rows
            yield name, {p[0]: found[p[0]].tolist() for p in properties}
            continue
        columns: dict[str, list] = {p[0]: [] for p in properties}
        for _ in range(rows):
            for p in properties:
                if len(p) == 3:
                    n = int(np.frombuffer(content, order + p[1], 1, at)[0])
                    at += np.dtype(p[1]).itemsize
                    columns[p[0]].append(np.frombuffer(content, order + p[2], n, at).tolist())
                    at += n * np.dtype(p[2]).itemsize
                else:
                    columns[p[0]].append(np.frombuffer(content, order + p[1], 1, at)[0].item())
                    at += np.dtype(p[1]).itemsize
        yield name, columns


def parse(content: bytes) -> dict[str, dict[str, list]]:
    """{element: {property: values}} of one file."""
    encoding, elements, start = header(content)
    rows = _text_rows(content, start, elements) if encoding == "ascii" else _binary_rows(content, start, elements, "<" if "little" in encoding else ">")
    return dict(rows)


def _colour(columns: dict[str, list], names: tuple[str, ...], rows: int) -> list:
    return next((columns[n] for n in names if n in columns), [None] * rows)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): a file's lines; within a block (where a piece of the file begins) ``at`` counts without gaps."""
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/")
    return spark.read.text(path).select(place.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _layout(lines: DataFrame) -> tuple[list[tuple], list[tuple]] | None:
    """(blocks, files) of text files with a line for each row of plain vertices and triangles; None where any file is other.

    A block is (path, block, its first ``at``, lines of the file before it), a
    file (path, where vertices begin and end, where faces do, places of x, y,
    z, r, g, b in a vertex' line, 0 where missing).
    """
    head = lines.filter(F.col("value").rlike("^(ply|format|element|property|end_header)\\b")).orderBy("path", "block", "at")
    heads: dict[str, list[str]] = {}
    for p, value in head.select("path", "value").collect():
        if "end_header" not in heads.setdefault(p, []):
            heads[p].append(value.strip())
    end = F.min(F.when(F.trim("value") == "end_header", F.col("at")))
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("low"), end.alias("end"), F.sum((F.trim("value") == "").cast("int")).alias("blank")).orderBy("path", "block").collect()
    blocks, files, length, first = [], [], {}, {}
    for c in counts:
        blocks.append((c["path"], c["block"], c["low"], length.get(c["path"], 0)))
        if c["end"] is not None:
            first.setdefault(c["path"], length.get(c["path"], 0) + c["end"] - c["low"] + 1)
        length[c["path"]] = length.get(c["path"], 0) + c["n"]
        if c["blank"]:
            return None
    for p, n in length.items():
        if p not in first:
            return None
        encoding, elements, _ = header(("\n".join(heads[p]) + "\n").encode())
        if encoding != "ascii" or n - first[p] != sum(rows for _, rows, _ in elements):
            return None
        at, span, places = first[p], {"vertex": (0, 0), "face": (0, 0)}, [0] * 6
        for name, rows, properties in elements:
            span[name] = (at, at + rows)
            at += rows
            names = [q[0] for q in properties]
            if name == "vertex":
                if any(len(q) == 3 for q in properties) or not {"x", "y", "z"} <= set(names):
                    return None
                wanted = [("x",), ("y",), ("z",), ("red", "diffuse_red"), ("green", "diffuse_green"), ("blue", "diffuse_blue")]
                places = [next((names.index(k) + 1 for k in w if k in names), 0) for w in wanted]
            elif name == "face" and (len(properties[0]) != 3 or names[0] not in ("vertex_indices", "vertex_index")):
                return None
        files.append((p, *span["vertex"], *span["face"], *places))
    return blocks, files


def _read_lines(spark: SparkSession, lines: DataFrame, blocks: list[tuple], files: list[tuple]) -> tuple[DataFrame, DataFrame] | None:
    """As ``read``, any number of tasks for a file; None where a face isn't a triangle."""
    places = [f"p{c}" for c in ("x", "y", "z", "r", "g", "b")]
    known = spark.createDataFrame(blocks, "path string, block long, low long, before long").join(spark.createDataFrame(files, "path string, v0 long, v1 long, f0 long, f1 long, " + ", ".join(f"{c} int" for c in places)), "path")
    row = lines.join(F.broadcast(known), ["path", "block"]).withColumn("k", F.col("at") - F.col("low") + F.col("before"))
    row = row.withColumn("t", F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " "))
    face = row.filter("k >= f0 and k < f1")
    if face.filter("t[0] <> '3'").limit(1).count():
        return None
    at = lambda c: F.when(F.col(c) > 0, F.try_element_at("t", F.col(c)).cast("double"))
    vertices = row.filter("k >= v0 and k < v1").select("path", (F.col("k") - F.col("v0")).alias("vid"), *[at(f"p{c}").alias(c) for c in "xyz"], *[at(f"p{c}").cast("int").alias(c) for c in "rgb"])
    return vertices, face.select("path", (F.col("k") - F.col("f0")).alias("fid"), *[F.col("t")[j + 1].cast("long").alias(f"v{j}") for j in range(3)])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, vid, x, y, z, r, g, b), (path, fid, v0, v1, v2)) of PLY files; polygons become fans.

    Text files with a line for each vertex and triangle are read line by line,
    by any number of tasks; a binary or freely laid out file by one task.
    """
    lines = _lines(spark, path)
    layout = _layout(lines)
    found = _read_lines(spark, lines, *layout) if layout and layout[1] else None
    return found or _read_whole(spark, path)


def _read_whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``read``, a file by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                v = parse(content).get("vertex", {"x": [], "y": [], "z": []})
                n = len(v["x"])
                rgb = {c: pd.array(_colour(v, names, n), "Int32") for c, names in zip("rgb", (("red", "diffuse_red"), ("green", "diffuse_green"), ("blue", "diffuse_blue")), strict=True)}
                yield pd.DataFrame({"path": p, "vid": np.arange(n), "x": v["x"], "y": v["y"], "z": v["z"], **rgb})

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                f = parse(content).get("face", {})
                polygons = f.get("vertex_indices", f.get("vertex_index", []))
                fans = [(q[0], q[k], q[k + 1]) for q in polygons for k in range(1, len(q) - 1)]
                corners = np.array(fans, np.int64).reshape(len(fans), 3)
                yield pd.DataFrame({"path": p, "fid": np.arange(len(fans)), **{f"v{k}": corners[:, k] for k in range(3)}})

    return files.mapInPandas(vertices, "path string, vid long, x double, y double, z double, r int, g int, b int"), files.mapInPandas(faces, "path string, fid long, v0 long, v1 long, v2 long")


def write(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh as a PLY text file in the folder ``path``: vertices (vid from 0 on without gaps, x, y, z and perhaps r, g, b), then faces.

    A file is one stream: one task writes it, from sorted rows that spill.
    """
    colours = [c for c in "rgb" if c in vertices.columns]
    names = {"r": "red", "g": "green", "b": "blue"}
    nv, nf = vertices.count(), faces.count()
    head = ["ply", "format ascii 1.0", f"element vertex {nv}", *[f"property double {c}" for c in "xyz"], *[f"property uchar {names[c]}" for c in colours], f"element face {nf}", "property list uchar int vertex_indices", "end_header"]
    text = lambda c: F.col(c).cast("string")
    first = vertices.sparkSession.createDataFrame([(0, i, line) for i, line in enumerate(head)], "part int, at long, value string")
    v = vertices.select(F.lit(1).alias("part"), F.col("vid").cast("long").alias("at"), F.concat_ws(" ", *[text(c) for c in ("x", "y", "z", *colours)]).alias("value"))
    f = faces.select(F.lit(2).alias("part"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("3"), *[text(f"v{k}") for k in range(3)]).alias("value"))
    first.unionByName(v).unionByName(f).repartition(1).sortWithinPartitions("part", "at").select("value").write.text(path)
