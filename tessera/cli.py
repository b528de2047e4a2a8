"""The operators on tables of files: ``python -m tessera.cli <command> --help``.

Tables are Parquet folders; a mesh is a folder with ``vertices`` and ``faces``.
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import boxes as b
from tessera.operators import cameras as c
from tessera.operators import depth as d
from tessera.operators import detect as t
from tessera.operators import learn as n
from tessera.operators import meshtools as mt
from tessera.operators import surface as s
from tessera.operators import volume as v
from tessera.sources import ply


def save_detector(weights: DataFrame, detector: t.Detector, path: str) -> None:
    """A detector as two tables: its weights, and one row of all else."""
    weights.write.parquet(f"{path}/weights")
    fields = [[float(x) for x in detector.template], list(detector.cells), *map(float, (detector.bias, detector.bottom, detector.least_occupied, detector.least_score))]
    weights.sparkSession.createDataFrame([tuple(fields)], "template array<double>, cells array<int>, bias double, bottom double, least_occupied double, least_score double").write.parquet(f"{path}/detector")


def load_detector(spark: SparkSession, path: str) -> tuple[DataFrame, t.Detector]:
    row = spark.read.parquet(f"{path}/detector").first().asDict()
    return spark.read.parquet(f"{path}/weights"), t.Detector(tuple(row.pop("template")), tuple(row.pop("cells")), **row)


def _mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/faces"), spark.read.parquet(f"{path}/vertices")


def _scan(a: argparse.Namespace) -> t.Scan:
    return t.Scan(tuple(a.x), tuple(a.y), (a.step, a.step, math.radians(a.angle)))


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    detector = t.Detector(tuple(a.template), tuple(a.cells), bottom=a.bottom)
    voxels, positives, negatives = (spark.read.parquet(p) for p in (a.volume, a.positives, a.negatives))
    weights, bias, _ = t.train(voxels, _scan(a), detector, positives, negatives, rounds=a.rounds)
    save_detector(weights, t.Detector(tuple(a.template), tuple(a.cells), bias, a.bottom), a.out)


def _detect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    weights, detector = load_detector(spark, a.detector)
    return t.detect(spark.read.parquet(a.volume), _scan(a), weights, detector)


def _write_mesh(spark: SparkSession, a: argparse.Namespace) -> None:
    from tessera.operators import mesh

    faces, vertices = s.indexed(s.extract(spark.read.parquet(a.volume), a.least_weight))
    new = mesh.compact(faces.withColumns({f"v{k}": F.shiftrightunsigned(f"v{k}", 1) for k in range(3)}))
    numbered = vertices.withColumn("vid", F.shiftrightunsigned("vid", 1)).join(new, "vid").select(F.col("new").alias("vid"), "x", "y", "z")
    halves = faces.withColumns({f"v{k}": F.shiftrightunsigned(f"v{k}", 1) for k in range(3)})
    ply.write(numbered, mesh.flatten(halves, new.withColumnRenamed("new", "target")), a.out)


def _filter(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pixels, cameras = spark.read.parquet(a.pixels), spark.read.parquet(a.cameras)
    return (c.fuse_visibility if a.rule == "visibility" else c.fuse_disparity)(pixels, cameras, a.reference)


def _check(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    faces, vertices = _mesh(spark, a.mesh)
    boxes, pixels, cameras = (spark.read.parquet(p) for p in (a.boxes, a.pixels, a.cameras))
    return c.clean_mesh(faces, vertices, boxes, pixels, cameras, sky_limit=a.sky_limit)


COMMANDS = {
    "fuse": (["observations"], lambda spark, a: v.fuse(spark.read.parquet(a.observations))),
    "integrate": (["pixels", "cameras"], lambda spark, a: c.integrate(spark.read.parquet(a.pixels), spark.read.parquet(a.cameras), length=a.length)),
    "merge": (["volumes"], lambda spark, a: v.merge(*[spark.read.parquet(p) for p in a.volumes.split(",")])),
    "filter-depth": (["pixels", "cameras"], _filter),
    "triangulate": (["pixels"], lambda spark, a: d.triangulate(spark.read.parquet(a.pixels), a.cut)),
    "voxelize": (["mesh"], lambda spark, a: mt.voxelize(*_mesh(spark, a.mesh), a.length, a.ramp)),
    "mesh": (["volume"], _write_mesh),
    "clean": (["volume"], lambda spark, a: s.clean_volume(spark.read.parquet(a.volume), a.least)),
    "check-views": (["mesh", "boxes", "pixels", "cameras"], _check),
    "train": (["volume", "positives", "negatives"], _train),
    "detect": (["volume", "detector"], _detect),
    "suppress": (["boxes"], lambda spark, a: b.suppress(spark.read.parquet(a.boxes), b.nms_pairs(spark.read.parquet(a.boxes)))),
    "cluster": (["cells"], lambda spark, a: n.joint_models(spark.read.parquet(a.cells), a.rounds)[1]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (inputs, _) in COMMANDS.items():
        p = commands.add_parser(name)
        for i in inputs:
            p.add_argument(i)
        p.add_argument("out")
        for option, kind, default in (("length", float, 0.2), ("ramp", float, 1.2), ("cut", float, None), ("least", int, -1), ("least-weight", float, 0.0), ("sky-limit", int, 3), ("reference", int, 0), ("rounds", int, 3), ("step", float, 1.0), ("angle", float, 1.0), ("bottom", float, 0.0)):
            p.add_argument(f"--{option}", type=kind, default=default)
        p.add_argument("--rule", choices=("visibility", "disparity"), default="visibility")
        for option, count, default in (("x", 2, (0.0, 1.0)), ("y", 2, (0.0, 1.0)), ("template", 3, (1.0, 1.0, 1.0))):
            p.add_argument(f"--{option}", type=float, nargs=count, default=default)
        p.add_argument("--cells", type=int, nargs=3, default=(9, 9, 6))
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    out = COMMANDS[a.command][1](spark or SparkSession.builder.getOrCreate(), a)
    if out is not None:
        out.write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()
