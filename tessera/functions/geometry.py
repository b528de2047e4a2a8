"""Scalar geometry as Column expressions: all of it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for output, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def brick(v: Column | str) -> Column:
    """First voxel of the 8-voxel brick that holds ``v`` (also for negative ones)."""
    return (F.col(v) if isinstance(v, str) else v).bitwiseAND(F.lit(-8))


def in_brick(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).bitwiseAND(F.lit(7))


def brick_hash(x: Column, y: Column, z: Column) -> Column:
    """Spatial hash of a brick: fixed primes over the brick numbers."""
    return (
        (F.shiftright(x, 3).cast("long") * F.lit(73856093).cast("long"))
        .bitwiseXOR(F.shiftright(y, 3).cast("long") * F.lit(19349669).cast("long"))
        .bitwiseXOR(F.shiftright(z, 3).cast("long") * F.lit(83492791).cast("long"))
    )


def to_voxel(p: Column, origin: float, length: float) -> Column:
    return (p - F.lit(float(origin))) / F.lit(float(length))


def to_world(v: Column, origin: float, length: float) -> Column:
    return v * F.lit(float(length)) + F.lit(float(origin))


def snapped_floor(x: Column) -> Column:
    """floor, but up to the next integer from a fraction above 0.9999 on."""
    low = F.floor(x).cast("double")
    return F.when(x - low > 0.9999, low + 1).otherwise(low)


def snap(x: Column) -> Column:
    """The coordinate itself, moved up to the next integer from a fraction above 0.9999 on."""
    return F.when(x - F.floor(x) > 0.9999, F.floor(x) + 1.0).otherwise(x)


def ramp_weight(x: Column, full: float = -0.04, half: float = -0.6, end: float = -1.0, level: float = 0.05) -> Column:
    """Weight of a signed distance: 1 in front, then down to ``level`` at ``half`` and to 0 at ``end``."""
    return (
        F.when(x >= full, F.lit(1.0))
        .when(x >= half, level + (x - half) / (full - half) * (1 - level))
        .when(x >= end, (x - end) / (half - end) * level)
        .otherwise(F.lit(0.0))
    )


def wrap_positive(a: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(a, F.lit(2 * PI))


def wrap_signed(a: Column) -> Column:
    """Into (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def flat_index(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    return (x.cast("long") * ny + y) * nz + z


def unflatten(i: Column, ny: int, nz: int) -> tuple[Column, Column, Column]:
    return F.floor(i / (ny * nz)).cast("long"), F.floor(i / nz).cast("long") % ny, i % nz


def ray(theta: Column, phi: Column, depth: Column) -> tuple[Column, Column, Column]:
    """Point at a depth in the direction (theta from z, phi in the plane)."""
    return depth * F.sin(theta) * F.cos(phi), depth * F.sin(theta) * F.sin(phi), depth * F.cos(theta)


def angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, phi) of a direction with x > 0; null where sin(theta) is 0."""
    n = F.nullif(F.sqrt(x * x + y * y + z * z), F.lit(0.0))
    theta = F.acos(z / n)
    s = F.sin(theta)
    return theta, F.when(s > 0, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / n / F.nullif(s, F.lit(0.0))))))


def angular_disparity(depth: Column, theta: Column, base: float) -> Column:
    return F.lit(PI / 2) + F.atan(-(depth + abs(base) * F.cos(theta)) / (abs(base) * F.sin(theta)))


def depth_error(theta: Column, disparity: Column, base: float, error: Column | float) -> Column:
    s = F.sin(disparity)
    return F.sin(theta) / (s * s) * abs(base) * error


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Coordinates in a frame turned by ``angle``."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def turned(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """The point turned by ``angle``."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def in_box(x: Column, y: Column, z: Column) -> Column:
    """Is the point in the box of the same row (cx, cy, bz, lx, ly, lz, theta)? Faces belong to it."""
    u, v = rotated(x - F.col("cx"), y - F.col("cy"), F.col("theta"))
    return (F.abs(u) <= F.col("lx") / 2) & (F.abs(v) <= F.col("ly") / 2) & (z >= F.col("bz")) & (z <= F.col("bz") + F.col("lz"))


def jet(t: Column) -> tuple[Column, Column, Column]:
    """Piecewise linear rainbow of [0, 1], as bytes."""
    part = lambda c: F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * t - c)))).cast("int")
    return part(3.0), part(2.0), part(1.0)


def sign(x: Column) -> Column:
    """-1 below 0, else 1: 0 counts as positive."""
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def fract(x: Column) -> Column:
    return x - F.floor(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def mix(a: Column, b: Column, share: Column | float) -> Column:
    return a + (b - a) * share


def step(edge: Column | float, x: Column) -> Column:
    return F.when(x < edge, F.lit(0.0)).otherwise(F.lit(1.0))


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp((x - a) / (b - a), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def reflect(v: list[Column], n: list[Column]) -> list[Column]:
    """A direction mirrored at a plane with the unit normal n."""
    d = sum((p * q for p, q in zip(v, n, strict=True)), F.lit(0.0))
    return [p - 2 * d * q for p, q in zip(v, n, strict=True)]


def refract(v: list[Column], n: list[Column], eta: float) -> list[Column]:
    """A unit direction bent at a plane with the unit normal n; zeros where all of it is mirrored."""
    d = sum((p * q for p, q in zip(v, n, strict=True)), F.lit(0.0))
    k = 1 - eta * eta * (1 - d * d)
    bend = eta * d + F.sqrt(F.greatest(k, F.lit(0.0)))
    return [F.when(k < 0, F.lit(0.0)).otherwise(eta * p - bend * q) for p, q in zip(v, n, strict=True)]


def angle_between(v: list[Column], w: list[Column]) -> Column:
    """The angle of two directions, exact also where they are nearly parallel."""
    c = [v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0]]
    return F.atan2(F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]), v[0] * w[0] + v[1] * w[1] + v[2] * w[2])
