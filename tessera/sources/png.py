"""PNG images as pixel rows: 8 and 16 bits, grey or colour, not interlaced."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(content):
        size = struct.unpack(">I", content[at : at + 4])[0]
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A scanline's bytes from its differences; step: bytes of a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:  # the nearest of the three to left + up - corner
            p = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda x, p=p: abs(p - x))
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode(content: bytes) -> np.ndarray:
    """(rows, columns, channels)."""
    parts = list(_chunks(content))
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if bits not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError("only PNG images of 8 or 16 bits without palette and interlacing are read")
    step = CHANNELS[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body for name, body in parts if name == b"IDAT")), np.uint8).reshape(height, 1 + width * step)
    rows, above = [], np.zeros(width * step, np.uint8)
    for line in raw:
        above = _unfiltered(int(line[0]), line[1:], above, step)
        rows.append(above)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint8)
    return (flat.view(">u2") if bits == 16 else flat).astype(np.int32).reshape(height, width, CHANNELS[colour])


def encode(image: np.ndarray) -> bytes:
    """A grey image (rows, columns) of 16 bits."""
    height, width = image.shape
    raw = np.zeros((height, 1 + 2 * width), np.uint8)
    raw[:, 1:] = image.astype(">u2").view(np.uint8).reshape(height, 2 * width)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 1)) + part(b"IEND", b"")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, values): a row for each pixel that isn't all 0; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                image = decode(content)
                y, x = np.nonzero(image.any(2))
                yield pd.DataFrame({"path": p, "y": y, "x": x, "values": list(image[y, x])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y int, x int, values array<int>")


def depths(spark: SparkSession, path: str, most: float = 30.0) -> DataFrame:
    """(path, y, x, depth): depth maps of 16 bits, 65535 being ``most``; 0 is no depth and has no row."""
    return read(spark, path).select("path", "y", "x", (F.col("values")[0] * (most / 65535)).alias("depth"))


def write_depths(pixels: DataFrame, folder: str, rows: int, columns: int, most: float = 30.0) -> None:
    """Pixels (frame, y, x, depth) as <frame>.png in the shared folder: a frame is one group and one file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        image = np.zeros((rows, columns), np.int64)
        image[pdf["y"], pdf["x"]] = np.clip(np.round(pdf["depth"] * (65535 / most)), 0, 65535)
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{int(pdf['frame'].iloc[0])}.png") as out:
            out.write(encode(image))
        return pd.DataFrame({"n": [len(pdf)]})

    pixels.select("frame", "y", "x", "depth").groupBy("frame").applyInPandas(run, "n long").agg(F.sum("n")).collect()
