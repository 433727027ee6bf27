"""PNG grids of a few example pictures, made on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.pixels import resize
from ..storage import literal, write_bytes

#: Side of a tile, gap between tiles.
TILE, GAP = 128, 4


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    body = b"".join(b"\x00" + row.tobytes() for row in np.ascontiguousarray(rgb, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def tiles(spark: SparkSession, paths: list[str]) -> list[np.ndarray | None]:
    """Each picture fitted into a tile; None if it can't be decoded."""
    if not paths:
        return []
    found = {}
    for r in spark.read.format("image").load(literal(sorted(set(paths)))).select("image.*").collect():  # a few pictures
        if r.width > 0:
            a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
            rgb = np.repeat(a, 3, 2) if r.nChannels == 1 else a[:, :, 2::-1]
            k = TILE / max(r.width, r.height)
            small = resize(rgb, max(1, round(r.height * k)), max(1, round(r.width * k)), "bilinear")
            tile = np.full((TILE, TILE, 3), 255, np.uint8)
            y, x = (TILE - small.shape[0]) // 2, (TILE - small.shape[1]) // 2
            tile[y : y + small.shape[0], x : x + small.shape[1]] = small
            found[r.origin.removeprefix("file://").removeprefix("file:")] = tile
    return [found.get(p) for p in paths]


def grid(pictures: list[np.ndarray | None], columns: int) -> bytes | None:
    """The pictures in rows; a grey tile for one that is missing."""
    if not any(p is not None for p in pictures):
        return None
    step = TILE + GAP
    columns = min(columns, len(pictures))
    out = np.full((-(-len(pictures) // columns) * step + GAP, columns * step + GAP, 3), 238, np.uint8)
    for k, p in enumerate(pictures):
        y, x = k // columns * step + GAP, k % columns * step + GAP
        out[y : y + TILE, x : x + TILE] = 160 if p is None else p
    return png(out)


def save(spark: SparkSession, df: DataFrame, columns: list[str], path: str, most: int, across: int) -> bool:
    """A grid of the pictures whose paths are in ``columns`` of the first ``most`` rows."""
    paths = [r[c] for r in df.orderBy(*columns).select(*columns).limit(most).collect() for c in columns]
    data = grid(tiles(spark, paths), across)
    if data:
        write_bytes(spark, path, data)
    return bool(data)
