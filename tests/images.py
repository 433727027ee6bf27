"""Image files made without an image library."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np


def png(a: np.ndarray, extra: bytes = b"") -> bytes:
    """8-bit gray or RGB."""
    a = np.asarray(a, np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\x00" + row.tobytes() for row in a)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    rows = b"".join(r[:, ::-1].tobytes() + b"\x00" * (-3 * w % 4) for r in np.asarray(a, np.uint8)[::-1])
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def jpeg(spark, a: np.ndarray, quality: float = 0.9) -> bytes:
    """By the JVM's encoder."""
    jvm = spark._jvm
    h, w = a.shape[:2]
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png(a))))
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    image.getGraphics().drawImage(source, 0, 0, None)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    p = writer.getDefaultWriteParam()
    p.setCompressionMode(2)
    p.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), p)
    stream.close()
    return bytes(out.toByteArray())


def with_exif(data: bytes, orientation: int, model: bytes = b"Cam 1\x00") -> bytes:
    """A JPEG with an APP1 segment after its start."""
    entries = struct.pack("<HHIHH", 274, 3, 1, orientation, 0) + struct.pack("<HHII", 272, 2, len(model), 8 + 2 + 24 + 4)
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 2) + entries + struct.pack("<I", 0) + model
    body = b"Exif\x00\x00" + tiff
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]


def texture(rng: np.random.Generator, size: int = 96) -> np.ndarray:
    """A smooth random colour field with three rectangles."""
    from plumbline.functions.pixels import resize

    a = resize(rng.integers(0, 256, (6, 6, 3)), size, size, "lanczos").astype(np.uint8)
    for _ in range(3):
        y, x = rng.integers(0, max(1, size - 20), 2)
        a[y : y + rng.integers(8, 20), x : x + rng.integers(8, 20)] = rng.integers(0, 256, 3)
    return a


def crack(rng: np.random.Generator, size: int = 96) -> np.ndarray:
    a = texture(rng, size)
    y = int(rng.integers(10, size - 10))
    for x in range(size):
        y = int(np.clip(y + rng.integers(-1, 2), 1, size - 2))
        a[y : y + 2, x] = 15
    return a


def put(root, rel: str, data: bytes) -> str:
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def clean(spark, root, per_class: int = 20, splits: bool = True) -> None:
    rng = np.random.default_rng(1)
    for label in ("cracked", "uncracked"):
        for k in range(per_class):
            a = crack(rng) if label == "cracked" else texture(rng)
            split = "train" if k < 0.7 * per_class else "val" if k < 0.85 * per_class else "test"
            put(root, f"{split + '/' if splits else ''}{label}/{rng.integers(10**9):09d}.jpg", jpeg(spark, a))


def defective(spark, root) -> None:
    """:func:`clean` with one of each defect."""
    from plumbline.functions.pixels import resize

    clean(spark, root)
    rng = np.random.default_rng(2)
    base = crack(rng)
    data = jpeg(spark, base)
    put(root, "train/cracked/origin.jpg", data)
    put(root, "test/cracked/dup_exact.jpg", data)
    near = crack(rng)
    put(root, "train/cracked/near_origin.jpg", jpeg(spark, near))
    put(root, "test/cracked/dup_near.jpg", jpeg(spark, resize(near, 80, 80, "bilinear").astype(np.uint8), 0.7))
    other = jpeg(spark, crack(rng))
    put(root, "train/cracked/conflict_origin.jpg", other)
    put(root, "train/uncracked/conflict.jpg", other)
    put(root, "train/uncracked/truncated.jpg", data[:300])
    put(root, "train/cracked/empty.jpg", b"")
    put(root, "train/uncracked/really_png.jpg", png(texture(rng)))
    put(root, "val/uncracked/blank.jpg", jpeg(spark, np.zeros((96, 96, 3), np.uint8)))
    put(root, "val/cracked/tiny.jpg", jpeg(spark, texture(rng, 24)[:16, :16]))
    put(root, "train/cracked/notes.txt", b"x")
    put(root, "train/cracked/.DS_Store", b"x")
    put(root, "train/cracked/rotated.jpg", with_exif(jpeg(spark, crack(rng)), 6))
