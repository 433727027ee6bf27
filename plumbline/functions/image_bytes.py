"""What the bytes of an image file tell without decoding its pixels."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard luminance quantization table (quality 50).
STANDARD_LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_PER_VALUE = 100 / 64 / np.sort(np.array(STANDARD_LUMINANCE, float))
ORIENTATION, MODEL = 274, 272


def magic_format(content: Column) -> Column:
    """The format the first bytes announce; null if none."""
    head = F.hex(F.substring(content, 1, 16))
    # The signatures of the formats.
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "GIF")
        .when(head.startswith("424D"), "BMP")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    )


def jpeg_quality(table: list[int]) -> float | None:
    """The quality setting, 1 to 100, whose scale of the standard table is the mean scale of this one; both are compared by size, so the order of
    their values doesn't matter."""
    if len(table) != 64:
        return None
    scale = float(np.sort(table) @ _PER_VALUE)  # in percent
    return round(float(np.clip(100 - scale / 2 if scale <= 100 else 5000 / scale, 1, 100)), 1)


def exif_tags(tiff: bytes) -> dict[int, object]:
    """Orientation and camera model from the first directory of a TIFF structure."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict[int, object] = {}
    if order is None or len(tiff) < 8:
        return out
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return out
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        if tag == ORIENTATION and kind == 3:
            out[tag] = struct.unpack_from(order + "H", tiff, entry + 8)[0]
        elif tag == MODEL and kind == 2:
            start = entry + 8 if count <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            out[tag] = tiff[start : start + count].decode("latin-1").strip("\x00 ") or None
        elif kind in (3, 4) and tag in (256, 257, 258, 262, 277):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, entry + 8)[0]
    return out


#: A marker of a JPEG, with bytes that fill up before it. In coded data FF 00 stands for FF, and D0 to D7 only restart the decoder.
_MARKER, _AFTER_SCAN = re.compile(rb"\xff+([^\x00\xff])"), re.compile(rb"\xff+([^\x00\xff\xd0-\xd7])")


def _jpeg(data: bytes) -> dict:
    """Segments and scans up to the end marker of the main image; whatever follows it doesn't matter, and neither do end markers within
    segments, such as those of a thumbnail."""
    out: dict = {"format": "JPEG", "n_frames": 1}
    at, scans = 2, 0
    while True:
        found = (_AFTER_SCAN if scans else _MARKER).search(data, at)
        if found is None:
            raise ValueError("image file is truncated")
        at, marker = found.end() - 2, found.group(1)[0]
        if marker == 0xD9:
            if not scans:
                raise ValueError("image file is truncated")
            break
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                if number == 0 and len(body) >= k + 1 + n:
                    out["jpeg_quality"] = jpeg_quality(list(struct.unpack_from(">64H" if wide else ">64B", body, k + 1)))
                k += 1 + n
        elif marker == 0xE1 and body[:6] == b"Exif\x00\x00":
            out["exif"] = exif_tags(body[6:])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["mode"] = {1: "L", 3: "RGB", 4: "CMYK"}.get(body[5])
        scans += marker == 0xDA
        at += 2 + size
    return out


def _png(data: bytes) -> dict:
    out: dict = {"format": "PNG", "n_frames": 1}
    at, ended = 8, False
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) >= 13:
            out["width"], out["height"], depth, color = struct.unpack_from(">IIBB", body)
            gray = "1" if depth == 1 else "I;16" if depth == 16 else "L"
            out["mode"] = {0: gray, 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color)
        elif kind == b"eXIf":
            out["exif"] = exif_tags(body)
        elif kind == b"acTL" and len(body) >= 4:
            out["n_frames"] = struct.unpack_from(">I", body)[0]
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if not ended:
        raise ValueError("image file is truncated")
    return out


def _gif(data: bytes) -> dict:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0)
    frames = 0

    def skip(at: int) -> int:
        while data[at]:
            at += data[at] + 1
        return at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            at = skip(at + 2)
        elif data[at] == 0x2C:
            frames += 1
            local = data[at + 9]
            at = skip(at + 11 + (3 * 2 ** ((local & 7) + 1) if local & 0x80 else 0))
        else:
            raise ValueError("broken block")
    return {"format": "GIF", "mode": "P", "width": width, "height": height, "n_frames": frames}


def _bmp(data: bytes) -> dict:
    width, height = struct.unpack_from("<ii", data, 18)
    bits = struct.unpack_from("<H", data, 28)[0]
    return {"format": "BMP", "mode": {1: "1", 4: "P", 8: "P", 24: "RGB", 32: "RGBA"}.get(bits), "width": width, "height": abs(height), "n_frames": 1}


def _tiff(data: bytes) -> dict:
    tags = exif_tags(data)
    samples, depth = tags.get(277, 1), tags.get(258, 1)
    mode = {1: {1: "1", 16: "I;16"}.get(depth, "L"), 3: "RGB", 4: "RGBA"}.get(samples)
    return {"format": "TIFF", "mode": "P" if tags.get(262) == 3 else mode, "width": tags.get(256), "height": tags.get(257), "n_frames": 1, "exif": tags}


def _webp(data: bytes) -> dict:
    kind = data[12:16]
    if kind == b"VP8X":
        w, h = (1 + int.from_bytes(data[k : k + 3], "little") for k in (24, 27))
        mode = "RGBA" if data[20] & 0x10 else "RGB"
    elif kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        w, h, mode = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
    else:
        w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
        mode = "RGB"
    return {"format": "WEBP", "mode": mode, "width": w, "height": h, "n_frames": 1}


def _unfiltered(raw: bytes, width: int, height: int) -> np.ndarray:
    """The rows of a PNG of 16-bit grey values from its inflated data, each of which names how it was predicted."""
    rows = np.frombuffer(raw, np.uint8)[: height * (2 * width + 1)].reshape(height, 2 * width + 1)
    out = np.zeros((height + 1, 2 * width + 2), np.uint8)  # a row and a pixel of zeros before the first
    for y in range(height):
        kind, now, above = rows[y, 0], rows[y, 1:], out[y]
        line = out[y + 1]
        if kind == 0:
            line[2:] = now
        elif kind == 1:
            line[2:] = np.cumsum(now.reshape(-1, 2), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line[2:] = now + above[2:]
        else:
            a, up = now.tolist(), above.tolist()
            done = [0, 0]
            for k, v in enumerate(a):
                left, over, corner = done[k], up[k + 2], up[k]
                if kind == 3:
                    guess = (left + over) // 2
                else:
                    far = [abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)]
                    guess = (left, over, corner)[far.index(min(far))]
                done.append((v + guess) & 255)
            line[:] = done
    return out[1:, 2:].copy().view(">u2")


def deep_gray(data: bytes) -> np.ndarray | None:
    """The values of a picture of more than 8 bits of grey, spread over 0 to 255 from its least to its largest (all 0 if they are equal): PNG without
    interlacing, and TIFF without compression. None for other pictures. Raises ``ValueError`` if the data is too short."""
    found = None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, packed = 8, []
        while at + 12 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"IHDR":
                width, height, depth, color, _, _, laced = struct.unpack_from(">IIBBBBB", data, at + 8)
                if depth != 16 or color != 0 or laced:
                    return None
            elif kind == b"IDAT":
                packed.append(data[at + 8 : at + 8 + size])
            at += 12 + size
        try:
            raw = zlib.decompress(b"".join(packed))
        except zlib.error as x:
            raise ValueError(f"broken image data: {x}") from x
        if len(raw) < height * (2 * width + 1):
            raise ValueError("image file is truncated")
        found = _unfiltered(raw, width, height)
    elif data[:4] in (b"II*\x00", b"MM\x00*"):
        tags = tiff_lists(data)
        one = lambda tag, usual=None: (tags.get(tag) or [usual])[0]
        if one(258) != 16 or one(277, 1) != 1 or one(259, 1) != 1 or not tags.get(273) or one(339, 1) != 1:
            return None
        width, height = one(256), one(257)
        sizes = tags.get(279) or [2 * width * height]
        raw = b"".join(data[a : a + n] for a, n in zip(tags[273], sizes))
        if len(raw) < 2 * width * height:
            raise ValueError("image file is truncated")
        found = np.frombuffer(raw, ("<" if data[:2] == b"II" else ">") + "u2", width * height).reshape(height, width)
    if found is None:
        return None
    low, span = int(found.min()), int(np.ptp(found))
    return np.floor((found.astype(float) - low) * (255 / span) + 1e-9).astype(np.uint8) if span else np.zeros(found.shape, np.uint8)


def tiff_lists(data: bytes) -> dict[int, list[int]]:
    """The whole-number tags of a TIFF's first directory, each with all its values."""
    order = "<" if data[:2] == b"II" else ">"
    at, out = struct.unpack_from(order + "I", data, 4)[0], {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in (3, 4) and n < len(data):
            code, wide = ("H", 2) if kind == 3 else ("I", 4)
            start = at + 10 + 12 * k if n * wide <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            out[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, start))
    return out


def describe(data: bytes) -> dict:
    """format, mode, width, height, n_frames, exif_orientation, camera_model, jpeg_quality of a file's bytes. Raises ``ValueError`` if no
    known format or cut off."""
    if data[:3] == b"\xff\xd8\xff":
        read = _jpeg
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        read = _png
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        read = _gif
    elif data[:2] == b"BM":
        read = _bmp
    elif data[:4] in (b"II*\x00", b"MM\x00*"):
        read = _tiff
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        read = _webp
    else:
        raise ValueError("cannot identify image data")
    try:
        out = read(data)
    except (struct.error, IndexError) as x:
        raise ValueError("image file is truncated") from x
    tags = out.pop("exif", {})
    out["exif_orientation"], out["camera_model"] = tags.get(ORIENTATION), tags.get(MODEL)
    return out
