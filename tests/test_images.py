import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from plumbline.functions import image_bytes, pixels
from plumbline.operators.incremental import Target
from plumbline.plans.audit import audit_index
from plumbline.plans.findings import Config, all_checks
from plumbline.sources import images
from plumbline.sources.images import LoaderError, load, with_features

from .images import bmp, defective, jpeg, png, put, texture, with_exif


def test_signatures_survive_resizing_and_recompression(spark):
    rng = np.random.default_rng(4)
    a, b = texture(rng, 128), texture(rng, 128)
    small = pixels.resize(a, 80, 80, "bilinear").astype(np.uint8)
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    h = [pixels.signatures(x) for x in (a, small, b)]
    assert bits(h[0]["phash"], h[1]["phash"]) <= 6 and bits(h[0]["dhash"], h[1]["dhash"]) <= 10
    assert bits(h[0]["phash"], h[2]["phash"]) > 12
    v = [np.array(pixels.edge_vector(x)) for x in (a, small, b)]
    assert v[0] @ v[1] >= 0.65 > v[0] @ v[2]


def test_statistics():
    black, white = np.zeros((5, 7, 3), np.uint8), np.full((5, 7, 3), 255, np.uint8)
    s = pixels.statistics(black, 8)
    assert s["contrast"] == s["entropy"] == s["saturation"] == s["sharpness"] == s["edge_density_target"] == 0 and s["clipped_frac"] == 1
    assert abs(pixels.statistics(white)["mean_r"] - 1) < 1e-6
    half = np.concatenate([black, white], 1)
    assert abs(pixels.statistics(half)["entropy"] - 1) < 1e-6 and pixels.statistics(half)["edge_density"] > 0
    v = pixels.views(half)
    assert len(v["thumb"]) == 192 and len(v["border"]) == 108
    assert pixels.statistics(np.zeros((1, 1, 3), np.uint8))["sharpness"] == 0
    assert pixels.statistics(np.zeros((1500, 3, 3), np.uint8))["contrast"] == 0


def test_bytes(spark):
    a = texture(np.random.default_rng(1))
    for q in (0.5, 0.75, 0.95):
        d = image_bytes.describe(jpeg(spark, a, q))
        assert abs(d["jpeg_quality"] - 100 * q) <= 5 and (d["width"], d["height"], d["mode"]) == (96, 96, "RGB")
    d = image_bytes.describe(with_exif(jpeg(spark, a), 6))
    assert (d["exif_orientation"], d["camera_model"]) == (6, "Cam 1")
    assert image_bytes.describe(png(a[:, :, 0]))["mode"] == "L"
    assert image_bytes.describe(bmp(a))["format"] == "BMP"
    gif = b"GIF89a\x02\x00\x01\x00\x00\x00\x00" + (b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00") * 2 + b";"
    assert image_bytes.describe(gif)["n_frames"] == 2
    for broken in (b"", b"nothing", jpeg(spark, a)[:-40], png(a)[:200], gif[:20], b"BM", b"II*\x00"):
        try:
            image_bytes.describe(broken)
        except ValueError:
            continue
        assert broken == b"II*\x00"


def test_end_of_jpeg(spark, tmp_path):
    """The main image's end counts, not the last bytes of the file."""
    root, whole = str(tmp_path / "d"), jpeg(spark, texture(np.random.default_rng(1)))
    thumbnail = jpeg(spark, texture(np.random.default_rng(2), 24))
    segment = lambda body: b"\xff\xe2" + (len(body) + 2).to_bytes(2, "big") + body
    framed = whole[:2] + segment(thumbnail) + whole[2:]
    complete = {"zeros": whole + bytes(5000), "video": whole + b"\x00\x00\x00\x18ftypmp42" * 40, "second": whole + thumbnail[:-200], "filled": whole[:-2] + b"\xff\xff" + whole[-2:], "framed": framed}
    cut = {"thumbnail": framed[: 2 + 4 + len(thumbnail)], "inside": framed[: 6 + len(thumbnail) - 1], "late": whole[:-40] + segment(thumbnail), "start": whole[:2] + b"\xff\xd9", "open": whole[:-2]}
    for name, data in (complete | cut).items():
        put(root, f"train/{'a' if name in complete else 'b'}/{name}.jpg", data)
        if name in complete:
            assert image_bytes.describe(data)["width"] == 96
        else:
            with pytest.raises(ValueError):
                image_bytes.describe(data)
    rows = {r.relpath.split("/")[-1][:-4]: r for r in with_features(load(spark, root)).df.collect()}
    assert {n for n, r in rows.items() if r.readable} == set(complete)
    assert rows["zeros"].phash == rows["framed"].phash is not None


def test_folders(spark, tmp_path):
    root = str(tmp_path / "d")
    a = png(texture(np.random.default_rng(1), 20))
    for rel in ("Train/D/CD/1.png", "Train/D/CD/2.PNG", "valid/UD/3.png", "valid/UD/Thumbs.db", "Train/loose.png", "other/x/4.png", "readme.md", ".hidden", "Train/.git/5.png", "Train/__MACOSX/6.png", "my_report_assets/7.png"):
        put(root, rel, a)
    os.makedirs(f"{root}/valid/EMPTY")
    index = load(spark, root)
    assert index.layout == "split-folders"
    got = {(r.relpath, r.label, r.split, r.domain) for r in index.df.collect()}
    assert got == {("Train/D/CD/1.png", "CD", "train", "D"), ("Train/D/CD/2.PNG", "CD", "train", "D"), ("valid/UD/3.png", "UD", "val", None)}
    assert {tuple(r) for r in index.stray.collect()} == {("valid/UD/Thumbs.db", "not an image file"), ("Train/loose.png", "image not inside a class folder"), ("readme.md", "outside the split folders"), ("other/", "folder outside the split folders (ignored)")}
    assert {tuple(r) for r in index.class_counts.collect()} == {("CD", 2), ("UD", 1), ("EMPTY", 0)}
    assert index.labels == ["CD", "UD"] and index.splits == ["train", "val"]
    flat = load(spark, root, splits="none")
    assert flat.layout == "class-folders" and ("Train/D/CD/1.png", "CD", None, "Train/D") in {(r.relpath, r.label, r.split, r.domain) for r in flat.df.collect()}
    with pytest.raises(LoaderError):
        load(spark, root + "/nothing")
    os.makedirs(f"{root}/valid/none/deep")
    with pytest.raises(LoaderError):
        load(spark, root + "/valid/none")


def test_manifest(spark, tmp_path):
    root = str(tmp_path)
    put(root, "img/p1_1.png", png(texture(np.random.default_rng(1), 20)))
    put(root, "labels.csv", "﻿Path, LABEL ,Split,domain\nimg/p1_1.png,a,Valid,\nimg/p2_2.png,,holdout,lab\nimg/p3.png,b,,\n".encode())
    index = load(spark, root, group_regex=r"^(?P<group>p\d)_(?P<n_o>\d)")
    rows = sorted((r.relpath, r.label, r.split, r.group, r.domain) for r in index.df.collect() if r.label)
    assert rows == [("img/p1_1.png", "a", "val", "p1", None), ("img/p3.png", "b", None, None, None)]
    assert index.layout == "manifest" and index.groups_declared
    done = {r.relpath: r.error for r in with_features(index).df.collect()}
    assert done == {"img/p1_1.png": None, "img/p2_2.png": "file not found", "img/p3.png": "file not found"}
    with pytest.raises(LoaderError):
        load(spark, root, group_regex="no group")
    with pytest.raises(LoaderError):
        load(spark, root, splits="missing.csv")


def test_features_and_cache(spark, tmp_path):
    root, cache = str(tmp_path / "d"), f"file://{tmp_path}/cache"
    defective(spark, root)
    put(root, "train/cracked/a b%.png", png(texture(np.random.default_rng(9))[:, :, 0]))
    index = with_features(load(spark, root), 64, cache)
    rows = {r.relpath: r for r in index.df.collect()}
    assert rows["train/cracked/empty.jpg"].error == "zero-byte file" and rows["train/uncracked/truncated.jpg"].error.startswith("DecodeError")
    assert sum(not r.readable for r in rows.values()) == 2
    r = rows["train/uncracked/really_png.jpg"]
    assert (r.ext_format, r.magic_format, r.format) == ("JPEG", "PNG", "PNG")
    assert rows["train/cracked/rotated.jpg"].exif_orientation == 6
    gray = rows["train/cracked/a b%.png"]
    assert gray.readable and gray["mode"] == "L" and gray.saturation == 0 and len(gray.thumb) == 192 and gray.edge_density_target is not None
    assert rows["test/cracked/dup_exact.jpg"].sha256 == rows["train/cracked/origin.jpg"].sha256
    again = with_features(load(spark, root), 64, cache)
    assert sorted(map(str, again.df.collect())) == sorted(map(str, index.df.collect()))
    assert Target(spark, cache).version() == 1  # nothing was read again
    put(root, "val/cracked/new.png", png(texture(np.random.default_rng(10))))
    assert with_features(load(spark, root), 64, cache).df.where("readable").count() == sum(r.readable for r in rows.values()) + 1
    assert Target(spark, cache).version() == 2


def deep_png(a, kinds=(0,)):
    """A PNG of 16-bit grey values, row by row predicted in the given ways."""
    rows, above, out = np.ascontiguousarray(a, ">u2").view(np.uint8).reshape(len(a), -1), None, b""
    for y, row in enumerate(rows.astype(int)):
        above = np.zeros_like(row) if above is None else above
        left, corner = np.r_[0, 0, row[:-2]], np.r_[0, 0, above[:-2]]
        far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
        paeth = np.choose(far.argmin(0), [left, above, corner])
        kind = kinds[y % len(kinds)]
        out += bytes([kind]) + ((row - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], len(a), 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def deep_tiff(a, order="<"):
    entries = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8 + 2 + 12 * 8 + 4), (277, 3, 1), (279, 4, 2 * a.size)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(entries))
    for tag, kind, v in entries:
        head += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
    return head + struct.pack(order + "I", 0) + np.ascontiguousarray(a, order + "u2").tobytes()


def test_deep_grey_is_spread_over_its_range(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = (rng.integers(0, 300, (40, 33)) + 1000).astype(np.uint16)  # of 65,536 levels, all near 1,000
    want = np.floor((a - a.min()) * (255 / np.ptp(a)) + 1e-9).astype(np.uint8)
    for data in (deep_png(a), deep_png(a, (1, 2, 3, 4, 0)), deep_tiff(a), deep_tiff(a, ">")):
        assert (image_bytes.deep_gray(data) == want).all()
        with pytest.raises(ValueError):
            image_bytes.deep_gray(data[:-300] if data[1:4] != b"PNG" else data[:60] + data[-12:])
    assert (image_bytes.deep_gray(deep_png(np.full((3, 3), 7))) == 0).all() and image_bytes.deep_gray(png(np.zeros((4, 4, 3), np.uint8))) is None
    root = str(tmp_path)
    for name, data in (("a.png", deep_png(a, (4, 3))), ("b.tif", deep_tiff(a)), ("c.png", png(want))):
        put(root, f"x/{name}", data)
    rows = {r.relpath: r for r in with_features(load(spark, root), 16).df.collect()}
    assert all(r.readable for r in rows.values()) and rows["x/a.png"]["mode"] == "I;16"
    for name in ("x/a.png", "x/b.tif"):
        for column in ("brightness", "contrast", "entropy", "phash", "dhash", "thumb", "edge_density_target"):
            assert rows[name][column] == rows["x/c.png"][column]


def test_kinds_without_a_decoder_are_no_broken_files(spark, tmp_path):
    root = str(tmp_path)
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8 " + struct.pack("<I", 18) + bytes(6) + struct.pack("<HH", 64, 48) + bytes(8)
    put(root, "x/a.webp", webp)
    put(root, "x/b.png", png(texture(np.random.default_rng(1), 20)))
    put(root, "y/c.png", b"no picture")
    index = with_features(load(spark, root))
    rows = {r.relpath: r for r in index.df.collect()}
    assert rows["x/a.webp"].error == "NoDecoder: WEBP" and (rows["x/a.webp"].width, rows["x/a.webp"].readable) == (64, False)
    found = [(x.severity.name, x.metric) for x in audit_index(index, config=Config({"checks": {"disable": [c for c in all_checks() if c != "int.unreadable"]}})).all_findings]
    assert found == [("BLOCKER", {"unreadable": 1, "pct": 33.33}), ("INFO", {"undecoded": 1})]


def test_only_pending_files_are_read(spark, tmp_path, monkeypatch):
    root, cache = str(tmp_path / "d"), f"file://{tmp_path}/cache"
    a = lambda k: png(texture(np.random.default_rng(k), 20))
    for k in range(12):
        put(root, f"x/{k}.png", a(k))
    put(root, "x/with [a-c]* {d}?+%41.png", a(20))
    read, plain = [], images._source
    monkeypatch.setattr(images, "_source", lambda spark, kind, paths: read.append(sorted(paths)) or plain(spark, kind, paths))
    assert with_features(load(spark, root), None, cache).df.where("readable").count() == 13
    read.clear()
    put(root, "x/new.png", a(30))
    put(root, "x/3.png", a(31))  # a new state of a known file
    before = {r.path: r.sha256 for r in with_features(load(spark, root), None, cache).df.collect()}
    assert read == [[f"{root}/x/3.png", f"{root}/x/new.png"]] * 2 and len(before) == 14
    read.clear()
    assert {r.path: r.sha256 for r in with_features(load(spark, root), None, cache).df.collect()} == before and not read
    kept = Target(spark, cache).read(T.StructType.fromDDL("key string, version string"))
    assert kept.count() == kept.select("key").distinct().count() == 14
    assert with_features(load(spark, root), 32, cache).df.where("edge_density_target IS NOT NULL").count() == 14
    files = load(spark, root).df.select("path", "bytes")
    monkeypatch.setattr(images, "PATHS", 5)  # more than that: the folder if half of it is wanted
    assert images.to_read(files) == [f"{root}/x"]
    assert sorted(images.to_read(files.where("path < 'y'").orderBy("path").limit(6))) == sorted(r.path for r in files.orderBy("path").limit(6).collect())
    assert images.extract(files).where("readable").count() == 14
