"""Indexes of image folders and manifests, and the features of their files."""

from __future__ import annotations

import os
import posixpath
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image_bytes, pixels
from ..functions.vocabulary import IMAGE_EXTENSIONS, SPLITS, trimmed
from ..operators.audits import ext_format
from ..operators.incremental import Target, changed
from ..operators.splitting import group_from_name
from ..storage import _path, cut, literal

#: Bump when a feature changes, so that stored ones are computed anew.
VERSION = "v3"
#: Listed files per piece written to the shared folder.
PIECE = 500_000
#: Folders listed at once.
LISTERS = 16
BASE = ("path", "relpath", "label", "split", "group", "domain")
NUMBERS = ("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "brightness", "contrast", "saturation", "sharpness", "entropy", "clipped_frac", "edge_density", "edge_density_target")
META = "path string, bytes long, ext string, ext_format string, magic_format string, sha256 string, error string, width int, height int, n_frames int, mode string, format string, exif_orientation int, camera_model string, jpeg_quality double"
PIXELS = "path string, decoded boolean, " + ", ".join(f"{n} double" for n in NUMBERS) + ", phash long, dhash long, thumb array<int>, border array<int>, edge_vector array<float>, trouble string"
#: The features of pixels, which may also come from the bytes.
_SEEN = [c.split()[0] for c in PIXELS.split(", ")[2:-1]]
FROM_BYTES = META + ", deep boolean, " + ", ".join(f"deep_{c}" for c in PIXELS.split(", ")[2:-1])
#: How the error of a whole file begins that nothing here can decode.
NO_DECODER = "NoDecoder"
#: Up to so many files are read by their own paths, whatever else is in their folders.
PATHS = 1_000
_FILES = "relpath string, bytes long, mtime_ns long"
_DIRS = "reldir string, leaf boolean"


class LoaderError(ValueError):
    """The folder or manifest can't be loaded."""


@dataclass(frozen=True)
class Index:
    """One row per file in ``df``: path, relpath, label, split, group, domain, bytes, mtime_ns, then features. ``stray``: relpath, reason.
    ``class_counts``: label, n, with the empty classes."""

    root: str
    df: DataFrame
    layout: str
    stray: DataFrame
    class_counts: DataFrame
    groups_declared: bool = False

    @property
    def labels(self) -> list[str]:
        return [r[0] for r in self.df.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]

    @property
    def splits(self) -> list[str]:
        """train, val, test, then others by name."""
        found = [r[0] for r in self.df.where("split IS NOT NULL").select("split").distinct().collect()]
        return sorted(found, key=lambda s: ({"train": 0, "val": 1, "test": 2}.get(s, 3), s))


def _skipped(name: str) -> bool:
    return name.startswith(".") or name == "__MACOSX" or name.endswith("_report_assets")


def _listed(spark: SparkSession, root: str, rel: str):
    """(folder relative to root, subfolders, files with size and time), by name; hidden and tool folders are left out."""
    jpath, fs = _path(spark, f"{root}/{rel}" if rel else root)
    dirs, files = [], []
    if fs.getScheme() == "file":
        with os.scandir(jpath.toUri().getPath()) as entries:
            for e in entries:
                if e.is_dir():
                    dirs.append(e.name)
                else:
                    s = e.stat()
                    files.append((e.name, s.st_size, s.st_mtime_ns))
    else:
        for s in fs.listStatus(jpath):
            name = s.getPath().getName()
            dirs.append(name) if s.isDirectory() else files.append((name, s.getLen(), s.getModificationTime() * 1_000_000))
    return rel, sorted(d for d in dirs if not _skipped(d)), sorted(files)


def _walk(spark: SparkSession, root: str):
    """All folders, level by level; those of a level are listed side by side, as a store's answers take their time."""
    level = [""]
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            below = []
            for rel, dirs, files in pool.map(lambda r: _listed(spark, root, r), level):
                below += [posixpath.join(rel, d) for d in dirs]
                yield rel, dirs, files
            level = below


def listing(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All files (relpath, bytes, mtime_ns) and folders (reldir, leaf). Names alone pass through the driver, in pieces that go to the shared
    folder; empty and hidden files, which file sources leave out, are listed too."""
    files, dirs, out = [], [], []

    def flush():
        out.append((cut(spark.createDataFrame(files, _FILES)), cut(spark.createDataFrame(dirs, _DIRS))))
        files.clear()
        dirs.clear()

    for rel, below, own in _walk(spark, root):
        dirs.append((rel, not below))
        files += [(posixpath.join(rel, n), size, t) for n, size, t in own]
        if len(files) >= PIECE:
            flush()
    flush()
    a, b = out[0]
    for x, y in out[1:]:
        a, b = a.unionByName(x), b.unionByName(y)
    return a, b


def _is_image(c):
    return F.lower(c).rlike(r"\.(" + "|".join(e[1:] for e in IMAGE_EXTENSIONS) + r")$")


def from_listing(files: DataFrame, dirs: DataFrame, root: str, split_dirs: list[str]) -> Index:
    """The index of listed files (relpath, bytes, mtime_ns) and folders (reldir, leaf): the label is the name of a file's folder, the split that of the
    outermost one if it is among ``split_dirs``, the domain what lies between."""
    skip = 1 if split_dirs else 0
    parts = F.split("relpath", "/")
    depth = F.size(parts) - 1 - skip
    inside = F.element_at(parts, 1).isin(split_dirs) & (F.size(parts) > 1) if split_dirs else F.lit(True)
    name = F.element_at(parts, -1)
    image = _is_image(name)
    reason = F.when(~inside, "outside the split folders").when(~image, "not an image file").when(depth == 0, "image not inside a class folder")
    marked = files.withColumn("reason", reason)
    # Top-level files beside the split folders are strays; folders beside them are reported as one.
    top = (F.size(parts) == 1) & ~name.startswith(".") if split_dirs else F.lit(True)
    stray = marked.where(F.col("reason").isNotNull() & (inside | top)).select("relpath", "reason")
    if split_dirs:
        beside = dirs.where((F.col("reldir") != "") & ~F.col("reldir").contains("/") & ~F.col("reldir").isin(split_dirs))
        stray = stray.unionByName(beside.select(F.concat("reldir", F.lit("/")).alias("relpath"), F.lit("folder outside the split folders (ignored)").alias("reason")))
    names = F.create_map(*[F.lit(x) for d in split_dirs for x in (d, SPLITS[d.lower()])]) if split_dirs else None
    between = F.array_join(F.slice(parts, skip + 1, F.greatest(depth - 1, F.lit(0))), "/")
    df = marked.where("reason IS NULL").select(
        F.concat(F.lit(root.rstrip("/") + "/"), "relpath").alias("path"),
        "relpath",
        F.element_at(parts, -2).alias("label"),
        (names[F.element_at(parts, 1)] if split_dirs else F.lit(None).cast("string")).alias("split"),
        F.lit(None).cast("string").alias("group"),
        F.when(between != "", between).alias("domain"),
        "bytes",
        "mtime_ns",
    )
    steps = F.split("reldir", "/")
    classes = dirs.where((F.col("reldir") != "") & F.col("leaf") & (F.size(steps) > skip))
    if split_dirs:
        classes = classes.where(F.element_at(steps, 1).isin(split_dirs))
    n = files.where(image).groupBy(F.regexp_replace("relpath", r"/?[^/]*$", "").alias("reldir")).agg(F.count(F.lit(1)).alias("n"))
    counts = classes.join(n, "reldir", "left").groupBy(F.element_at(steps, -1).alias("label")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return Index(root, df, "split-folders" if split_dirs else "class-folders", stray, counts)


def find_manifest(spark: SparkSession, root: str) -> str | None:
    """The first CSV file by name, directly in the folder, with path and label among its columns."""
    for name, size, _ in _listed(spark, root, "")[2]:
        if name.lower().endswith(".csv") and size:
            columns = spark.read.option("header", True).csv(f"{root}/{name}").columns
            if {"path", "label"} <= {c.strip().lower() for c in columns}:
                return f"{root}/{name}"
    return None


def load_manifest(spark: SparkSession, root: str, manifest: str) -> Index:
    """A CSV manifest; relative paths start at its folder. Null or blank split, group and domain are null; a split in an unknown spelling
    stays as it is."""
    full = manifest if "/" in manifest else f"{root}/{manifest}"
    jpath, fs = _path(spark, full)
    if not fs.exists(jpath):
        jpath, fs = _path(spark, f"{root}/{manifest}")
        if not fs.exists(jpath):
            raise LoaderError(f"manifest not found: {manifest}")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(jpath.toString())
    df = df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])
    if not {"path", "label"} <= set(df.columns):
        raise LoaderError(f"{manifest} needs the columns path and label")
    folder = jpath.getParent().toUri().getPath()
    text = lambda c: F.nullif(trimmed(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    alias = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(folder + "/"), F.regexp_replace("path", r"^(\./)+", "")))
    df = df.where(F.col("path").isNotNull()).select(
        path.alias("path"), F.col("path").alias("relpath"), text("label").alias("label"), F.coalesce(F.try_element_at(alias, F.lower(text("split"))), text("split")).alias("split"), text("group").alias("group"), text("domain").alias("domain")
    )
    counts = df.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    files, _ = listing(spark, root)
    known = files.select(F.concat(F.lit(root.rstrip("/") + "/"), "relpath").alias("path"), "bytes", "mtime_ns")
    df = df.join(known, "path", "left")
    stray = spark.createDataFrame([], "relpath string, reason string")
    declared = not df.where("`group` IS NOT NULL").isEmpty()
    return Index(root, df, "manifest", stray, counts, declared)


def load(spark: SparkSession, root: str, splits: str = "auto", group_regex: str | None = None) -> Index:
    """``auto``: folders of splits, else a manifest, else folders of classes. ``none``: folders of classes, whose outer folders are domains. Any
    other value is the path of a manifest."""
    root = root.rstrip("/")
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(os.path.expanduser(root))
    jpath, fs = _path(spark, root)
    if not fs.exists(jpath) or not fs.getFileStatus(jpath).isDirectory():
        raise LoaderError(f"not a folder: {root}")
    if splits not in ("auto", "none"):
        index = load_manifest(spark, root, splits)
    else:
        top = _listed(spark, root, "")[1]
        split_dirs = [d for d in top if d.lower() in SPLITS] if splits == "auto" else []
        manifest = find_manifest(spark, root) if splits == "auto" and not split_dirs else None
        index = load_manifest(spark, root, manifest) if manifest else from_listing(*listing(spark, root), root, split_dirs)
    if group_regex:
        try:
            group = group_from_name(F.col("path"), group_regex)
        except ValueError as x:
            raise LoaderError(str(x)) from x
        index = replace(index, df=index.df.withColumn("group", group), groups_declared=True)
    if index.df.isEmpty():
        raise LoaderError(f"no images under {root}")
    return index


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Of objects, as 64-bit signatures beside missing ones would otherwise become floats."""
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _features(rgb: np.ndarray, target: int | None) -> dict:
    return pixels.statistics(rgb, target) | pixels.signatures(rgb) | pixels.views(rgb) | {"edge_vector": pixels.edge_vector(rgb)}


def _meta(batches):
    """What the bytes tell, but for deep pictures; see :func:`_bytes`."""
    yield from _bytes(None, deep=False)(batches)


def _bytes(target: int | None, deep: bool = True):
    """What the bytes tell. Pictures of more than 8 bits of grey, whose values other decoders cut off, get their features here."""
    names = [f.split()[0] for f in (FROM_BYTES if deep else META).split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                row = {n: getattr(r, n) for n in ("path", "bytes", "ext", "ext_format", "magic_format", "sha256")} | {"error": None, "deep": False}
                try:
                    data = bytes(r.content)
                    row |= image_bytes.describe(data)
                    if deep and row["mode"] == "I;16" and (gray := image_bytes.deep_gray(data)) is not None:
                        row |= {f"deep_{k}": v for k, v in _features(np.repeat(gray[:, :, None], 3, 2), target).items()} | {"deep": True}
                except ValueError as x:
                    row["error"] = f"{'UnidentifiedImage' if 'identify' in str(x) else 'Decode'}Error: {x}"[:200]
                rows.append(row)
            yield _frame(rows, names)

    return run


def _pixels(target: int | None):
    names = [f.split()[0] for f in PIXELS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                row: dict = {"path": r.path, "decoded": r.width > 0}
                if row["decoded"]:
                    try:
                        a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
                        row |= _features(np.repeat(a, 3, 2) if r.nChannels == 1 else a[:, :, 2::-1], target)
                    except (ValueError, MemoryError) as x:
                        row["trouble"] = f"decoded but could not process pixels: {type(x).__name__}: {x}"[:200]
                rows.append(row)
            yield _frame(rows, names)

    return run


def _plain(c):
    """A source's path without its scheme."""
    return F.regexp_replace(c, r"^file:(//(?=/))?", "")


def _unescaped(c):
    """A path from a URI, in which a plus is itself."""
    return F.when(c.contains("%"), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def to_read(found: DataFrame) -> list[str]:
    """What the sources are told to read for the files ``found``: up to ``PATHS`` files by their own paths. Of more, folders are read as a whole if at
    least half of their images are wanted, and the other files by their paths, so at most twice as many files are read as are wanted."""
    paths = [r.path for r in found.select("path").limit(PATHS + 1).collect()]
    if len(paths) <= PATHS:
        return paths
    spark, folder = found.sparkSession, F.regexp_replace("path", r"/[^/]*$", "").alias("folder")
    wanted = cut(found.select("path", folder))
    n = cut(wanted.groupBy("folder").agg(F.count(F.lit(1)).alias("n")))
    listed = _source(spark, "binaryFile", [r.folder for r in n.collect()]).select(_plain(F.col("path")).alias("path")).where(_is_image(F.col("path")))
    whole = n.join(listed.groupBy(folder).agg(F.count(F.lit(1)).alias("images")), "folder").where("2 * n >= images").select("folder")
    whole = cut(whole)
    rest = wanted.join(whole, "folder", "left_anti").select("path")
    return [r[0] for r in whole.union(rest).collect()]


def _source(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    return spark.read.format(kind).load(literal(paths))


def extract(files: DataFrame, target: int | None = None) -> DataFrame:
    """The features of ``files`` (path, bytes): META and PIXELS columns and readable, one row per file. Only these files are read (see
    :func:`to_read`), once for their bytes and once by the image decoder; both passes end in small rows before anything is joined, so contents
    are never shuffled. Whole files of a kind without a decoder in the JVM (WebP, JPEG in four colours) get what their header tells; their error
    begins with ``NO_DECODER``."""
    spark = files.sparkSession
    paths = to_read(files.where("bytes > 0"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    if paths:
        raw = _source(spark, "binaryFile", paths).where(_is_image(F.col("path")))
        raw = raw.select(_plain(F.col("path")).alias("path"), F.col("length").alias("bytes"), ext.alias("ext"), ext_format(ext).alias("ext_format"), image_bytes.magic_format(F.col("content")).alias("magic_format"), F.sha2("content", 256).alias("sha256"), "content")
        meta = raw.mapInPandas(_bytes(target), FROM_BYTES)
        image = _source(spark, "image", paths).select("image.*").where(_is_image(F.col("origin")))
        image = image.select(_plain(F.col("origin")).alias("path"), "width", "height", "nChannels", "data").mapInPandas(_pixels(target), PIXELS)
        image = image.withColumn("path", _unescaped(F.col("path")))
    else:
        meta, image = spark.createDataFrame([], FROM_BYTES), spark.createDataFrame([], PIXELS)
    out = files.select("path", F.col("bytes").alias("size")).join(meta, "path", "left").join(image, "path", "left")
    deep = F.coalesce("deep", F.lit(False))
    out = out.withColumns({c: F.when(deep, F.col(f"deep_{c}")).otherwise(F.col(c)) for c in _SEEN})
    decoded = F.coalesce("decoded", F.lit(False)) | deep
    error = (
        F.when(F.col("size").isNull(), "file not found")
        .when(F.col("size") == 0, "zero-byte file")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~decoded & ((F.col("format") == "WEBP") | F.coalesce(F.col("mode") == "CMYK", F.lit(False))), F.concat(F.lit(f"{NO_DECODER}: "), "format"))
        .when(~decoded, F.concat(F.lit("DecodeError: no pixels from "), F.coalesce("format", F.lit("unknown"))))
        .when(~deep, F.col("trouble"))
    )
    out = out.withColumns({"error": error, "bytes": F.coalesce("bytes", "size"), "ext": ext, "ext_format": ext_format(ext)})
    out = out.withColumn("sha256", F.when(F.col("size") == 0, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha256")))
    return out.withColumn("readable", F.col("error").isNull()).drop("size", "decoded", "trouble", "deep", *[f"deep_{c}" for c in _SEEN])


def with_features(index: Index, target: int | None = None, cache: str | None = None) -> Index:
    """The index with its features. With a ``cache`` folder, files whose path, size, time, extractor version and target size it holds are taken
    from there; only the others are read, and then published to it in the place of what was known of their earlier states."""
    files = index.df.select("path", "bytes", "mtime_ns").distinct()
    if cache is None:
        features = cut(extract(files.select("path", "bytes"), target))
    else:
        schema = T.StructType.fromDDL("key string, version string, " + META + ", " + PIXELS.split(", ", 2)[2].rsplit(", ", 1)[0] + ", readable boolean")
        store = Target(index.df.sparkSession, cache)
        state = F.when(F.col("bytes").isNotNull() & F.col("mtime_ns").isNotNull(), F.concat_ws("|", F.col("bytes").cast("string"), F.col("mtime_ns").cast("string"), F.lit(VERSION)))
        keyed = cut(files.select("path", "bytes", F.concat("path", F.lit(f"|t{target}")).alias("key"), state.alias("version")))
        base = store.version()
        known = store.read(schema, base)
        todo = cut(changed(keyed, known))
        fresh = None
        if not todo.isEmpty():
            fresh = cut(extract(todo.select("path", "bytes"), target).join(todo.select("path", "key", "version"), "path")).select(*[f.name for f in schema.fields])
            store.publish(fresh.where("version IS NOT NULL"), base, schema)
        features = known.join(keyed.select("key", "version"), ["key", "version"], "left_semi")
        if fresh is not None:
            features = features.unionByName(fresh)
        features = cut(features.drop("key", "version"))
    df = index.df.drop("bytes", "mtime_ns").join(features, "path", "left")
    df = df.withColumn("readable", F.coalesce("readable", F.lit(False)))
    return replace(index, df=cut(df))
