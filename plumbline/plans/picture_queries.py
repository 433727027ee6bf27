"""Queries of the functions of bytes and pixels, and of the folder loader, with their SQL. The tables hold no pictures, so pictures are drawn from the
vectors of ``embeddings`` (24 x 24 pixels, each colour a walk through the vector), files with headers of several formats are made of them, and the
paths of the index table, with other files beside them, serve as the listing of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import SPLITS
from ..operators import probes
from ..operators.duplicates import Duplicates
from ..sources import images
from ..storage import cut, table
from .views import IDX

SIDE = 24
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _level(i: Column) -> Column:
    """The place ``i`` of the vector, between its least and largest value, as 0 to 255."""
    v = F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double")
    lo, hi = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return F.coalesce(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255.999), F.lit(0)).cast("int")


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """One decoded picture per vector, as the image source gives it: rows of blue, green and red bytes."""
    pixel = lambda p: F.concat(*[F.lpad(F.hex(_level(F.floor(p / SIDE) * 7 + p % SIDE * 3 + c * 11)), 2, "0") for c in (2, 1, 0)])
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel), ""))
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return v.select(F.col("vec_id").cast("string").alias("path"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(3).alias("nChannels"), data.alias("data"))


def _features(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    seen = pictures(spark, d).mapInPandas(images._pixels(12), images.PIXELS)
    return seen.select(F.col("path").cast("long").alias("vec_id"), *columns)


_PIXELS = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
l AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 255.999::DOUBLE) ELSE 0 END) AS e FROM v),
px AS (SELECT vec_id, y, x, e[(y * 7 + x * 3) % 64 + 1] AS r, e[(y * 7 + x * 3 + 11) % 64 + 1] AS g, e[(y * 7 + x * 3 + 22) % 64 + 1] AS b FROM l, range({SIDE}) a(y), range({SIDE}) c(x)),
g AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM px)"""
_KERNELS = {
    "triangle": ("greatest(0, 1 - abs(t))", 1.0),
    "lanczos": ("CASE WHEN abs(t) >= 3 THEN 0 WHEN abs(t) < 1e-12 THEN 1 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END", 3.0),
    "box": ("CASE WHEN t > -0.5 AND t <= 0.5 THEN 1 ELSE 0 END", 0.5),
}


def _resized(name: str, source: str, height: int, width: int, kernel: str) -> str:
    """CTEs that resample ``source`` (vec_id, y, x, v) first along its rows, then along its columns, each time rounded."""
    f, support = _KERNELS[kernel]

    def weights(n: int) -> str:
        wide = max(SIDE / n, 1.0)
        t = f"(i + 0.5::DOUBLE - (j + 0.5::DOUBLE) * {SIDE / n!r}::DOUBLE) / {wide!r}::DOUBLE"
        return f"SELECT j, i, f / sum(f) OVER (PARTITION BY j) AS w FROM (SELECT j, i, ({f})::DOUBLE AS f FROM (SELECT j, i, {t} AS t FROM range({n}) a(j), range({SIDE}) b(i)) WHERE abs(t) <= {support})"

    once = "least(255, greatest(0, round_even(sum(v * w), 0)))"
    return f""", {name}_wx AS ({weights(width)}), {name}_wy AS ({weights(height)}),
{name}_h AS (SELECT vec_id, y, j AS x, {once} AS v FROM {source} JOIN {name}_wx ON x = i WHERE w <> 0 GROUP BY vec_id, y, j),
{name} AS (SELECT vec_id, j AS y, x, {once} AS v FROM {name}_h JOIN {name}_wy ON y = i WHERE w <> 0 GROUP BY vec_id, x, j)"""


_RINT = ", q AS (SELECT vec_id, y, x, round_even(v, 0) AS v FROM g)"
_EDGES = lambda s: f"SELECT a.vec_id, avg(CASE WHEN sqrt((b.v - a.v) ** 2 + (d.v - c.v) ** 2) > 40 THEN 1.0 ELSE 0 END) AS edges FROM {s} a JOIN {s} b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 2 JOIN {s} c ON c.vec_id = a.vec_id AND c.y = a.y - 1 AND c.x = a.x + 1 JOIN {s} d ON d.vec_id = a.vec_id AND d.y = a.y + 1 AND d.x = a.x + 1 GROUP BY a.vec_id"
_SMALL = "".join(f", {c}0 AS (SELECT vec_id, y, x, {c} AS v FROM px)" + _resized(f"{c}s", f"{c}0", 12, 12, "triangle") for c in "rgb")


@query(
    _PIXELS
    + _SMALL
    + f""", small AS (SELECT vec_id, y, x, 0.299::DOUBLE * rs.v + 0.587::DOUBLE * gs.v + 0.114::DOUBLE * bs.v AS v FROM rs JOIN gs USING (vec_id, y, x) JOIN bs USING (vec_id, y, x)),
e AS ({_EDGES("g")}), es AS ({_EDGES("small")}),
s AS (SELECT a.vec_id, var_pop(b.v + c.v + d.v + f.v - 4 * a.v) AS sharp FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x - 1 JOIN g c ON c.vec_id = a.vec_id AND c.y = a.y AND c.x = a.x + 1
  JOIN g d ON d.vec_id = a.vec_id AND d.y = a.y - 1 AND d.x = a.x JOIN g f ON f.vec_id = a.vec_id AND f.y = a.y + 1 AND f.x = a.x GROUP BY a.vec_id),
h AS (SELECT vec_id, -sum(n / {SIDE * SIDE} * log2(n / {SIDE * SIDE})) AS entropy FROM (SELECT vec_id, floor(v) AS level, count(*)::DOUBLE AS n FROM g GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, round(1e-9::DOUBLE + avg(r) / 255, 5) AS mean_r, round(1e-9::DOUBLE + avg(g) / 255, 5) AS mean_g, round(1e-9::DOUBLE + avg(b) / 255, 5) AS mean_b, round(1e-9::DOUBLE + stddev_pop(r) / 255, 5) AS std_r, round(1e-9::DOUBLE + stddev_pop(g) / 255, 5) AS std_g,
round(1e-9::DOUBLE + stddev_pop(b) / 255, 5) AS std_b, round(1e-9::DOUBLE + avg(v), 4) AS brightness, round(1e-9::DOUBLE + stddev_pop(v), 4) AS contrast, round(1e-9::DOUBLE + avg((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1)), 5) AS saturation,
round(1e-9::DOUBLE + any_value(sharp), 3) AS sharpness, round(1e-9::DOUBLE + any_value(entropy), 5) AS entropy, round(1e-9::DOUBLE + avg(CASE WHEN v <= 2 OR v >= 253 THEN 1.0 ELSE 0 END), 5) AS clipped_frac, round(1e-9::DOUBLE + any_value(e.edges), 5) AS edge_density,
round(1e-9::DOUBLE + any_value(es.edges), 5) AS edge_density_target FROM g JOIN e USING (vec_id) JOIN es USING (vec_id) JOIN s USING (vec_id) JOIN h USING (vec_id) GROUP BY vec_id"""
)
def pixel_statistics(spark: SparkSession, d: str) -> DataFrame:
    places = {"brightness": 4, "contrast": 4, "sharpness": 3}
    return _features(spark, d, *[F.round(F.col(c) + 1e-9, places.get(c, 5)).alias(c) for c in images.NUMBERS])  # ties round up


@query(
    _PIXELS
    + _RINT
    + _resized("p", "q", 32, 32, "lanczos")
    + _resized("s", "q", 8, 9, "lanczos")
    + """, w AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 64) * CASE WHEN k = 0 THEN sqrt(1 / 32::DOUBLE) ELSE sqrt(2 / 32::DOUBLE) END AS w FROM range(8) a(k), range(32) b(i)),
c1 AS (SELECT vec_id, y, k, sum(v * w) AS v FROM p JOIN w ON x = i GROUP BY vec_id, y, k), c2 AS (SELECT vec_id, w.k AS y, c1.k AS x, sum(v * w) AS v FROM c1 JOIN w ON y = i GROUP BY vec_id, w.k, c1.k),
m AS (SELECT vec_id, median(v) AS m FROM c2 GROUP BY vec_id), ph AS (SELECT vec_id, sum(CASE WHEN v > m THEN 1::HUGEINT << (63 - 8 * y - x)::INTEGER ELSE 0 END) AS h FROM c2 JOIN m USING (vec_id) GROUP BY vec_id),
dh AS (SELECT a.vec_id, sum(CASE WHEN b.v > a.v THEN 1::HUGEINT << (63 - 8 * a.y - a.x)::INTEGER ELSE 0 END) AS h FROM s a JOIN s b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 1 GROUP BY a.vec_id)
SELECT vec_id, (CASE WHEN ph.h >= 9223372036854775808 THEN ph.h - 18446744073709551616 ELSE ph.h END)::BIGINT AS phash, (CASE WHEN dh.h >= 9223372036854775808 THEN dh.h - 18446744073709551616 ELSE dh.h END)::BIGINT AS dhash
FROM ph JOIN dh USING (vec_id)"""
)
def pixel_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, "phash", "dhash")


_RGB = "".join(f", {c}0 AS (SELECT vec_id, y, x, {c} AS v FROM px)" + _resized(f"{c}t", f"{c}0", 8, 8, "box") + _resized(f"{c}b", f"{c}0", 10, 10, "box") for c in "rgb")
_LISTED = lambda k: f"SELECT vec_id, 0 AS c, y, x, v FROM r{k} UNION ALL SELECT vec_id, 1, y, x, v FROM g{k} UNION ALL SELECT vec_id, 2, y, x, v FROM b{k}"


@query(
    _PIXELS
    + _RGB
    + f""", t AS (SELECT vec_id, string_agg(v::INTEGER::VARCHAR, ',' ORDER BY y, x, c) AS thumb FROM ({_LISTED("t")}) GROUP BY vec_id),
o AS (SELECT vec_id, string_agg(v::INTEGER::VARCHAR, ',' ORDER BY y, x, c) AS border FROM ({_LISTED("b")}) WHERE y IN (0, 9) OR x IN (0, 9) GROUP BY vec_id) SELECT vec_id, thumb, border FROM t JOIN o USING (vec_id)"""
)
def pixel_views(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, F.array_join(F.col("thumb").cast("array<string>"), ",").alias("thumb"), F.array_join(F.col("border").cast("array<string>"), ",").alias("border"))


@query(
    _PIXELS
    + _RINT
    + _resized("m", "q", 64, 64, "triangle")
    + """, n AS (SELECT vec_id, y, x, (lead(v) OVER r - lag(v) OVER r) / 2 AS dx_, lead(v) OVER r - v AS fx, v - lag(v) OVER r AS bx, (lead(v) OVER c - lag(v) OVER c) / 2 AS dy_, lead(v) OVER c - v AS fy, v - lag(v) OVER c AS by_ FROM m
  WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
s AS (SELECT vec_id, y, x, sqrt(coalesce(dx_, fx, bx) ** 2 + coalesce(dy_, fy, by_) ** 2) AS m FROM n), a AS (SELECT vec_id, avg(m) AS a FROM s GROUP BY vec_id),
z AS (SELECT vec_id, y, x, m - a AS z FROM s JOIN a USING (vec_id)), k AS (SELECT vec_id, sqrt(sum(z * z)) AS k FROM z GROUP BY vec_id)
SELECT a.vec_id, round(sum(a.z * b.z) / any_value(ka.k) / any_value(kb.k), 4) AS correlation FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 AND b.y = a.y AND b.x = a.x JOIN k ka ON ka.vec_id = a.vec_id JOIN k kb ON kb.vec_id = b.vec_id GROUP BY a.vec_id"""
)
def edge_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Of each picture and the next."""
    f = cut(_features(spark, d, "edge_vector"))
    dot = F.aggregate(F.zip_with("edge_vector", "other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("edge_vector").alias("other")), "vec_id").select("vec_id", F.round(dot, 4).alias("correlation"))


# Bytes

#: Hexadecimal files by the number of the vector: {w} and {h} are numbers of four digits, {W} and {H} the same with the low byte first, {o} an orientation, {m} three digits of a name,
#: {t} a quantization table of 64 values.
_FILES = {
    0: "FFD8FFE1003645786966000049492A000800000002001201030001000000{o}0000001001020008000000260000000000000043616D20{m}00FFDB004300{t}FFC0000B08{h}{w}01011100FFDA0008010100003F001234FFD9",
    1: "FFD8FFDB004300{t}FFC0001108{h}{w}03012200021101031101FFDA000C03010002110311003F0012FF00FFD0FFD9AAAA",
    2: "89504E470D0A1A0A0000000D494844520000{w}0000{h}08060000000000000000000000" + "49454E44AE426082",
    3: "474946383961{W}{H}000000" + "2C00000000010001000002024401002C000000000100010000020244010021F90400000000003B",
    4: "424D46000000000000003600000028000000{W}0000{H}0000010018000000000000000000",
    5: "52494646160000005745425056503858" + "0A00000010000000{W}00{H}00",
    6: "FFD8FFDB004300{t}FFC0001108{h}{w}03012200021101031101FFDA000C03010002110311003F0012FF00",
    7: "4E6F7468696E67{m}",
}


def files(spark: SparkSession, d: str) -> DataFrame:
    """A file per vector: vec_id and content."""
    n = F.col("vec_id")
    number = lambda c: F.lpad(F.hex(c), 4, "0")
    swapped = lambda c: F.concat(F.substring(number(c), 3, 2), F.substring(number(c), 1, 2))
    w, h = n % 900 + 20, n % 700 + 30
    parts = {"w": number(w), "h": number(h), "W": swapped(w), "H": swapped(h), "o": F.lpad(F.hex(n % 9), 2, "0"), "m": F.hex(F.lpad((n % 1000).cast("string"), 3, "0").cast("binary"))}
    parts["t"] = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.greatest(F.lit(1), _level(i))), 2, "0")), "")
    out = F
    for k, text in _FILES.items():
        pieces = [parts[x[0]] if i % 2 else F.lit(x) for i, x in enumerate(text.replace("}", "{").split("{")) if x]
        out = out.when(n % 8 == k, F.concat(*pieces))
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.unhex(out).alias("content"))


def _sql_file() -> str:
    """The same files as SQL."""
    parts = {"w": "w4", "h": "h4", "W": "w4[3:4] || w4[1:2]", "H": "h4[3:4] || h4[1:2]", "o": "printf('%02X', vec_id % 9)", "m": "hex(printf('%03d', vec_id % 1000))", "t": "t"}
    cases = []
    for k, text in _FILES.items():
        cases.append(f"WHEN {k} THEN " + " || ".join(f"({parts[x]})" if i % 2 else f"'{x}'" for i, x in enumerate(text.replace("}", "{").split("{")) if x))
    return "CASE vec_id % 8 " + " ".join(cases) + " END"


_STANDARD = sorted(images.image_bytes.STANDARD_LUMINANCE)
_HEADERS = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
l AS (SELECT vec_id, list_transform(e, lambda x: greatest(1, CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 255.999::DOUBLE) ELSE 0 END)::INTEGER) AS e, vec_id % 900 + 20 AS w, vec_id % 700 + 30 AS h FROM v),
x AS (SELECT *, printf('%04X', w) AS w4, printf('%04X', h) AS h4, array_to_string(list_transform(e, lambda k: printf('%02X', k)), '') AS t, vec_id % 8 AS kind FROM l),
f AS (SELECT *, unhex({_sql_file()}) AS content, list_sum(list_transform(list_zip(list_sort(e), {_STANDARD}), lambda p: p[1] / p[2]::DOUBLE)) / 64 * 100 AS scale FROM x)
SELECT vec_id, CASE WHEN kind IN (0, 1, 6) THEN 'JPEG' WHEN kind = 2 THEN 'PNG' WHEN kind = 3 THEN 'GIF' WHEN kind = 4 THEN 'BMP' WHEN kind = 5 THEN 'WEBP' END AS magic_format, sha256(content) AS sha256, octet_length(content) AS bytes,
CASE WHEN kind < 5 THEN w WHEN kind = 5 THEN w + 1 ELSE -1 END::INTEGER AS width, CASE WHEN kind < 5 THEN h WHEN kind = 5 THEN h + 1 ELSE -1 END::INTEGER AS height,
CASE kind WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' WHEN 2 THEN 'RGBA' WHEN 3 THEN 'P' WHEN 4 THEN 'RGB' WHEN 5 THEN 'RGBA' END AS mode, CASE WHEN kind = 3 THEN 2 WHEN kind < 6 THEN 1 ELSE -1 END::INTEGER AS n_frames,
CASE WHEN kind = 0 THEN vec_id % 9 ELSE -1 END::INTEGER AS exif_orientation, CASE WHEN kind = 0 THEN 'Cam ' || printf('%03d', vec_id % 1000) END AS camera_model,
CASE WHEN kind < 2 THEN round(greatest(1, least(100, CASE WHEN scale <= 100 THEN 100 - scale / 2 ELSE 5000 / scale END)), 1) END AS jpeg_quality,
CASE kind WHEN 6 THEN 'DecodeError: image file is truncated' WHEN 7 THEN 'UnidentifiedImageError: cannot identify image data' END AS error FROM f"""


@query(_HEADERS)
def file_headers(spark: SparkSession, d: str) -> DataFrame:
    """What the bytes of whole, cut off and unknown files tell; -1 stands for a number that isn't told."""
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height", "n_frames", "exif_orientation")]
    raw = files(spark, d)
    none = F.lit(None).cast("string")
    raw = raw.select(F.col("vec_id").cast("string").alias("path"), F.length("content").cast("long").alias("bytes"), none.alias("ext"), none.alias("ext_format"), images.image_bytes.magic_format(F.col("content")).alias("magic_format"), F.sha2("content", 256).alias("sha256"), "content")
    return raw.mapInPandas(images._meta, images.META).select(F.col("path").cast("long").alias("vec_id"), "magic_format", "sha256", "bytes", *known, "mode", "camera_model", "jpeg_quality", "error")


@query(f"SELECT mode, count(*) AS n, count(*) FILTER (exif_orientation NOT IN (-1, 1)) AS n_rotated FROM ({_HEADERS}) WHERE error IS NULL GROUP BY mode")
def int_exif_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Files with a rotation flag, by colour mode."""
    return file_headers(spark, d).where("error IS NULL").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("exif_orientation").isin(-1, 1)).alias("n_rotated"))


# Folders


def _listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files of the index table, text files beside some, and some outside the folders of splits or classes; and all folders, one of them empty."""
    t = table(spark, d, "dataset_index", "file_id", "relpath", "bytes", "mtime_ns").where("relpath IS NOT NULL").distinct()
    n = F.col("file_id")
    more = F.array(F.col("relpath"), F.when(n % 7 == 0, F.concat("relpath", F.lit(".txt"))), F.when(n % 11 == 0, F.concat(F.lit("other/x/"), n.cast("string"), F.lit(".png"))), F.when(n % 13 == 0, F.concat(n.cast("string"), F.lit(".jpg"))), F.when(n % 17 == 0, F.concat(F.lit("train/"), n.cast("string"), F.lit(".jpg"))))
    listed = cut(t.select(F.explode(F.array_compact(more)).alias("relpath"), "bytes", "mtime_ns"))
    parts = F.split("relpath", "/")
    above = listed.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("reldir")).distinct()
    above = above.union(spark.createDataFrame([("val/empty",)], "reldir string"))
    inner = above.select(F.regexp_replace("reldir", "/?[^/]*$", "").alias("reldir"), F.lit(False).alias("has")).where("reldir <> ''").distinct()
    return listed, above.join(inner, "reldir", "left").select("reldir", F.coalesce("has", F.lit(True)).alias("leaf"))


def _index(spark: SparkSession, d: str):
    f, dirs = _listing(spark, d)
    top = [r[0] for r in dirs.where("reldir <> '' AND NOT contains(reldir, '/')").select("reldir").orderBy("reldir").collect()]
    return images.from_listing(f, dirs, "/data", [x for x in top if x.lower() in SPLITS])


_LIST = """
WITH t AS (SELECT DISTINCT file_id, relpath FROM dataset_index WHERE relpath IS NOT NULL),
f AS (SELECT relpath FROM t UNION ALL SELECT relpath || '.txt' FROM t WHERE file_id % 7 = 0 UNION ALL SELECT 'other/x/' || file_id || '.png' FROM t WHERE file_id % 11 = 0
  UNION ALL SELECT file_id || '.jpg' FROM t WHERE file_id % 13 = 0 UNION ALL SELECT 'train/' || file_id || '.jpg' FROM t WHERE file_id % 17 = 0),
p AS (SELECT relpath, string_split(relpath, '/') AS p, regexp_matches(lower(relpath), '\\.(jpg|jpeg|png|bmp|gif|tif|tiff|webp)$') AS image FROM f),
k AS (SELECT *, CASE WHEN lower(p[1]) IN ('train', 'training') THEN 'train' WHEN lower(p[1]) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(p[1]) IN ('test', 'testing') THEN 'test' END AS split FROM p)
"""


@query(_LIST + "SELECT relpath, p[-2] AS label, split, nullif(array_to_string(p[2:-3], '/'), '') AS domain FROM k WHERE split IS NOT NULL AND image AND len(p) > 2")
def listing_index(spark: SparkSession, d: str) -> DataFrame:
    """Label, split and domain from the folders of a file."""
    return _index(spark, d).df.select("relpath", "label", "split", "domain")


@query(
    _LIST
    + """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN split IS NULL OR len(p) = 1 THEN 'outside the split folders' WHEN NOT image THEN 'not an image file' WHEN len(p) = 2 THEN 'image not inside a class folder' END AS reason
FROM k WHERE (split IS NOT NULL AND len(p) > 1) OR len(p) = 1 UNION ALL SELECT 'folder outside the split folders (ignored)' FROM (SELECT DISTINCT p[1] FROM k WHERE split IS NULL AND len(p) > 1)) WHERE reason IS NOT NULL GROUP BY reason"""
)
def int_non_image(spark: SparkSession, d: str) -> DataFrame:
    """Stray files by reason."""
    return _index(spark, d).stray.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    _LIST
    + """, c AS (SELECT DISTINCT p[1:-2] AS dir FROM k WHERE len(p) > 1), leaf AS (SELECT dir FROM c WHERE len(dir) > 1 AND lower(dir[1]) IN ('train', 'training', 'val', 'valid', 'validation', 'dev', 'test', 'testing')
  AND NOT EXISTS (SELECT 1 FROM c o WHERE len(o.dir) > len(c.dir) AND o.dir[1:len(c.dir)] = c.dir))
SELECT label, sum(n)::BIGINT AS n FROM (SELECT dir[-1] AS label, (SELECT count(*) FROM k WHERE k.image AND k.p[1:-2] = leaf.dir) AS n FROM leaf UNION ALL SELECT 'empty', 0) GROUP BY label"""
)
def listing_classes(spark: SparkSession, d: str) -> DataFrame:
    """Images per class folder, empty ones too."""
    return _index(spark, d).class_counts


# Duplicates with vectors

_BITS = "SELECT vec_id, {0} FROM embeddings"


def _vectors(spark: SparkSession, d: str) -> Duplicates:
    """Vectors with signatures: which values are above 0, and which are below the next."""
    e = lambda i: F.element_at("embedding", i)
    bit = lambda k, c: F.when(c, F.lit(1 << k if k < 63 else -(2**63)).cast("long")).otherwise(F.lit(0).cast("long"))
    total = lambda bits: sum(bits[1:], bits[0])
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    v = v.select("vec_id", "embedding", F.lit(None).cast("string").alias("content"), total([bit(k, e(k + 1) > 0) for k in range(64)]).alias("h"), total([bit(k, e(k + 2) > e(k + 1)) for k in range(63)]).alias("h2"))
    return Duplicates(v, "vec_id", "content", "h", "h2", 20, 30, vector="embedding", least=0.3)


@query(
    """
WITH RECURSIVE b AS (SELECT vec_id, embedding AS e, array_to_string(list_transform(embedding, lambda x: (x > 0)::INTEGER), '') AS h, array_to_string(list_transform(range(1, 64), lambda k: (embedding[k + 1] > embedding[k])::INTEGER), '') AS h2 FROM embeddings),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE hamming(x.h, y.h) <= 20 AND hamming(x.h2, y.h2) <= 30 AND list_dot_product(x.e::DOUBLE[], y.e::DOUBLE[]) >= 0.3),
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n WHERE r.c < e.b)
SELECT n AS vec_id, min(c) AS component FROM reach GROUP BY n"""
)
def dup_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of vectors with near signatures and a large enough product."""
    return _vectors(spark, d).components.select(F.col("node").alias("vec_id"), "component")


# Pieces of the probes


@query(IDX + "SELECT label, least(count(*), 50) AS n FROM rd WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 5")
def probe_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each class a probe of 50 per class takes; the sample is the feature."""
    from .views import index_view

    rows = probes.subsample(index_view(spark, d, "readable", "label").where("readable"), "label", 50, 42, "file_id")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(IDX + ", c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(magic_format, '(none)') AS v FROM idx)) SELECT coalesce(magic_format, '(none)') AS format, code::DOUBLE AS code, count(*) AS n FROM idx JOIN c ON v = coalesce(magic_format, '(none)') GROUP BY ALL")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    from .views import index_view

    df, code = probes.codes(F.col("magic_format"), index_view(spark, d, "magic_format"))
    return df.groupBy(F.coalesce("magic_format", F.lit("(none)")).alias("format"), code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
