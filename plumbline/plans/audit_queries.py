"""Queries of the auditor's own operators over the index table, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audits, probes, relational, splitting, statistics
from ..operators.duplicates import Duplicates, hamming, near_hashes
from ..operators.incremental import done_keys, feature_key
from ..storage import cut, table
from .views import IDX, index_view

HELD = ["val", "test"]
SPLITS = ["train", "val", "test"]
FEATURES = ["width", "height", "bytes", "brightness", "contrast", "entropy", "sharpness"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = IDX + sql
        return f

    return add


# Integrity


@query("SELECT split_part(coalesce(error, 'unknown'), ':', 1) AS reason, count(*) AS n FROM idx WHERE NOT readable GROUP BY 1")
def int_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return audits.error_reasons(index_view(spark, d, "readable", "error"))


_FORMAT = "CASE WHEN lower(ext) IN ('.jpg', '.jpeg') THEN 'JPEG' WHEN lower(ext) = '.png' THEN 'PNG' WHEN lower(ext) = '.bmp' THEN 'BMP' WHEN lower(ext) = '.gif' THEN 'GIF' WHEN lower(ext) IN ('.tif', '.tiff') THEN 'TIFF' WHEN lower(ext) = '.webp' THEN 'WEBP' END"


@query(f"SELECT ext || ' is really ' || magic_format AS mismatch, count(*) AS n FROM rd WHERE magic_format IS NOT NULL AND magic_format IS DISTINCT FROM {_FORMAT} GROUP BY 1")
def int_format_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return audits.format_mismatches(index_view(spark, d, "readable", "ext", "magic_format"))


@query(
    """, n AS (SELECT label, magic_format AS v, count(*) AS n FROM rd WHERE label IS NOT NULL AND magic_format IS NOT NULL GROUP BY ALL),
o AS (SELECT v FROM n GROUP BY v ORDER BY sum(n) DESC, v LIMIT 1)
SELECT label, arg_min(v, (-n, v)) AS dominant, count(*) AS "values", arg_min(v, (-n, v)) <> (SELECT v FROM o) AS odd FROM n GROUP BY label"""
)
def int_mode_mix(spark: SparkSession, d: str) -> DataFrame:
    """Over the format, as the table has no colour mode."""
    return audits.dominant_values(index_view(spark, d, "readable", "label", "magic_format"), "magic_format")


@query("SELECT label, count(*) AS n FROM rd WHERE contrast < 2 OR entropy < 0.5 GROUP BY label")
def int_blank(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts(index_view(spark, d, "readable", "label", "contrast", "entropy").where(F.col("readable") & audits.is_blank()), "label")


@query("SELECT file_id, least(width, height) AS side FROM rd WHERE width < 64 OR height < 64")
def int_tiny(spark: SparkSession, d: str) -> DataFrame:
    """For a target size of 256."""
    return audits.below_size(index_view(spark, d, "readable", "width", "height").where("width IS NOT NULL AND height IS NOT NULL"), max(32, 0.25 * 256)).select("file_id", "side")


@query("SELECT label, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM class_list) FULL JOIN (SELECT label, count(*) AS n FROM idx WHERE label IS NOT NULL GROUP BY label) USING (label)")
def int_empty_class(spark: SparkSession, d: str) -> DataFrame:
    return audits.class_counts(table(spark, d, "class_list", "label"), index_view(spark, d, "label"))


# Leakage


@query("SELECT sha256, min(file_id) AS first, count(*) AS n, count(DISTINCT split) AS n_splits, count(DISTINCT label) AS n_labels FROM rd WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1")
def leak_exact_dup(spark: SparkSession, d: str) -> DataFrame:
    return audits.duplicate_groups(index_view(spark, d, "readable", "sha256", "split", "label"))


@query(
    """SELECT CASE WHEN s > 1 THEN 'cross' ELSE 'within' END AS scope, count(*) AS n_groups, sum(n)::BIGINT AS n_files, sum(n - 1)::BIGINT AS redundant
FROM (SELECT count(*) AS n, count(DISTINCT split) AS s FROM rd WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1) GROUP BY 1"""
)
def leak_exact_dup_summary(spark: SparkSession, d: str) -> DataFrame:
    return audits.duplicate_summary(index_view(spark, d, "readable", "sha256", "split"))


_HASHES = ", h AS (SELECT DISTINCT phash AS p, dhash AS d FROM rd WHERE phash IS NOT NULL AND dhash IS NOT NULL AND NOT coalesce(contrast < 2 OR entropy < 0.5, false))"


@query(_HASHES + ", q AS (SELECT DISTINCT p FROM h) SELECT x.p AS a, y.p AS b, bit_count(xor(x.p, y.p))::INTEGER AS dist FROM q x JOIN q y ON x.p < y.p AND bit_count(xor(x.p, y.p)) <= 8")
def near_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct first signatures at most 8 bits apart."""
    v = index_view(spark, d, "readable", "phash", "dhash", "contrast", "entropy")
    h = v.where(F.col("readable") & F.col("phash").isNotNull() & F.col("dhash").isNotNull() & ~audits.is_blank()).select("phash").distinct()
    return near_hashes(h, "phash", 8)


_VIEW = ("readable", "sha256", "phash", "dhash", "contrast", "entropy", "split", "label")


def _duplicates(spark: SparkSession, d: str) -> Duplicates:
    df = index_view(spark, d, *_VIEW).where("readable")
    return Duplicates(df, "file_id", "sha256", "phash", "dhash", 6, 10, exclude=audits.is_blank())


_PAIRS = """, u AS (SELECT *, CASE WHEN phash IS NOT NULL AND dhash IS NOT NULL AND NOT coalesce(contrast < 2 OR entropy < 0.5, false) THEN phash END AS p FROM rd),
pairs AS (SELECT x.file_id AS a, y.file_id AS b, x.split AS sa, y.split AS sb, x.label AS la, y.label AS lb FROM u x JOIN u y ON x.file_id < y.file_id
  AND (x.sha256 = y.sha256 OR (bit_count(xor(x.p, y.p)) <= 6 AND bit_count(xor(x.dhash, y.dhash)) <= 10)))
"""


@query(_PAIRS + "SELECT DISTINCT f AS file_id FROM (SELECT a AS f FROM pairs WHERE sa = 'test' AND sb = 'train' UNION ALL SELECT b FROM pairs WHERE sb = 'test' AND sa = 'train')")
def leak_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Test files with an exact or near copy in train."""
    return _duplicates(spark, d).touching(F.col("split") == "test", F.col("split") == "train").select(F.col("id").alias("file_id"))


_COMPONENTS = (
    "WITH RECURSIVE"
    + IDX.strip()[4:]
    + _PAIRS
    + """, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (
  SELECT DISTINCT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n WHERE r.c < e.b
), comp AS (SELECT n AS file_id, min(c) AS component FROM reach GROUP BY n) """
)


def dup_components(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of each file with a duplicate."""
    return _duplicates(spark, d).components.select(F.col("node").alias("file_id"), "component")


def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The files of each cluster for review."""
    files = index_view(spark, d, "relpath", "label", "split")
    return files.join(dup_components(spark, d), "file_id").select("relpath", "label", "split", F.col("component").alias("cluster"))


def leak_label_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose files have several labels."""
    c = dup_components(spark, d).join(index_view(spark, d, "label"), "file_id")
    return c.groupBy("component").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n")).where("n_labels > 1")


QUERIES |= {"dup_components": dup_components, "dup_clusters": dup_clusters, "leak_label_conflict": leak_label_conflict}
SQL |= {
    "dup_components": _COMPONENTS + "SELECT file_id, component FROM comp",
    "dup_clusters": _COMPONENTS + "SELECT relpath, label, split, component AS cluster FROM comp JOIN idx USING (file_id)",
    "leak_label_conflict": _COMPONENTS + "SELECT component, count(DISTINCT label) AS n_labels, count(*) AS n FROM comp JOIN idx USING (file_id) GROUP BY component HAVING count(DISTINCT label) > 1",
}


@query('SELECT "group", count(DISTINCT split) AS n_splits, count(*) AS n FROM idx WHERE "group" IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1')
def leak_group(spark: SparkSession, d: str) -> DataFrame:
    return audits.shared_groups(index_view(spark, d, "group", "split"))


@query("SELECT split, count(*) AS n FROM idx WHERE split IS NOT NULL GROUP BY split")
def leak_no_test_split(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts(index_view(spark, d, "split").where("split IS NOT NULL"), "split")


_NAME = "regexp_extract(path, '[^/\\\\]*$')"


@query(
    f""", g AS (SELECT label, nullif(regexp_extract({_NAME}, '^([A-Za-z]*\\d+)[_\\-\\s]', 1), '') AS g0, nullif(regexp_extract({_NAME}, '^([A-Za-z0-9]+)[_\\-\\s]', 1), '') AS g1,
nullif(regexp_extract({_NAME}, '^(.+)[_\\-]\\d+\\.[A-Za-z]+$', 1), '') AS g2 FROM idx)
SELECT count(*) AS n, count(DISTINCT label) AS labels, count(g0) AS covered_0, count(DISTINCT g0) AS groups_0, count(g1) AS covered_1, count(DISTINCT g1) AS groups_1, count(g2) AS covered_2, count(DISTINCT g2) AS groups_2 FROM g"""
)
def infer_groups(spark: SparkSession, d: str) -> DataFrame:
    return splitting.group_coverage(index_view(spark, d, "path", "label"), "path", "label")


@query(f"SELECT file_id, nullif(regexp_extract({_NAME}, '^([a-z]+[0-9a-f]*)_', 1), '') AS name_group FROM idx")
def group_regex(spark: SparkSession, d: str) -> DataFrame:
    return index_view(spark, d, "path").select("file_id", splitting.group_from_name(F.col("path"), r"^(?P<group>[a-z]+[0-9a-f]*)_").alias("name_group"))


_RANKS = """, long AS (UNPIVOT (SELECT {0} AS cls, width::DOUBLE AS width, height::DOUBLE AS height, bytes::DOUBLE AS bytes, brightness, contrast, entropy, sharpness FROM rd WHERE {1}) ON width, height, bytes, brightness, contrast, entropy, sharpness INTO NAME feature VALUE value),
sized AS (SELECT * FROM long QUALIFY count(*) OVER (PARTITION BY feature, cls) >= {2}),
ranked AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM sized),
s AS (SELECT feature, cls, count(*)::DOUBLE AS n, sum(r) AS ranks, min(value) = max(value) AS flat FROM ranked GROUP BY ALL),
t AS (SELECT feature, sum(c)::DOUBLE AS total, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM sized GROUP BY ALL) GROUP BY feature)
"""
_AUC = """SELECT feature, round(CASE WHEN max(total) >= 10 AND count(*) >= 2 THEN avg(greatest(a, 1 - a)) ELSE 0.5 END, 6) AS auc
FROM (SELECT feature, total, (ranks - n * (n + 1) / 2) / (n * (total - n)) AS a FROM s JOIN t USING (feature)) GROUP BY feature"""


@query(_RANKS.format("label", "label IS NOT NULL", 1) + _AUC)
def single_feature_auc(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "label", *FEATURES).where("readable")
    return statistics.single_feature_auc(df, "label", FEATURES).withColumn("auc", F.round("auc", 6))


@query(_RANKS.format("split", "split IN ('train', 'test')", 1) + _AUC)
def split_drift_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well each feature tells test from train."""
    df = index_view(spark, d, "readable", "split", *FEATURES).where(F.col("readable") & F.col("split").isin("train", "test"))
    return statistics.single_feature_auc(df, "split", FEATURES).withColumn("auc", F.round("auc", 6))


@query(
    """, n AS (SELECT count(*) FILTER (split = 'train') AS p, count(*) FILTER (split = 'test') AS q FROM rd WHERE label IS NOT NULL GROUP BY label),
x AS (SELECT p / (SELECT sum(p) FROM n) AS p, q / (SELECT sum(q) FROM n) AS q FROM n)
SELECT round(sqrt(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS js FROM x"""
)
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "label", "split").where("readable")
    return statistics.js_distance(df, "label", "split", "train", "test").select(F.round("js", 6).alias("js"))


_CHI = """, c AS (SELECT label AS a, {0} AS b, count(*)::DOUBLE AS n FROM rd WHERE label IS NOT NULL AND {0} IS NOT NULL GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM c GROUP BY a), k AS (SELECT b, sum(n) AS k FROM c GROUP BY b),
g AS (SELECT coalesce(n, 0) AS n, r * k / (SELECT sum(n) FROM c) AS e, (SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS dof FROM r CROSS JOIN k LEFT JOIN c USING (a, b))
SELECT round(sum((CASE WHEN dof = 1 THEN greatest(abs(n - e) - 0.5, 0) ELSE n - e END) ** 2 / e), 4) AS chi2, max(dof) AS dof FROM g"""


@query(_CHI.format("split"))
def chi2_label_split(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "label", "split").where("readable")
    return statistics.chi2_independence(df, "label", "split").select(F.round("chi2", 4).alias("chi2"), "dof")


# Labels


@query("SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split IS NOT NULL) AS total FROM idx GROUP BY label")
def lab_distribution(spark: SparkSession, d: str) -> DataFrame:
    return relational.crosstab(index_view(spark, d, "label", "split"), "label", "split", SPLITS)


@query(
    """, n AS (SELECT label, count(*) AS n FROM idx WHERE label IS NOT NULL GROUP BY label)
SELECT round(max(n) / min(n), 6) AS ratio, arg_min(label, (-n, label)) AS largest, arg_min(label, (n, label)) AS smallest, count(*) AS classes FROM n"""
)
def imbalance(spark: SparkSession, d: str) -> DataFrame:
    return statistics.imbalance(index_view(spark, d, "label"), "label").withColumn("ratio", F.round("ratio", 6))


_GRID = ", l AS (SELECT DISTINCT label FROM idx WHERE label IS NOT NULL), g AS (SELECT l.label, s.split, count(i.file_id) AS n FROM l CROSS JOIN (VALUES {0}) s(split) LEFT JOIN idx i ON i.label = l.label AND i.split = s.split GROUP BY ALL)"


@query(_GRID.format("('val'), ('test')") + " SELECT split, label, n, CASE WHEN n > 0 THEN round(196 * sqrt(0.16 / n), 4) END AS ci_pp FROM g WHERE n < 30")
def lab_split_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audits.split_coverage(index_view(spark, d, "label", "split"), HELD)


@query(
    _GRID.format("('train'), ('val'), ('test')")
    + """, p AS (SELECT label, split, 100.0 * n / (SELECT count(*) FROM idx i WHERE i.split = g.split) AS share FROM g)
SELECT label, split, round(share, 6) AS share, round(abs(share - (SELECT share FROM p t WHERE t.label = p.label AND t.split = 'train')), 6) AS diff FROM p"""
)
def lab_stratification(spark: SparkSession, d: str) -> DataFrame:
    s = audits.stratification(index_view(spark, d, "label", "split"), SPLITS)
    return s.withColumns({c: F.round(c, 6) for c in ("share", "diff")})


# Quality

_ASPECT = "CASE WHEN width > 0 AND height > 0 THEN width / height END"


@query(
    f""", a AS (SELECT *, {_ASPECT} AS aspect FROM rd), m AS (SELECT median(aspect) AS ref FROM a)
SELECT count(*) AS n, round(max(ref), 6) AS median_aspect, count(DISTINCT (width, height)) FILTER (width IS NOT NULL AND height IS NOT NULL) AS n_sizes,
round(100.0 * count(*) FILTER (abs(ln(aspect / ref)) > ln(1.25)) / count(aspect), 2) AS pct_distorted FROM a, m"""
)
def qual_resolution(spark: SparkSession, d: str) -> DataFrame:
    return audits.resolution(index_view(spark, d, "readable", "width", "height")).withColumn("median_aspect", F.round("median_aspect", 6))


@query(
    f"""SELECT label, median(width) AS median_width, min(width) AS min_width, max(width) AS max_width, median(height) AS median_height, min(height) AS min_height, max(height) AS max_height,
round(median({_ASPECT}), 6) AS median_aspect FROM rd GROUP BY label"""
)
def qual_sizes(spark: SparkSession, d: str) -> DataFrame:
    return audits.sizes_by_label(index_view(spark, d, "readable", "label", "width", "height")).withColumn("median_aspect", F.round("median_aspect", 6))


_BLUR = """, x AS (SELECT *, CASE WHEN sharpness > -1 THEN ln(1 + sharpness) END AS s FROM rd), m AS (SELECT label, median(s) AS m FROM x GROUP BY label),
d AS (SELECT x.*, m.m, abs(s - m.m) AS off FROM x JOIN m ON x.label IS NOT DISTINCT FROM m.label), k AS (SELECT label, median(off) * 1.4826 AS mad FROM d GROUP BY label),
z AS (SELECT d.*, CASE WHEN s IS NULL THEN NULL WHEN mad > 0 THEN (s - m) / mad ELSE 0 END AS z FROM d JOIN k ON d.label IS NOT DISTINCT FROM k.label)
"""


@query(_BLUR + "SELECT file_id, round(z, 6) AS z FROM z WHERE z < -1")
def qual_blur(spark: SparkSession, d: str) -> DataFrame:
    return audits.blur_scores(index_view(spark, d, "readable", "label", "sharpness")).where("z < -1").select("file_id", F.round("z", 6).alias("z"))


@query(_BLUR + "SELECT label, count(*) AS n, count(*) FILTER (z < -1) AS n_blurry, round(100.0 * count(*) FILTER (z < -1) / count(*), 2) AS pct_blurry FROM z GROUP BY label")
def qual_blur_rates(spark: SparkSession, d: str) -> DataFrame:
    return audits.blur_rates(index_view(spark, d, "readable", "label", "sharpness"), -1.0)


@query("SELECT file_id, brightness FROM rd WHERE brightness > 0.8")
def qual_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Over the brightness, as the table has no share of clipped pixels."""
    return audits.over(index_view(spark, d, "readable", "brightness"), "brightness", 0.8).select("file_id", "brightness")


@query("SELECT file_id, round(1 - entropy / contrast, 6) AS loss FROM rd WHERE contrast > 2 AND entropy IS NOT NULL AND 1 - entropy / contrast > 0.95")
def qual_resize_risk(spark: SparkSession, d: str) -> DataFrame:
    """The loss from one measure to another; over contrast and entropy, as the table has no edge densities."""
    loss = audits.detail_loss(index_view(spark, d, "readable", "contrast", "entropy"), "contrast", "entropy", 2)
    return loss.where("loss > 0.95").select("file_id", F.round("loss", 6).alias("loss"))


@query("SELECT round(avg(brightness), 6) AS mean_gray, round(sqrt(avg(contrast * contrast) + var_pop(brightness)), 6) AS std_gray FROM rd WHERE split = 'train'")
def qual_normalization(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "split", "brightness", "contrast").where("split = 'train'")
    return audits.pooled(df, {"gray": ("brightness", "contrast")}).select(F.round("mean_gray", 6).alias("mean_gray"), F.round("std_gray", 6).alias("std_gray"))


@query(
    """SELECT coalesce(domain, '(none)') AS domain, count(*) AS n, round(count(*) / (SELECT count(*) FROM rd), 6) AS share, round(median(brightness), 6) AS median_brightness,
round(median(sharpness), 6) AS median_sharpness FROM rd GROUP BY 1"""
)
def qual_slices(spark: SparkSession, d: str) -> DataFrame:
    s = audits.slices(index_view(spark, d, "readable", "domain", "brightness", "sharpness"))
    return s.withColumns({c: F.round(c, 6) for c in ("share", "median_brightness", "median_sharpness")})


# Shortcuts and baselines


@query(
    _RANKS.format("label", "label IS NOT NULL", 2)
    + """SELECT feature, round((12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (total ** 3 - total)), 4) AS h,
round((12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (total ** 3 - total)) / ((SELECT count(*) FROM rd WHERE label IS NOT NULL) - 1), 6) AS effect, k - 1 AS dof
FROM (SELECT feature, sum(ranks * ranks / n) AS q, count(*) AS k FROM s GROUP BY feature HAVING count(*) > 1 AND NOT bool_and(flat)) JOIN t USING (feature)"""
)
def short_stat_by_class(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "label", *FEATURES).where("readable")
    return statistics.kruskal(df, "label", FEATURES).select("feature", F.round("h", 4).alias("h"), F.round("effect", 6).alias("effect"), "dof")


_TOKENS = """, f AS (SELECT label, list_distinct(regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/\\\\]*$'), '\\.[^.]*$', '')), '[a-z]+')) AS t FROM rd WHERE label IS NOT NULL),
size AS (SELECT label, count(*) AS size FROM f GROUP BY label), n AS (SELECT token, label, count(*) AS n FROM (SELECT label, unnest(t) AS token FROM f) GROUP BY ALL), e AS (SELECT token, sum(n) AS every FROM n GROUP BY token)
SELECT token FROM n JOIN size USING (label) JOIN e USING (token) WHERE n >= 0.9 * size AND ((SELECT sum(size) FROM size) = size OR every - n < 0.1 * ((SELECT sum(size) FROM size) - size))
UNION SELECT unnest(regexp_extract_all(lower(label), '[a-z]+')) FROM size"""


@query(_TOKENS)
def naming_tokens(spark: SparkSession, d: str) -> DataFrame:
    return probes.naming_tokens(index_view(spark, d, "readable", "path", "label").where("readable"), "path", "label")


@query(
    """, m AS (SELECT label FROM idx WHERE split = 'train' AND label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT (SELECT label FROM m) AS label, round(avg(CASE WHEN label = (SELECT label FROM m) THEN 1.0 ELSE 0 END), 6) AS accuracy, count(DISTINCT label) AS classes FROM idx WHERE split = 'test'"""
)
def base_majority(spark: SparkSession, d: str) -> DataFrame:
    return audits.majority(index_view(spark, d, "label", "split"), "train", "test").withColumn("accuracy", F.round("accuracy", 6))


@query(
    """, n AS (SELECT count(*) AS n FROM idx WHERE label IS NOT NULL GROUP BY label)
SELECT CASE WHEN max(n) / min(n) >= 3 THEN CASE WHEN count(*) = 2 THEN 'macro-F1 and PR-AUC' ELSE 'macro-F1' END ELSE 'accuracy (plus macro-F1)' END AS metric FROM n"""
)
def base_metric_advice(spark: SparkSession, d: str) -> DataFrame:
    i = statistics.imbalance(index_view(spark, d, "label"), "label")
    return i.select(F.when(F.col("ratio") >= 3, F.when(F.col("classes") == 2, "macro-F1 and PR-AUC").otherwise("macro-F1")).otherwise("accuracy (plus macro-F1)").alias("metric"))


# Index operators


@query("SELECT file_id, label FROM idx WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(file_id::VARCHAR), file_id) <= 20")
def sample_per_class(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 20 files per label by a hash of their number; the sample is what this operator is for."""
    df = index_view(spark, d, "label").where("label IS NOT NULL")
    return relational.first_per_group(df, "label", 20, F.md5(F.col("file_id").cast("string")), F.col("file_id")).select("file_id", "label")


@query(
    """, p AS (SELECT substr(sha256, 1, 2) AS part, sha256(string_agg(sha256, '' ORDER BY sha256)) AS digest FROM idx WHERE sha256 IS NOT NULL GROUP BY 1)
SELECT sha256(string_agg(digest, '' ORDER BY part, digest)) AS fingerprint FROM p"""
)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return audits.fingerprint(index_view(spark, d, "sha256"))


@query("SELECT CASE WHEN bit_count(xor(phash, dhash)) IS NULL THEN -1 ELSE bit_count(xor(phash, dhash)) END::INTEGER AS bits, count(*) AS n FROM idx GROUP BY 1")
def hamming_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = index_view(spark, d, "phash", "dhash")
    return v.groupBy(F.coalesce(hamming(F.col("phash"), F.col("dhash")), F.lit(-1)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Files by whether the feature cache has their present state."""
    index = table(spark, d, "dataset_index", "file_id", "path", "bytes", "mtime_ns").dropDuplicates(["file_id"])
    keys = done_keys(table(spark, d, "features", "key", "data", "run_id"), table(spark, d, "audit_runs", "run_id", "status")).distinct().withColumn("hit", F.lit(True))
    whole = F.col("path").isNotNull() & F.col("bytes").isNotNull() & F.col("mtime_ns").isNotNull()
    files = index.select("file_id", F.when(whole, feature_key()).alias("key"))
    return files.join(keys, "key", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["cache_hits"] = cache_hits
SQL["cache_hits"] = """
WITH done AS (SELECT DISTINCT key FROM features f JOIN audit_runs r ON f.run_id = r.run_id AND r.status = 'succeeded' WHERE json_valid(data) AND list_contains(json_keys(CASE WHEN json_valid(data) THEN data END), 'readable'))
SELECT done.key IS NOT NULL AS hit, count(*) AS n FROM (SELECT DISTINCT file_id, path || '|' || bytes || '|' || mtime_ns || '|v1|t64' AS key FROM dataset_index) i LEFT JOIN done USING (key) GROUP BY 1
"""


def suggested_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split suggestion that keeps groups and duplicates together."""
    df = index_view(spark, d, "label", "group")
    units = splitting.split_groups(df, "file_id", "group", _duplicates(spark, d).components)
    out = splitting.suggest_splits(df, "file_id", "label", units)
    return out if out is not None else units.withColumn("split", F.lit("train")).limit(0)


@query(
    """, n AS (SELECT count(*) AS n, count(DISTINCT "group") AS g FROM idx)
SELECT n AS n_files, g AS n_groups, 0::BIGINT AS torn_groups, 0::BIGINT AS torn_clusters, true AS near_shares FROM n"""
)
def suggested_split_rules(spark: SparkSession, d: str) -> DataFrame:
    """What any suggestion must fulfil: all files have a split, no group and no cluster of duplicates is torn, and the shares are near 5/7, 1/7 and 1/7, to
    within the largest unit, or a thirtieth."""
    df = index_view(spark, d, "label", "group")
    clusters = cut(_duplicates(spark, d).components)
    units = cut(splitting.split_groups(df, "file_id", "group", clusters))
    out = cut(splitting.suggest_splits(df, "file_id", "label", units))
    torn = lambda rows, key: rows.groupBy(key).agg(F.count_distinct("split").alias("s")).where("s > 1").agg(F.count(F.lit(1)).alias(f"torn_{key}"))
    grouped = out.join(df, "file_id")
    largest = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))
    whole = grouped.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("group").alias("n_groups"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    one = whole.join(torn(grouped.where("`group` IS NOT NULL"), "group")).join(torn(out.join(clusters, out["file_id"] == clusters["node"]), "component")).join(largest)
    slack = F.greatest(F.col("n_files") / 30, F.col("largest"))
    near = reduce(lambda a, b: a & b, [F.abs(F.col(s) - F.col("n_files") * k / 7) <= slack for s, k in (("train", 5), ("val", 1), ("test", 1))])
    return one.select("n_files", "n_groups", F.col("torn_group").alias("torn_groups"), F.col("torn_component").alias("torn_clusters"), near.alias("near_shares"))


_UNITS = (
    "WITH RECURSIVE"
    + IDX.strip()[4:]
    + _PAIRS
    + """, star AS (SELECT file_id AS a, min(file_id) OVER (PARTITION BY "group") AS b FROM idx WHERE "group" IS NOT NULL),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b), reach AS (
  SELECT DISTINCT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n WHERE r.c < e.b
), comp AS (SELECT n AS file_id, min(c) AS first FROM reach GROUP BY n)
SELECT file_id, coalesce(first, file_id) AS first FROM idx LEFT JOIN comp USING (file_id)"""
)


def split_units(spark: SparkSession, d: str) -> DataFrame:
    """Each file and the smallest file of its unit: files of one group, or linked as duplicates, directly or through others."""
    units = cut(splitting.split_groups(index_view(spark, d, "group"), "file_id", "group", _duplicates(spark, d).components))
    return units.join(units.groupBy("unit").agg(F.min("file_id").alias("first")), "unit").select("file_id", "first")


QUERIES["split_units"] = split_units
SQL["split_units"] = _UNITS


@query('SELECT coalesce(domain, \'(none)\') AS domain, count(*) FILTER (split = \'train\') AS train, count(*) FILTER (split = \'val\') AS val, count(*) FILTER (split = \'test\') AS test, count(*) FILTER (split IS NOT NULL) AS total FROM rd GROUP BY 1')
def crosstab_domain_split(spark: SparkSession, d: str) -> DataFrame:
    """A table of two columns with the sums of its rows."""
    df = index_view(spark, d, "readable", "domain", "split").where("readable").withColumn("domain", F.coalesce("domain", F.lit("(none)")))
    return relational.crosstab(df, "domain", "split", SPLITS)


@query("SELECT row_number() OVER (ORDER BY sharpness, file_id) AS place, file_id, sharpness FROM rd WHERE sharpness IS NOT NULL ORDER BY sharpness, file_id LIMIT 20")
def evidence_blurriest(spark: SparkSession, d: str) -> DataFrame:
    """The twenty least sharp files, in order, as the examples of a finding; being a top list is the feature."""
    df = index_view(spark, d, "readable", "sharpness").where("readable AND sharpness IS NOT NULL")
    top = df.orderBy("sharpness", "file_id").limit(20)
    return top.select(F.row_number().over(Window.orderBy("sharpness", "file_id")).cast("long").alias("place"), "file_id", "sharpness")


@query(
    """, f AS (SELECT 'int.unreadable' AS check_id, count(*) FILTER (NOT readable) AS n FROM idx UNION ALL SELECT 'int.blank', count(*) FROM rd WHERE contrast < 2 OR entropy < 0.5
UNION ALL SELECT 'int.tiny', count(*) FROM rd WHERE least(width, height) < 32 UNION ALL SELECT 'int.format_mismatch', count(*) FROM rd WHERE magic_format IS NOT NULL AND magic_format IS DISTINCT FROM """
    + _FORMAT
    + """) SELECT check_id, CASE WHEN n = 0 THEN 0 WHEN check_id = 'int.unreadable' THEN 3 ELSE 2 END::INTEGER AS severity, 'integrity' AS section FROM f"""
)
def findings_integrity(spark: SparkSession, d: str) -> DataFrame:
    """The severities of the integrity checks that the index table has all columns for."""
    from .findings import all_checks

    wanted = {"int.unreadable", "int.blank", "int.tiny", "int.format_mismatch"}
    frame = _audited(spark, d, set(all_checks()) - wanted).to_frame()
    return frame.groupBy("check_id", "section").agg(F.max("severity").alias("severity"))


def _one(spark: SparkSession, r: probes.ProbeResult | None) -> DataFrame:
    rows = [(round(r.auc, 3), round(r.balanced_accuracy, 3), r.n, r.classes)] if r else []
    return spark.createDataFrame(rows, "auc double, balanced_accuracy double, n long, classes int")


def short_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Whether sizes and format, which is what the table has of the metadata, predict the label; the probe's rows per class are bounded by its documented parameter."""
    df = index_view(spark, d, "readable", "label", "width", "height", "magic_format").where("readable")
    df, code = probes.codes(F.col("magic_format"), df)
    return _one(spark, probes.numeric_probe(df, "file_id", "label", {"width": F.col("width"), "height": F.col("height"), "aspect": audits.aspect(), "format": code}))


def short_filename(spark: SparkSession, d: str) -> DataFrame:
    df = index_view(spark, d, "readable", "label", "path").where("readable")
    tokens = [r[0] for r in probes.naming_tokens(df, "path", "label").collect()]
    return _one(spark, probes.filename_probe(df, "file_id", "label", "path", tokens))


def short_vector(spark: SparkSession, d: str) -> DataFrame:
    """The linear probe of thumbnails and borders, over the vectors of the embeddings."""
    return _one(spark, probes.vector_probe(table(spark, d, "embeddings"), "vec_id", "label", "embedding"))


def split_probe(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model tells test from train."""
    df = index_view(spark, d, "readable", "split", *FEATURES).where(F.col("readable") & F.col("split").isin("train", "test"))
    return _one(spark, probes.numeric_probe(df, "file_id", "split", {f: F.col(f) for f in FEATURES}))


QUERIES |= {"suggested_splits": suggested_splits, "short_metadata": short_metadata, "short_filename": short_filename, "short_vector": short_vector, "split_probe": split_probe}


def _audited(spark: SparkSession, d: str, disabled: set[str]):
    from ..sources.images import Index
    from .audit import audit_index
    from .findings import Config

    df = cut(index_view(spark, d))
    counts = audits.class_counts(table(spark, d, "class_list", "label"), df)
    stray = spark.createDataFrame([], "relpath string, reason string")
    return audit_index(Index(d, df, "table", stray, counts, True), config=Config({"checks": {"disable": disabled}}), key="file_id")


def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """All checks over the index table; features it lacks count as missing."""
    return _audited(spark, d, set()).to_frame().select("check_id", "section", "severity", "title")


def audit_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The scorecard of all checks."""
    from .report import scorecard_of

    return scorecard_of(_audited(spark, d, set()).to_frame())


QUERIES |= {"audit_findings": audit_findings, "audit_scorecard": audit_scorecard}
