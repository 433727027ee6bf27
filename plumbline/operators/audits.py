"""The measurements behind the checks, as plans over an index: one row per file with path, relpath, label, split, group, domain,
readable and feature columns. Each returns a DataFrame; severities are decided elsewhere.

Null labels form a class of their own in counts and are left out of comparisons between classes; empty indexes give empty results,
or for single-row results a row of zeros and nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import counts, filled, largest, pct, proportions, shares
from .statistics import medians, robust_z, same_keys


def error_reasons(df: DataFrame) -> DataFrame:
    """reason, n: unreadable files by the first part of their error."""
    reason = F.split_part(F.coalesce("error", F.lit("unknown")), F.lit(":"), F.lit(1))
    return df.where(~F.col("readable")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# The format of each extension.
FORMATS = {".jpg": "JPEG", ".jpeg": "JPEG", ".png": "PNG", ".bmp": "BMP", ".gif": "GIF", ".tif": "TIFF", ".tiff": "TIFF", ".webp": "WEBP"}


def ext_format(ext: Column) -> Column:
    out = F
    for name in dict.fromkeys(FORMATS.values()):
        out = out.when(F.lower(ext).isin([k for k, v in FORMATS.items() if v == name]), name)
    return out


def mismatched(df: DataFrame) -> DataFrame:
    """Readable files whose content is of another format than their extension says; an unknown extension counts as another."""
    return df.where(F.col("readable") & F.col("magic_format").isNotNull() & ~F.col("magic_format").eqNullSafe(ext_format(F.col("ext"))))


def format_mismatches(df: DataFrame) -> DataFrame:
    """mismatch, n."""
    return mismatched(df).groupBy(F.concat("ext", F.lit(" is really "), "magic_format").alias("mismatch")).agg(F.count(F.lit(1)).alias("n"))


def dominant_values(df: DataFrame, value: str) -> DataFrame:
    """label, dominant (its most frequent value, ties by name), values, odd (whether another one than over all classes)."""
    rows = df.where(F.col("readable") & F.col("label").isNotNull() & F.col(value).isNotNull())
    n = counts(rows, "label", value)
    per = n.groupBy("label").agg(largest("n", value).alias("dominant"), F.count(F.lit(1)).alias("values"))
    overall = counts(rows, value).agg(largest("n", value).alias("overall"))
    return per.join(F.broadcast(overall)).select("label", "dominant", "values", (F.col("dominant") != F.col("overall")).alias("odd"))


def is_blank(std: float = 2, entropy: float = 0.5) -> Column:
    return F.coalesce((F.col("contrast") < std) | (F.col("entropy") < entropy), F.lit(False))


def below_size(df: DataFrame, least: float) -> DataFrame:
    """Readable files whose shorter side is below ``least``, with ``side``."""
    return df.where("readable").withColumn("side", F.least("width", "height")).where(F.col("side") < least)


def class_counts(declared: DataFrame, df: DataFrame) -> DataFrame:
    """label, n for every declared label and every label found; 0 for labels without a file."""
    n = counts(df.where(F.col("label").isNotNull()), "label")
    return declared.where(F.col("label").isNotNull()).select("label").distinct().join(n, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """sha256, first (the smallest file), n, n_splits, n_labels of each set of readable byte-identical files."""
    g = df.where(F.col("readable") & F.col("sha256").isNotNull()).groupBy("sha256")
    return g.agg(F.min("file_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("n_splits"), F.count_distinct("label").alias("n_labels")).where("n > 1")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """scope (cross or within splits), n_groups, n_files, redundant."""
    g = df.where(F.col("readable") & F.col("sha256").isNotNull()).groupBy("sha256")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("n_splits")).where("n > 1").withColumn("scope", F.when(F.col("n_splits") > 1, "cross").otherwise("within"))
    return g.groupBy("scope").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_files"), F.sum(F.col("n") - 1).alias("redundant"))


def shared_groups(df: DataFrame, group: str = "group") -> DataFrame:
    """group, n_splits, n: groups whose files are in more than one split."""
    rows = df.where(F.col(group).isNotNull() & F.col("split").isNotNull())
    n = counts(rows, group, "split")
    return n.groupBy(group).agg(F.count(F.lit(1)).alias("n_splits"), F.sum("n").alias("n")).where("n_splits > 1")


def split_coverage(df: DataFrame, held: list[str], need: int = 30) -> DataFrame:
    """split, label, n, ci_pp for each held-out split and label with under ``need`` files: half the width of the 95 % interval, in percent
    points, of a recall of 0.8; null without files."""
    n = filled(df, "label", counts(df.where(F.col("label").isNotNull()), "label").select("label"), "split", held)
    return n.where(F.col("n") < need).select("split", "label", "n", F.when(F.col("n") > 0, F.round(196 * F.sqrt(F.lit(0.8 * 0.2) / F.col("n")), 4)).alias("ci_pp"))


def stratification(df: DataFrame, splits: list[str]) -> DataFrame:
    """label, split, share (percent of the split), diff (absolute difference to the first split's share)."""
    p = proportions(df, "label", "split", splits)
    ref = p.where(F.col("split") == (splits[0] if splits else "")).select("label", F.col("share").alias("ref"))
    return p.join(ref, "label").select("label", "split", "share", F.abs(F.col("share") - F.col("ref")).alias("diff"))


def aspect() -> Column:
    return F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))


def resolution(df: DataFrame) -> DataFrame:
    """One row: n, median_aspect, n_sizes, pct_distorted (files more than 25 % off the median aspect)."""
    rows = df.where("readable").withColumn("aspect", aspect())
    ref = medians(rows, [], ["aspect"]).select(F.col("aspect").alias("ref"))
    sizes = rows.agg(F.count_distinct("width", "height").alias("n_sizes"))
    x = rows.select("aspect").join(F.broadcast(ref)).join(F.broadcast(sizes))  # one row each
    far = F.abs(F.ln(F.col("aspect") / F.col("ref"))) > math.log(1.25)
    return x.agg(F.count(F.lit(1)).alias("n"), F.max("ref").alias("median_aspect"), F.max("n_sizes").alias("n_sizes"), pct(F.count_if(far), F.count("aspect")).alias("pct_distorted"))


def sizes_by_label(df: DataFrame) -> DataFrame:
    """label, and the median, smallest and largest width and height, and the median aspect."""
    rows = df.where("readable").withColumn("aspect", aspect())
    ends = rows.groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))])
    middle = medians(rows, ["label"], ["width", "height", "aspect"]).withColumnsRenamed({c: f"median_{c}" for c in ("width", "height", "aspect")})
    return same_keys(ends, middle, ["label"], "left").select("label", *[f"{n}_{c}" for c in ("width", "height") for n in ("median", "min", "max")], "median_aspect")


def detail_loss(df: DataFrame, native: str = "edge_density", target: str = "edge_density_target", least: float = 0.005) -> DataFrame:
    """Readable files with enough edges, with ``loss``, the share of edges gone at the target size."""
    rows = df.where(F.col("readable") & (F.col(native) > least) & F.col(target).isNotNull())
    return rows.withColumn("loss", 1 - F.col(target) / F.col(native))


def blur_scores(df: DataFrame) -> DataFrame:
    """Readable files with z of the log of their sharpness within their class."""
    return robust_z(df.where("readable"), "label", F.when(F.col("sharpness") > -1, F.log1p("sharpness")))


def blur_rates(df: DataFrame, z: float = -3.0) -> DataFrame:
    """label, n, n_blurry, pct_blurry."""
    bad = F.count_if(F.col("z") < z)
    return blur_scores(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_blurry"), pct(bad, F.count(F.lit(1))).alias("pct_blurry"))


def over(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Readable files with more than ``limit`` in a column."""
    return df.where(F.col("readable") & (F.col(column) > limit))


def pooled(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each name the mean of the means, and the pooled standard deviation from means and deviations per file."""
    rows = df.where("readable")
    return rows.agg(*[a for n, (m, s) in pairs.items() for a in (F.avg(m).alias(f"mean_{n}"), F.sqrt(F.avg(F.col(s) * F.col(s)) + F.var_pop(m)).alias(f"std_{n}"))])


def slices(df: DataFrame) -> DataFrame:
    """domain ("(none)" if null), n, share, median_brightness, median_sharpness of the readable files."""
    rows = df.where("readable").withColumn("domain", F.coalesce("domain", F.lit("(none)")))
    middle = medians(rows, ["domain"], ["brightness", "sharpness"]).withColumnsRenamed({c: f"median_{c}" for c in ("brightness", "sharpness")})
    return shares(rows, "domain").join(middle, "domain", "left")


def majority(df: DataFrame, train: str | None, held: str | None) -> DataFrame:
    """One row: label (the most frequent in ``train``, or in all files; ties by name), accuracy of always predicting it on ``held`` or all
    files, and classes there."""
    best = counts(df.where(F.col("label").isNotNull() & (F.col("split") == train if train else F.lit(True))), "label").agg(largest("n", "label").alias("majority"))
    rows = df.where(F.col("split") == held) if held else df
    x = rows.select("label").join(F.broadcast(best))  # one row
    return x.agg(F.max("majority").alias("label"), F.avg(F.coalesce(F.col("label") == F.col("majority"), F.lit(False)).cast("double")).alias("accuracy"), F.count_distinct("label").alias("classes"))


def fingerprint(df: DataFrame, column: str = "sha256") -> DataFrame:
    """One row: fingerprint, a hash that any set of the same content hashes has, in whatever order. The sorted hashes of each of the 256 first bytes
    are hashed, and then those digests in order, so no task needs all of them."""
    part = df.where(F.col(column).isNotNull()).groupBy(F.substring(column, 1, 2).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias("digest"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ""), 256).alias("fingerprint"))
