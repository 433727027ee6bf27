"""Audit views of tables: one row per file with the columns of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import group_of, split_of
from ..storage import table

COLUMNS = ("file_id", "path", "relpath", "label", "split", "group", "domain", "readable", "error", "bytes", "ext", "magic_format", "sha256", "width", "height", "brightness", "contrast", "entropy", "sharpness", "phash", "dhash")


def index_view(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The index table, each file once, with splits and groups in one spelling, hex digits in lower case and NaN as null. Only the
    wanted columns are read."""
    made = {"split": split_of(F.col("split")), "group": group_of(F.col("group_key")), "sha256": F.lower("sha256"), "readable": F.coalesce("readable", F.lit(False))}
    made |= {c: F.when(~F.isnan(c), F.col(c)) for c in ("brightness", "contrast", "entropy", "sharpness")}
    wanted = [c for c in COLUMNS if not columns or c in columns or c == "file_id"]
    return table(spark, d, "dataset_index").select(*[made.get(c, F.col(c)).alias(c) for c in wanted]).dropDuplicates(["file_id"])


_S = "lower(trim(split, ' ' || chr(9)))"
_G = "lower(trim(group_key, ' ' || chr(9)))"
#: The same view for SQL.
IDX = f"""
WITH idx AS (SELECT DISTINCT file_id, path, relpath, label,
  CASE WHEN {_S} IN ('train', 'training') THEN 'train' WHEN {_S} IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN {_S} IN ('test', 'testing') THEN 'test' END AS split,
  CASE WHEN {_G} NOT IN ('', 'nan') THEN {_G} END AS "group", domain, coalesce(readable, false) AS readable, error, bytes, ext, magic_format, lower(sha256) AS sha256, width, height,
  CASE WHEN NOT isnan(brightness) THEN brightness END AS brightness, CASE WHEN NOT isnan(contrast) THEN contrast END AS contrast,
  CASE WHEN NOT isnan(entropy) THEN entropy END AS entropy, CASE WHEN NOT isnan(sharpness) THEN sharpness END AS sharpness, phash, dhash FROM dataset_index),
rd AS (SELECT * FROM idx WHERE readable)
"""
