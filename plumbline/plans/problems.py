"""Queries of the general problems: rows that fail to parse, and only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import pending
from ..sources.strict_lines import StrictLoad
from ..storage import table


def _load(spark: SparkSession, d: str) -> StrictLoad:
    return StrictLoad(table(spark, d, "manifest"), table(spark, d, "class_list"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).rejected().select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).loaded().withColumnRenamed("group", "group_key")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).rejected().groupBy("manifest_name", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("file_id")


def p6_keys(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d)


def _pending(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "dataset_index", "file_id", "path", "bytes", "mtime_ns")
    return pending(index, table(spark, d, "features", "key", "data", "run_id"), table(spark, d, "audit_runs", "run_id", "status"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_reasons": p1_reasons, "p6_found": p6_found, "p6_keys": p6_keys}

_LINES = r"""
WITH heads AS (
  SELECT manifest_name, regexp_replace(min_by(raw_line, line_id), '\r$', '') AS head FROM manifest WHERE line_no = 1 GROUP BY manifest_name
), named AS (
  SELECT manifest_name, list_transform(string_split(replace(head, chr(65279), ''), ','), lambda x: lower(trim(x, ' ' || chr(9)))) AS names FROM heads
), lines AS (
  SELECT line_id, m.manifest_name, names, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line
  FROM manifest m LEFT JOIN named USING (manifest_name) WHERE line_no > 1
), quoted AS (
  SELECT *, coalesce(regexp_full_match(',' || line, '(?s)(,("([^"]|"")*"|[^",]*))+'), false) AS ok FROM lines
), fields AS (
  SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
    lambda x: trim(CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) END AS f FROM quoted
), vals AS (
  SELECT *, len(f) = len(names) AS counted, f[list_position(names, 'path')] AS v_path, f[list_position(names, 'label')] AS v_label,
    f[nullif(list_position(names, 'split'), 0)] AS v_split, f[nullif(list_position(names, 'group'), 0)] AS v_group, f[nullif(list_position(names, 'domain'), 0)] AS v_domain FROM fields
), judged AS (
  SELECT *, CASE WHEN line IS NULL OR trim(line, ' ' || chr(9)) = '' THEN 'column_count' WHEN NOT ok THEN 'quoting' WHEN NOT coalesce(counted, false) THEN 'column_count'
    WHEN NOT regexp_matches(v_path, '(?i)\.(jpg|jpeg|png|bmp|gif|tif|tiff|webp)\z') OR regexp_matches(v_path, '[\x00-\x1F\x{FFFD}]') THEN 'path'
    WHEN v_label NOT IN (SELECT label FROM class_list WHERE label IS NOT NULL) THEN 'label'
    WHEN v_split IS NOT NULL AND v_split <> '' AND lower(v_split) NOT IN ('train', 'training', 'val', 'valid', 'validation', 'dev', 'test', 'testing') THEN 'split' END AS reason FROM vals
)
"""

_PENDING = r"""
WITH done AS (
  SELECT DISTINCT key FROM features f JOIN audit_runs r ON f.run_id = r.run_id AND r.status = 'succeeded'
  WHERE json_valid(data) AND json_type(CASE WHEN json_valid(data) THEN data END) = 'OBJECT' AND list_contains(json_keys(CASE WHEN json_valid(data) THEN data END), 'readable')
)
SELECT DISTINCT file_id{0} FROM (SELECT file_id, path || '|' || bytes || '|' || mtime_ns || '|v1|t64' AS key FROM dataset_index WHERE mtime_ns IS NOT NULL) i
WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.key = i.key)
"""

SQL = {
    "p1_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": _LINES
    + """SELECT line_id, v_path AS path, v_label AS label, CASE WHEN lower(v_split) IN ('train', 'training') THEN 'train' WHEN lower(v_split) IN ('val', 'valid', 'validation', 'dev') THEN 'val'
    WHEN lower(v_split) IN ('test', 'testing') THEN 'test' END AS split, nullif(v_group, '') AS group_key, nullif(v_domain, '') AS domain FROM judged WHERE reason IS NULL""",
    "p1_reasons": _LINES + "SELECT manifest_name, reason, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": _PENDING.format(""),
    "p6_keys": _PENDING.format(", key"),
}
