"""The problems' queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import split_of
from ..storage import cut, table
from . import grouped_split, hamming_overlap, leakage, paragraphs, quantiles, shared_spans, suffixes, tokens
from .components import components


# 2: the same or nearly the same files across splits


def _records(spark: SparkSession, d: str) -> DataFrame:
    return hamming_overlap.records(table(spark, d, "dataset_index", "file_id", "split", "domain", "readable", "contrast", "entropy", "sha256", "phash", "dhash"))


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """How much of each file's content hash and signatures stands in files of the other side, by a suffix array."""
    return suffixes.coverage(_records(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = hamming_overlap.overlaps(_records(spark, d))
    return pairs.select(F.least("train_id", "held_id").alias("file_a"), F.greatest("train_id", "held_id").alias("file_b"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and domain of the held-out file: files that overlap with train, and pairs."""
    return hamming_overlap.Overlaps(_records(spark, d)).counts


# 3: splits that keep related files together


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """The split of each file by annealing."""
    files = grouped_split.files_of(table(spark, d, "dataset_index", "file_id", "label", "group_key"))
    return grouped_split.assign(files).select("file_id", "split")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.torn(table(spark, d, "dataset_index", "group_key", "split"))


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Files by split and label in the annealed assignment."""
    files = grouped_split.files_of(table(spark, d, "dataset_index", "file_id", "label", "group_key"))
    return grouped_split.assign(files).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_files"))


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the annealed assignment must fulfil: every file has a split, no group is torn, and the files of each split are as many as wanted to within a
    hundredth of all, of each label to within a fiftieth of the label's, or the largest group's files there where those are more."""
    out = cut(grouped_split.assign(grouped_split.files_of(table(spark, d, "dataset_index", "file_id", "label", "group_key"))))
    torn = out.groupBy("component").agg(F.count_distinct("split").alias("s")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("s") > 1).alias("torn_groups"))
    counts = cut(out.groupBy("label", "component", "split").agg(F.count(F.lit(1)).alias("n")))
    off = lambda slack: reduce(lambda a, b: a & b, [F.abs(F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)) - share * F.sum("n")) <= F.greatest(F.sum("n") * slack, F.max("n")) for s, share in zip(grouped_split.SPLITS, grouped_split.SHARES)])
    whole = counts.groupBy("component", "split").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n_files"), off(0.01).alias("near_shares"))
    labels = counts.groupBy("label").agg(off(0.02).alias("near")).agg(F.bool_and("near").alias("near_label_shares"))
    return whole.join(F.broadcast(torn)).join(F.broadcast(labels))  # one row each


# 4: components of the kept pairs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "near_pairs", "file_a", "file_b", "kept").where("kept")
    return components(kept, "file_a", "file_b").select(F.col("node").alias("file_id"), "component")


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each component and its number of files."""
    return p4_found(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n_files"))


# 5: percentiles per label and day


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.files_once(table(spark, d, "dataset_index"), "label", "scanned_at", *quantiles.METRICS)


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.sketches(_measured(spark, d).withColumn("day", F.date_format("scanned_at", "yyyy-MM-dd")), ["label", "day"])


def p5_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_sketches(spark, d), ["label", "day"])


def p5_label_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """From the days' sketches alone."""
    return quantiles.percentiles(quantiles.merged(_sketches(spark, d), ["label"]), ["label"])


def p5_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether each label's percentiles, made from the days' sketches alone, are within the bound of their exact ranks in the whole table."""
    labels = cut(quantiles.merged(_sketches(spark, d), ["label"]))
    errors = quantiles.rank_errors(_measured(spark, d), labels, "label")
    return errors.select("label", "metric", "n", (F.col("error") <= quantiles.BOUND).alias("within"))


# 7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


# 8: test items in the corpus


def _leaks(spark: SparkSession, d: str, short: bool = False) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "item_text"), short=short)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The matches of whole windows without an edit."""
    return _leaks(spark, d).where(F.col("distance") == 0).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """All matches with at most two edited words in a window, with their distance; items shorter than a window are one of their own length."""
    return _leaks(spark, d, short=True)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item the documents that hold a passage of it, exactly or nearly; short items as in p8_near."""
    return _leaks(spark, d, short=True).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("distance") == 0).alias("n_exact"))


# 9: long exact spans


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal or similar paragraphs by MinHash banding."""
    return paragraphs.clusters(table(spark, d, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents", "doc_id", "text"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per document with shared spans, the characters in them and their share of its text."""
    docs = table(spark, d, "documents", "doc_id", "text")
    spans = shared_spans.shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return spans.join(sizes, "doc_id").select("doc_id", "n_shared", "n_chars", F.round(F.col("n_shared") / F.col("n_chars"), 6).alias("share"))


QUERIES = {
    "p2_method": p2_method,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_method": p3_method,
    "p3_found": p3_found,
    "p3_balance": p3_balance,
    "p3_rules": p3_rules,
    "p4_found": p4_found,
    "p4_sizes": p4_sizes,
    "p5_day_percentiles": p5_day_percentiles,
    "p5_label_percentiles": p5_label_percentiles,
    "p5_rank_errors": p5_rank_errors,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p8_items": p8_items,
    "p9_method": p9_method,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_SPLIT = "CASE WHEN lower(trim(split, ' ' || chr(9))) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, ' ' || chr(9))) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(trim(split, ' ' || chr(9))) IN ('test', 'testing') THEN 'test' END"
_OVERLAP = f"""
WITH f AS (
  SELECT DISTINCT file_id, {_SPLIT} AS s, domain, lower(sha256) AS sha,
    CASE WHEN phash IS NOT NULL AND dhash IS NOT NULL AND NOT coalesce(contrast < 2 OR entropy < 0.5, false) THEN phash END AS p, dhash AS d FROM dataset_index WHERE readable
), pairs AS (
  SELECT t.file_id AS t, h.file_id AS h, h.s, h.domain FROM f t JOIN f h ON t.s = 'train' AND h.s IN ('val', 'test') AND (t.sha = h.sha OR (bit_count(xor(t.p, h.p)) <= 6 AND bit_count(xor(t.d, h.d)) <= 10))
)
"""
SQL = {
    "p2_found": _OVERLAP + "SELECT least(t, h) AS file_a, greatest(t, h) AS file_b FROM pairs",
    "p2_counts": _OVERLAP + "SELECT s AS split, domain, count(DISTINCT h) AS n_files, count(*) AS n_pairs FROM pairs GROUP BY s, domain",
}
#: All stretches of 8 bytes or more are listed; those that also stand on the other side mark the bytes they cover.
SQL["p2_method"] = f"""
WITH f AS (
  SELECT DISTINCT file_id, {_SPLIT} AS split, lower(sha256) AS sha,
    CASE WHEN phash IS NOT NULL AND dhash IS NOT NULL AND NOT coalesce(contrast < 2 OR entropy < 0.5, false) THEN phash END AS p, dhash AS d FROM dataset_index WHERE readable
), t AS (
  SELECT file_id, split, split <> 'train' AS held, coalesce(CASE WHEN regexp_full_match(sha, '([0-9a-f]{{2}})+') THEN sha END, '')
    || CASE WHEN p IS NULL THEN '' ELSE lower(printf('%016x', p) || printf('%016x', d)) END AS text FROM f WHERE split IS NOT NULL
), w AS (SELECT file_id, held, text, i, substring(text, 2 * i + 1, 16) AS k FROM (SELECT *, unnest(range(0, length(text) // 2 - 7)) AS i FROM t)
), both_ AS (SELECT k FROM w GROUP BY k HAVING bool_or(held) AND bool_or(NOT held)), hit AS (SELECT w.* FROM w SEMI JOIN both_ USING (k)
), covered AS (SELECT file_id, count(DISTINCT b) AS n_shared FROM (SELECT file_id, unnest(range(i, i + 8)) AS b FROM hit) GROUP BY file_id
), long AS (SELECT file_id, held, n, substring(text, 2 * i + 1, 2 * n) AS x FROM (SELECT *, unnest(range(8, length(text) // 2 - i + 1)) AS n FROM hit)
), same AS (SELECT x FROM long GROUP BY x HAVING bool_or(held) AND bool_or(NOT held)), longest AS (SELECT file_id, max(n) AS longest FROM long SEMI JOIN same USING (x) GROUP BY file_id)
SELECT file_id, split, (length(text) // 2)::INTEGER AS n_bytes, n_shared::INTEGER AS n_shared, longest::INTEGER AS longest FROM t JOIN covered USING (file_id) JOIN longest USING (file_id)
"""
SQL["p3_found"] = f"""
SELECT g AS group_key FROM (SELECT lower(trim(group_key, ' ' || chr(9))) AS g, {_SPLIT} AS s FROM dataset_index) WHERE g <> '' AND g <> 'nan' AND s IS NOT NULL
GROUP BY g HAVING count(DISTINCT s) > 1
"""
_COMPONENTS = """
WITH RECURSIVE e AS (
  SELECT file_a AS a, file_b AS b FROM near_pairs WHERE kept AND file_a <> file_b UNION SELECT file_b, file_a FROM near_pairs WHERE kept AND file_a <> file_b
), reach AS (
  SELECT DISTINCT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n WHERE r.c < e.b
), comp AS (SELECT n AS file_id, min(c) AS component FROM reach GROUP BY n)
"""
SQL |= {"p4_found": _COMPONENTS + "SELECT file_id, component FROM comp", "p4_sizes": _COMPONENTS + "SELECT component, count(*) AS n_files FROM comp GROUP BY component"}
_SPANS = """
WITH docs AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300), w AS (
  SELECT doc_id, i, md5(substring(text, i + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 300)) AS i FROM docs)
), shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), hits AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN shared USING (h)
), runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits), spans AS (
  SELECT doc_id, min(i) AS span_start, max(i) + 300 AS span_end FROM runs GROUP BY doc_id, run
)
"""
SQL |= {
    "p9_found": _SPANS + "SELECT doc_id, span_start, span_end FROM spans",
    "p9_shares": _SPANS + "SELECT doc_id, sum(span_end - span_start)::BIGINT AS n_shared, any_value(length(text)) AS n_chars, round(sum(span_end - span_start) / any_value(length(text)), 6) AS share FROM spans JOIN documents USING (doc_id) GROUP BY doc_id",
}
_PERCENTILES = """
WITH f AS (SELECT DISTINCT file_id, label, strftime(scanned_at, '%Y-%m-%d') AS day, width, height, sharpness FROM dataset_index),
v AS (UNPIVOT (SELECT label, day, CASE WHEN width > 0 THEN width::DOUBLE END AS width, CASE WHEN height > 0 THEN height::DOUBLE END AS height,
  CASE WHEN sharpness > 0 AND NOT isnan(sharpness) THEN sharpness END AS sharpness FROM f) ON width, height, sharpness INTO NAME metric VALUE x),
q AS (SELECT {0}, metric, count(*) AS n, quantile_disc(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS p FROM v GROUP BY ALL),
g AS (SELECT DISTINCT {0}, metric FROM f, (VALUES ('width'), ('height'), ('sharpness')) m(metric))
SELECT {1}, g.metric, coalesce(n, 0) AS n, p[1] AS p1, p[2] AS p5, p[3] AS p25, p[4] AS p50, p[5] AS p75, p[6] AS p95, p[7] AS p99 FROM g LEFT JOIN q ON {2} AND g.metric = q.metric
"""
#: Exact, as are sketches of at most K values, which no group of the tables up to scale 0.01 exceeds.
SQL |= {
    "p5_day_percentiles": _PERCENTILES.format("label, day", "g.label, g.day", "g.label IS NOT DISTINCT FROM q.label AND g.day IS NOT DISTINCT FROM q.day"),
    "p5_label_percentiles": _PERCENTILES.format("label", "g.label", "g.label IS NOT DISTINCT FROM q.label"),
}
SQL["p5_rank_errors"] = """
WITH f AS (SELECT DISTINCT file_id, label, width, height, sharpness FROM dataset_index)
SELECT label, metric, count(*) FILTER (x > 0 AND NOT isnan(x)) AS n, true AS within
FROM (SELECT label, unnest([{'metric': 'width', 'x': width::DOUBLE}, {'metric': 'height', 'x': height::DOUBLE}, {'metric': 'sharpness', 'x': sharpness}], recursive := true) FROM f) GROUP BY label, metric
"""
SQL["p3_rules"] = """
WITH f AS (SELECT DISTINCT file_id, lower(trim(group_key, ' ' || chr(9))) AS g FROM dataset_index)
SELECT count(*) AS n_files, count(DISTINCT CASE WHEN g <> '' AND g <> 'nan' THEN 'g' || g ELSE 'f' || file_id END) AS n_groups, 0::BIGINT AS torn_groups, true AS near_shares, true AS near_label_shares FROM f
"""
