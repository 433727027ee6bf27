"""Strict loading of CSV manifests that arrived as raw lines.

The load keeps only lines whose layout and values are usable. What it left out is found by subtracting the loaded
offsets (``line_id``) from those received, and only this remainder is diagnosed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import IMAGE_EXTENSIONS, SPLITS, split_of, trimmed
from ..operators.skew import hot_keys, join_skewed
from ..storage import cut

#: One field: quoted, with "" as a quote inside, up to a comma or the end; or free of quotes. Possessive, so that a
#: line of any length needs neither backtracking nor stack.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=,|\z)|[^",]*+(?=,|\z))'
COLUMNS = ("path", "label", "split", "group", "domain")
VERDICTS = ("blank", "quoted", "counted", "path_ok", "label_ok", "split_ok")
#: Up to so many declared labels are listed in the plan; more are joined by a shuffle.
LABELS_LISTED = 5_000
#: Headers of up to so many bytes together are sent to all tasks.
HEADS_BYTES = 16_000_000


def _line(c: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(c.endswith("\r"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def _well_quoted(c: Column) -> Column:
    return F.concat(F.lit(","), c).rlike(rf"\A(?:,{FIELD})++\z")


def _fields(c: Column) -> Column:
    """The fields of a well-quoted line, without their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(f",({FIELD})"), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def headers(raw: DataFrame) -> DataFrame:
    """One row per manifest with a header: its number of columns ``n_cols``, and the place of each known column, counted from 1, 0 if
    absent. Of several header lines the one with the smallest ``line_id`` counts; if its text is null, ``n_cols`` is null, so that none of
    the manifest's lines conforms. Only header lines are aggregated."""
    h = raw.where(F.col("line_no") == 1).groupBy("manifest_name").agg(F.min_by("raw_line", "line_id").alias("head"))
    h = h.withColumn("head", _line(F.ltrim(F.replace(F.col("head"), F.lit("\ufeff"), F.lit("")))))
    names = F.when(_well_quoted(F.col("head")), _fields(F.col("head"))).otherwise(F.split("head", ","))
    h = h.withColumn("names", F.transform(names, lambda x: F.lower(trimmed(x))))
    return h.select("manifest_name", F.when(F.col("head").isNotNull(), F.size("names")).alias("n_cols"), *[F.coalesce(F.array_position("names", c), F.lit(0)).cast("int").alias(f"at_{c}") for c in COLUMNS])


def _with_heads(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines beside their manifest's header. Headers are sent to the tasks if they fit ``HEADS_BYTES``; else lines and headers are shuffled,
    but for the lines of the largest manifests."""
    size = heads.agg(F.sum(F.octet_length(F.coalesce("manifest_name", F.lit(""))) + F.lit(64))).first()[0] or 0
    if size <= HEADS_BYTES:
        return lines.join(F.broadcast(heads), "manifest_name", "left")
    counts = lines.groupBy("manifest_name").agg(F.count(F.lit(1)).alias("n"))
    return join_skewed(lines, heads, "manifest_name", hot_keys(counts, "manifest_name"), "left")


def _with_label(df: DataFrame, classes: DataFrame) -> DataFrame:
    """``df`` with label_ok, whether ``v_label`` is a declared label. Up to ``LABELS_LISTED`` labels become part of the expression; more are
    joined."""
    known = classes.where(F.col("label").isNotNull()).select("label").distinct()
    listed = [r.label for r in known.limit(LABELS_LISTED + 1).collect()]
    if len(listed) <= LABELS_LISTED:
        return df.withColumn("label_ok", F.coalesce(F.col("v_label").isin(listed), F.lit(False)))
    known = known.select(F.col("label").alias("v_label"), F.lit(True).alias("known"))
    return df.join(known, "v_label", "left").withColumn("label_ok", F.col("known").isNotNull())


def _judged(lines: DataFrame, heads: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines with the verdict of each rule, which is only meaningful where those before it hold, and ``conforms``. A line is parsed once; the
    pattern of quoted fields only runs on lines with a quote."""
    df = _with_heads(lines, heads).withColumn("line", _line(F.col("raw_line")))
    df = df.withColumns({"blank": F.col("line").isNull() | (trimmed(F.col("line")) == ""), "plain": F.coalesce(~F.contains("line", F.lit('"')), F.lit(False))})
    df = df.withColumn("quoted", F.col("plain") | F.coalesce(_well_quoted(F.col("line")), F.lit(False)))
    df = df.withColumn("f", F.when(F.col("plain"), F.split("line", ",")).when(F.col("quoted"), _fields(F.col("line"))))
    df = df.withColumn("counted", F.coalesce(F.size("f") == F.col("n_cols"), F.lit(False)))
    at = lambda c: F.when(F.col("counted") & (F.col(f"at_{c}") > 0), trimmed(F.try_element_at("f", F.col(f"at_{c}"))))
    df = df.withColumns({f"v_{c}": at(c) for c in COLUMNS})
    extensions = "|".join(e[1:] for e in IMAGE_EXTENSIONS)
    path_ok = F.col("v_path").rlike(rf"(?i)\.(?:{extensions})\z") & ~F.col("v_path").rlike(r"[\x00-\x1F\x{FFFD}]")
    split_ok = F.coalesce(F.col("v_split"), F.lit("")).isin("", *SPLITS) | F.lower("v_split").isin(*SPLITS)
    df = _with_label(df, classes).withColumns({"path_ok": F.coalesce(path_ok, F.lit(False)), "split_ok": split_ok})
    conforms = ~F.col("blank") & F.col("quoted") & F.col("counted") & F.col("path_ok") & F.col("label_ok") & F.col("split_ok")
    return df.withColumn("conforms", conforms)


class StrictLoad:
    """``raw`` has line_id (unique), manifest_name, line_no, raw_line and perhaps more columns, which are ignored;
    ``classes`` has the declared labels in ``label``.

    Every line is parsed once, into a table that keeps its offset, the verdicts, and its values or, if it doesn't conform, its text. From
    this table the conforming lines are loaded, their offsets are subtracted from all offsets, and the remainder is diagnosed.

    Empty tables give empty results. With an empty class list every line fails by its label. A line received twice
    counts under both ids. Lines of a manifest without a header, and null or blank lines, fail by ``column_count``.
    """

    def __init__(self, raw: DataFrame, classes: DataFrame):
        self.raw, self.classes = raw.select("line_id", "manifest_name", "line_no", "raw_line"), classes

    @cached_property
    def lines(self) -> DataFrame:
        """All lines but the headers: line_id, manifest_name, verdicts, values of those that conform, raw_line of the others."""
        lines = self.raw.where(F.col("line_no") > 1).select("line_id", "manifest_name", "raw_line")
        df = _judged(lines, cut(headers(self.raw)), self.classes)
        text = lambda c: F.when(F.col("conforms") & (F.col(f"v_{c}") != ""), F.col(f"v_{c}")).alias(c)
        return cut(df.select("line_id", "manifest_name", "conforms", *VERDICTS, *map(text, COLUMNS), F.when(~F.col("conforms"), F.col("raw_line")).alias("raw_line")))

    def loaded(self) -> DataFrame:
        """The conforming lines as index rows: line_id, path, label, split (train, val, test or null), group, domain."""
        return self.lines.where("conforms").select("line_id", "path", "label", split_of(F.col("split")).alias("split"), "group", "domain")

    def rejected(self) -> DataFrame:
        """The lines that were not loaded: line_id, reason, manifest_name, raw_line."""
        rest = self.lines.select("line_id", "manifest_name", "raw_line", *VERDICTS).join(self.loaded().select("line_id"), "line_id", "left_anti")
        reason = (
            F.when(F.col("blank"), "column_count")
            .when(~F.col("quoted"), "quoting")
            .when(~F.col("counted"), "column_count")
            .when(~F.col("path_ok"), "path")
            .when(~F.col("label_ok"), "label")
            .when(~F.col("split_ok"), "split")
        )
        return rest.select("line_id", reason.alias("reason"), "manifest_name", "raw_line")
