"""Relational building blocks of the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """Percent with two decimals, 0 if the whole is 0."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2), F.lit(0.0))


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per combination of keys; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n and its share of all rows. The total is one row, computed beside the groups."""
    n = counts(df, key)
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One row per value of ``row``, one column per listed value of ``column``, 0 where nothing is, and their sum ``total``."""
    t = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    t = t.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])
    return t.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)).cast("long"))


def filled(df: DataFrame, row: str, rows: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """row, column, n for every row value and every listed column value, 0 where nothing is. ``rows`` has the row values, once each."""
    n = counts(df.where(F.col(column).isin(columns)), row, column)
    grid = rows.select(row, F.explode(F.array(*map(F.lit, columns))).alias(column)) if columns else rows.select(row, F.lit("").alias(column)).limit(0)
    return grid.join(n, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))


def proportions(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """row, column, share: for every row value and listed column value, the percent of the column value's rows that have the row value."""
    df = df.where(F.col(row).isNotNull())
    n = filled(df, row, counts(df, row).select(row), column, columns)
    total = counts(df, column, name="total")
    return n.join(total, column).select(row, column, (100.0 * F.col("n") / F.col("total")).alias("share"))


def largest(by: str, key: str) -> Column:
    """Aggregate: the smallest ``key`` among those with the largest ``by``."""
    return F.min_by(F.col(key), F.struct(-F.col(by), F.col(key)))


def smallest(by: str, key: str) -> Column:
    """Aggregate: the smallest ``key`` among those with the smallest ``by``."""
    return F.min_by(F.col(key), F.struct(F.col(by), F.col(key)))


def first_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group. The order must be total for a defined result. Spark keeps at most ``n`` rows of a group
    in each task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def unpivoted(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value (double) for each value that is neither null nor NaN."""
    wide = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(keys, features, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
