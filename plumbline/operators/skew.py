"""Joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 64


def hot_keys(counts: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The non-null keys of ``counts(key, n)``, one row per key, with more than ``share`` of the sum of ``n``.
    At most ``1 / share`` keys can be; only they reach the driver."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col(key).isNotNull() & (F.col("n") > F.lit(float(total * share)))).select(key).collect()
    return [r[0] for r in rows]


def among(column: Column, keys: list) -> Column:
    """Whether the column is one of the keys; never null."""
    return F.coalesce(column.isin(keys), F.lit(False)) if keys else F.lit(False)


def join_skewed(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "left", also: tuple[str, ...] = ()) -> DataFrame:
    """Join ``big`` with ``small``, which has at most one row per key. The rows of hot keys never move: their
    at most ``len(hot)`` rows of ``small`` are broadcast. The rest is joined by a shuffle. ``how`` is inner, left,
    left_semi or left_anti. ``also`` names further columns that must be equal."""
    on = [key, *also]
    if not hot:
        return big.join(small, on, how)
    cold = big.where(~among(F.col(key), hot)).join(small.where(~among(F.col(key), hot)), on, how)
    warm = big.where(among(F.col(key), hot)).join(F.broadcast(small.where(among(F.col(key), hot))), on, how)
    return cold.unionByName(warm)
