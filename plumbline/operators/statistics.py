"""Rank and distribution statistics that need no global sort in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .relational import counts, unpivoted


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_r_{k}")), keys, F.lit(True))
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def ordered(values: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``values`` (keys, value, ``n`` times each, distinct) with ``below``, how often smaller values occur under the same keys, and ``total``.
    The values are range-partitioned and counted within partitions, from offsets of which there is one per partition and key; no task sorts
    all values of a key."""
    ranged = cut(values.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(n).alias("_t"))
    w = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_part", (F.sum("_t").over(w.orderBy("_part")) - F.col("_t")).alias("_before"), F.sum("_t").over(w).alias("total"))
    running = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy("value")) - F.col(n)
    return same_keys(ranged, sums, [*keys, "_part"]).withColumn("below", F.col("_before") + running).drop("_part", "_before")


#: How far around the middle, as a share of a group's values, the bounds of its median lie; their own error is a fifth of that.
AROUND, ACCURACY = 0.0005, 10_000


def medians(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys and the exact median of each feature (the mean of the two middle values of an even number), null without values. Null keys are
    a group. Values that are null or NaN are left out.

    A first pass finds bounds around each median by quantile summaries, whose error is bounded; a second counts how many values lie below and above
    them, and how often each value between them occurs. Only these counts are shuffled, so however many values a group has, no task holds them all.
    """
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    rows = df.select(*keys, *[c.alias(f) for f, c in value.items()])
    ends = F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND))
    bounds = [F.percentile_approx(f, ends, ACCURACY).alias(f"_b_{f}") for f in features]
    bounds = rows.groupBy(*keys).agg(*bounds) if keys else rows.agg(*bounds)
    held = same_keys(rows, bounds, keys) if keys else rows.join(F.broadcast(bounds))
    # Below and above the bounds only the number counts, so values there are taken for infinite.
    placed = lambda f: F.when(F.col(f) < F.col(f"_b_{f}")[0], float("-inf")).when(F.col(f) > F.col(f"_b_{f}")[1], float("inf")).otherwise(F.col(f))
    long = held.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), placed(f).alias("value")) for f in features])).alias("_x")).select(*keys, "_x.feature", "_x.value")
    n = long.where(F.col("value").isNotNull()).groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "feature")
    o = n.withColumns({"_upto": F.sum("_n").over(w.orderBy("value")), "_total": F.sum("_n").over(w)})
    low, high = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    within = lambda k: (F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto"))
    # Both middle places may fall on one value or on two.
    middle = o.where(within(low) | within(high))
    found = [F.avg(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    return middle.groupBy(*keys).agg(*found) if keys else middle.agg(*found)


def rank_sums(df: DataFrame, label: str, features: list[str], least: int = 1) -> DataFrame:
    """feature, label, n, ranks (sum of average ranks among all values of the feature), total (number of values), ties (sum of t^3 - t
    over groups of t equal values), flat (whether every class is constant). Values that are null or NaN, and classes with fewer than ``least`` values of a
    feature, are left out.

    Equal values are counted first, map-side; then :func:`ordered` ranks the distinct ones.
    """
    return rank_sums_of(unpivoted(df.where(F.col(label).isNotNull()), [label], features), label, least)


def rank_sums_of(long: DataFrame, label: str, least: int = 1) -> DataFrame:
    """:func:`rank_sums` of rows (feature, value, label)."""
    n = long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("feature", label).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    if least > 1:
        per = per.where(F.col("n") >= least)
        n = n.join(per.select("feature", label), ["feature", label], "left_semi")
    values = n.groupBy("feature", "value").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("of"))
    ranked = cut(ordered(values, ["feature"], "t").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2).drop("total"))
    sums = ranked.select("feature", "rank", "t", F.explode("of").alias(label, "n")).groupBy("feature", label).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("ranks"))
    t = F.col("t").cast("double")
    whole = ranked.groupBy("feature").agg(F.sum("t").alias("total"), F.sum(t * t * t - t).alias("ties"))
    flat = per.groupBy("feature").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("flat"), F.count(F.lit(1)).alias("classes"))
    return sums.join(F.broadcast(whole.join(flat, "feature")), "feature")


def single_feature_auc(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, auc: how well each feature on its own separates the classes. Per class the area under the curve of class against rest,
    folded to at least a half, and their mean; 0.5 with under 10 values or under two classes. Features without any value have no row."""
    s = rank_sums(df, label, features)
    n, rest = F.col("n"), F.col("total") - F.col("n")
    area = (F.col("ranks") - n * (n + 1) / 2) / (n.cast("double") * F.nullif(rest, F.lit(0)))
    folded = F.greatest(area, 1 - area)
    good = (F.first("total") >= 10) & (F.first("classes") >= 2)
    return s.groupBy("feature").agg(F.when(good, F.avg(folded)).otherwise(F.lit(0.5)).alias("auc"))


def kruskal(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, h, effect (epsilon squared), dof: Kruskal-Wallis over the classes with at least two values; features with under
    two such classes or constant ones are left out. The effect relates to all rows of ``df``, values missing or not."""
    s = rank_sums(df, label, features, 2).where(~F.col("flat") & (F.col("classes") > 1))
    total = F.first("total").cast("double")
    raw = 12 / (total * (total + 1)) * F.sum(F.col("ranks") * F.col("ranks") / F.col("n")) - 3 * (total + 1)
    h = raw / F.nullif(1 - F.first("ties") / (total * total * total - total), F.lit(0.0))
    rows = df.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("rows"))
    out = s.groupBy("feature").agg(h.alias("h"), (F.first("classes") - 1).alias("dof")).join(F.broadcast(rows))
    return out.select("feature", "h", F.coalesce(F.col("h") / F.nullif(F.col("rows") - 1, F.lit(0)), F.lit(0.0)).alias("effect"), "dof")


def js_distance(df: DataFrame, label: str, side: str, a: str, b: str) -> DataFrame:
    """One row, js: the square root of the Jensen-Shannon divergence, base 2, of the label distributions of two values of ``side``."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count_if(F.col(side) == a).alias("p"), F.count_if(F.col(side) == b).alias("q"))
    both = n.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    x = n.join(F.broadcast(both)).select((F.col("p") / F.nullif(F.col("sp"), F.lit(0))).alias("p"), (F.col("q") / F.nullif(F.col("sq"), F.lit(0))).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return x.agg(F.sqrt(F.greatest(F.sum(term("p") + term("q")) / 2, F.lit(0.0))).alias("js"))


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, chi2 and dof, of the table of two columns without their nulls; with one degree of freedom each deviation is first
    reduced by up to a half (Yates). An empty table gives a null statistic."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = counts(df, a, b)
    rows, columns = counts(df, a, name="r"), counts(df, b, name="c")
    one = rows.agg(F.count(F.lit(1)).alias("nr"), F.sum(1 / F.col("r")).alias("sr"), F.sum("r").alias("total")).join(columns.agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("sc")))
    x = cells.join(rows, a).join(columns, b).join(F.broadcast(one))  # empty cells add nothing to the sum of n^2 / expected
    expected = F.col("r") * F.col("c") / F.col("total")
    off = F.abs(F.col("n") - expected)
    off = off - F.least(off, F.lit(0.5))  # with one degree of freedom all four cells deviate equally
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    yates = F.max(off * off) * F.max("total") * F.max("sr") * F.max("sc")
    plain = F.when(F.max("total").isNotNull(), F.greatest(F.sum(F.col("n") * F.col("n") / expected) - F.max("total"), F.lit(0.0)))
    return x.agg(F.when(F.max(dof) == 1, yates).otherwise(plain).alias("chi2"), F.max(dof).alias("dof"))


def robust_z(df: DataFrame, group: str, value: Column) -> DataFrame:
    """``df`` with z, the distance of the value to its group's median in units of 1.4826 median absolute deviations; 0 where that is
    0, null where the value is null. Medians are exact; the groups' few rows are joined back."""
    df = df.withColumn("_x", value)
    off = same_keys(df, medians(df, [group], ["_x"]).withColumnRenamed("_x", "_m"), [group], "left").withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    out = same_keys(off, medians(off, [group], ["_d"]).withColumn("_mad", F.col("_d") * 1.4826).drop("_d"), [group], "left")
    z = F.when(F.col("_x").isNull(), None).when(F.col("_mad") > 0, (F.col("_x") - F.col("_m")) / F.col("_mad")).otherwise(0.0)
    return out.withColumn("z", z).drop("_x", "_m", "_d", "_mad")


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: ratio of the largest to the smallest class (1 with fewer than two), largest, smallest (ties by name), classes."""
    n = counts(df.where(F.col(label).isNotNull()), label)
    several = F.count(F.lit(1)) > 1
    return n.agg(
        F.when(several, F.max("n") / F.min("n")).otherwise(1.0).alias("ratio"),
        F.when(several, F.min_by(label, F.struct(-F.col("n"), F.col(label)))).alias("largest"),
        F.when(several, F.min_by(label, F.struct("n", label))).alias("smallest"),
        F.count(F.lit(1)).alias("classes"),
    )


def chi2_survival(x: float, dof: int) -> float:
    """The probability that a chi-squared variable exceeds x: the regularized upper incomplete gamma function, by its series below
    the bend and its continued fraction above."""
    if x is None or dof <= 0 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
