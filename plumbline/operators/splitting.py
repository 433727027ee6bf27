"""Group inference from file names and suggested splits that keep groups and duplicates together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import connected_components

# The patterns tried on file names, in this order.
GROUP_PATTERNS = (
    r"^(?P<group>[A-Za-z]*\d+)[_\-\s]",
    r"^(?P<group>[A-Za-z0-9]+)[_\-\s]",
    r"^(?P<group>.+)[_\-]\d+\.[A-Za-z]+$",
)
#: Places of a group's hash, among which the bounds of the splits are chosen.
PLACES = 4096


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def java_regex(pattern: str) -> tuple[str, int]:
    """A Python pattern with a group named ``group`` as a Java pattern, and that group's number. Raises ``ValueError`` if it has none or is
    invalid."""
    try:
        index = re.compile(pattern).groupindex.get("group")
    except re.error as x:
        raise ValueError(f"invalid group pattern: {x}") from x
    if index is None:
        raise ValueError("the group pattern needs a named group: (?P<group>...)")
    return re.sub(r"\(\?P<[^>]*>", "(", pattern), index


def group_from_name(path: Column, pattern: str) -> Column:
    """The part of the file name that the pattern's named group finds anywhere; null if nothing."""
    rx, index = java_regex(pattern)
    name = basename(path)
    return F.when(name.rlike(rx), F.regexp_extract(name, rx, index))


def group_coverage(df: DataFrame, path: str, label: str) -> DataFrame:
    """One row with n, labels, and for each pattern k covered_k, the files it finds a group for, and groups_k, the groups found. One pass
    over the data."""
    found = {f"g{k}": group_from_name(F.col(path), p) for k, p in enumerate(GROUP_PATTERNS)}
    df = df.select(F.col(label).alias("label"), *[c.alias(n) for n, c in found.items()])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), *[a for k in range(len(found)) for a in (F.count(f"g{k}").alias(f"covered_{k}"), F.count_distinct(f"g{k}").alias(f"groups_{k}"))])


def infer_groups(df: DataFrame, path: str, label: str) -> str | None:
    """The first pattern that covers at least 90 % of the files with enough groups, at least three and two per label, but not more than
    half as many as files."""
    r = group_coverage(df, path, label).first()
    for k, pattern in enumerate(GROUP_PATTERNS):
        covered, groups = r[f"covered_{k}"], r[f"groups_{k}"]
        if r["n"] and covered >= 0.9 * r["n"] and max(3, 2 * r["labels"]) <= groups <= 0.5 * r["n"]:
            return pattern
    return None


def split_groups(df: DataFrame, key: str, group: str, components: DataFrame | None = None) -> DataFrame:
    """key, unit: files with one declared group, or linked as duplicates, directly or through others, share a unit; any other file is its
    own. ``components`` has node and component."""
    unit = F.coalesce(F.concat(F.lit("g:"), F.col(group)), F.concat(F.lit("f:"), F.col(key).cast("string")))
    files = df.select(key, unit.alias("unit"))
    if components is None:
        return files
    edges = files.join(components, files[key] == components["node"]).select("unit", F.concat(F.lit("d:"), F.col("component").cast("string")).alias("cluster"))
    merged = cut(connected_components(edges, "unit", "cluster")).withColumnsRenamed({"node": "unit", "component": "merged"})
    return files.join(merged, "unit", "left").select(key, F.coalesce("merged", "unit").alias("unit"))


def suggest_splits(df: DataFrame, key: str, label: str, units: DataFrame, seed: int = 42, least: int = 14) -> DataFrame | None:
    """key, unit, split: about 5/7 train, 1/7 val and 1/7 test of every label, all files of a unit in one split; null with fewer than
    ``least`` units.

    A unit's hash gives it one of a fixed number of places, and its most frequent label the bounds between the splits; the bounds are
    chosen from the counts per label and place, so they fall where a seventh of the label's files is reached.
    """
    files = cut(df.select(key, F.coalesce(F.col(label), F.lit("")).alias("label")).join(units, key))
    per = files.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(PLACES)).cast("int").alias("place")
    unit = cut(per.groupBy("unit").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.sum("n").alias("n")).select("unit", "label", "n", place))
    if unit.limit(least).count() < least:
        return None
    bounds: dict[str, tuple[int, int]] = {}
    sums: dict[str, list[tuple[int, int]]] = {}
    for r in unit.groupBy("label", "place").agg(F.sum("n").alias("n")).collect():  # labels times places
        sums.setdefault(r.label, []).append((r.place, r.n))
    for name, of in sums.items():
        total, run, cuts = sum(n for _, n in of), 0, []
        for at, n in sorted(of):
            for k in (1, 2):
                if len(cuts) < k and run + n / 2 >= total * k / 7:
                    cuts.append(at)
            run += n
        bounds[name] = (cuts + [PLACES, PLACES])[0], (cuts + [PLACES, PLACES])[1]
    rows = df.sparkSession.createDataFrame([(k, *v) for k, v in bounds.items()], "label string, test_end int, val_end int")
    split = F.when(F.col("place") < F.col("test_end"), "test").when(F.col("place") < F.col("val_end"), "val").otherwise("train")
    chosen = unit.join(rows, "label").select("unit", split.alias("split"))
    return files.select(key, "unit").join(chosen, "unit").select(key, "unit", "split")
