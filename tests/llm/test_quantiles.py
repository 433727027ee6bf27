import math

import numpy as np

from pyspark.sql import functions as F

from plumbline.llm import quantiles as q
from plumbline.operators.incremental import Target

SCHEMA = "file_id long, label string, day int, width int, height int, sharpness double, n_width int"


def test_rank_error_of_merged_days(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "a" if k % 3 else None, int(rng.integers(30)), int(rng.integers(1, 100_000)), int(rng.choice([640, 1080])), float(rng.lognormal()), 1) for k in range(60_000)]
    rows += [(100_000 + k, "a", 1, [None, 0, -1][k % 3], 5, [None, math.nan, -2.0][k % 3], 1) for k in range(300)]
    df = spark.createDataFrame(rows + rows[:500], SCHEMA)
    files = q.files_once(df, "label", "day", *q.METRICS)
    days = q.sketches(files, ["label", "day"])
    got = {(r.label, r.metric): r for r in q.percentiles(q.merged(days, ["label"]), ["label"]).collect()}
    for label in ("a", None):
        for at, metric in ((3, "width"), (5, "sharpness")):
            values = np.sort([r[at] for r in rows if r[1] == label and r[at] is not None and not math.isnan(r[at]) and r[at] > 0])
            r = got[label, metric]
            assert r.n == len(values)
            for p in q.PERCENTS:
                rank = np.searchsorted(values, r[f"p{p}"], "right") / len(values)
                assert abs(rank - p / 100) < 0.004
    assert got["a", "height"].p50 in (640.0, 1080.0)


def test_small_groups_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([(k, "a", 1, k + 1, None, math.inf if k == 99 else 1.0, 0) for k in range(100)] + [(500, "b", 1, None, 0, math.nan, 0)], SCHEMA)
    got = {(r.label, r.metric): r for r in q.percentiles(q.sketches(q.files_once(df, "label", *q.METRICS), ["label"]), ["label"]).collect()}
    assert [got["a", "width"][f"p{p}"] for p in q.PERCENTS] == [1, 5, 25, 50, 75, 95, 99]
    assert got["b", "width"].n == 0 and got["b", "width"].p50 is None and got["a", "height"].n == 0
    assert q.percentiles(q.sketches(df.limit(0), ["label"]), ["label"]).count() == 0


def test_stored_days_are_combined_later(spark, tmp_path):
    """A day stored again replaces what was stored; merged days are as exact as one sketch of everything."""
    target = Target(spark, f"file://{tmp_path}/days")
    values = {day: [(label, day, (k * 37) % 101 + 1, k + 1, float(k)) for label in ("a", None) for k in range(n)] for day, n in (("2026-01-01", 150), ("2026-01-02", 90), (None, 20))}
    df = lambda rows: spark.createDataFrame(rows, "label string, day string, width int, height int, sharpness double")
    of = lambda rows: q.sketches(df(rows), ["label", "day"])
    assert q.store(target, of(values["2026-01-01"][:40]), "run1") == 1
    assert q.store(target, of(values["2026-01-02"] + values[None]), "run2") == 2
    assert q.store(target, of(values["2026-01-01"]), "run3") == 3
    everything = [x for rows in values.values() for x in rows]
    got = {tuple(r) for r in q.percentiles(q.combined(target, ["label"]), ["label"]).collect()}
    assert got == {tuple(r) for r in q.percentiles(q.sketches(df(everything), ["label"]), ["label"]).collect()} and len(got) == 6
    one = q.percentiles(q.combined(target, ["label"], "2026-01-02", "2026-01-02"), ["label"])
    assert {r.n for r in one.where("metric = 'width'").collect()} == {90}


def test_rank_errors(spark):
    rows = spark.createDataFrame([("a" if k % 3 else None, k + 1, (k * 7919) % 30_000 + 1, float(k % 5)) for k in range(30_000)] + [("empty", None, 0, float("nan"))], "label string, width int, height int, sharpness double")
    got = {(r.label, r.metric): (r.n, r.error) for r in q.rank_errors(rows, q.sketches(rows, ["label"]), "label").collect()}
    assert len(got) == 9 and got["empty", "width"] == (0, 0.0) and got["a", "width"][0] == 20_000
    assert all(e <= q.BOUND for _, e in got.values()) and any(e > 0 for _, e in got.values())
    wrong = q.sketches(rows.withColumn("width", F.col("width") + 600), ["label"])
    assert {r.error > 0.01 for r in q.rank_errors(rows, wrong, "label").where("metric = 'width' AND n > 0").collect()} == {True}
