import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.incremental import Target, changed, complete_object, pending, run_once

INDEX = "file_id long, path string, bytes long, mtime_ns long"
FEATURES = "key string, data string, run_id long"
RUNS = "run_id long, status string"


def test_complete_objects(spark):
    cases = [('{"readable": true}', True), ('{"readable": null, "a": [1, {"b": 2}]}', True), ('{"readable": true', False), ("", False), (None, False), ("null", False), ("[]", False),
             ('[{"readable": true}]', False), ("{}", False), ('{"a": {"readable": 1}}', False), ('{"readable": true} {"x": 1}', False), ('{"readable": true}, {"x": 1}', False), ('{"readable": tru', False), (" {\"readable\": false} ", True)]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, data string")
    got = {r.k: r.ok for r in df.select("k", complete_object(F.col("data"), "readable").alias("ok")).collect()}
    assert got == {k: ok for k, (_, ok) in enumerate(cases)}


def test_pending(spark):
    index = spark.createDataFrame([(1, "a", 5, 7), (1, "a", 5, 7), (2, "b", 5, 7), (3, "c", 5, None), (4, "d", 5, 8), (5, None, 5, 8), (6, "f", None, 8), (7, "g", 1, 1)], INDEX)
    good = '{"readable": true}'
    features = spark.createDataFrame([("a|5|7|v1|t64", good, 1), ("b|5|7|v1|t64", good, 2), ("d|5|7|v1|t64", good, 1), ("g|1|1|v1|t64", '{"readable"', 1), (None, good, 1), ("g|1|1|v0|t64", good, 1), ("g|1|1|v1|t64", good, 9)], FEATURES)
    runs = spark.createDataFrame([(1, "succeeded"), (1, "succeeded"), (2, "failed"), (3, None)], RUNS)
    assert sorted(r.file_id for r in pending(index, features, runs).collect()) == [2, 4, 5, 6, 7]
    assert pending(index.limit(0), features, runs).count() == 0
    assert sorted(r.file_id for r in pending(index, features.limit(0), runs).collect()) == [1, 2, 4, 5, 6, 7]
    assert pending(index.withColumn("key", F.lit(1)), features.withColumn("path", F.lit(1)), runs.withColumn("key", F.lit(1))).count() == 5


SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("v", T.LongType())])


def source_of(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, version long, x long")


def step(df):
    return df.select("key", "version", (F.col("x") * 10).alias("v"))


def held(target):
    return sorted(map(tuple, target.read(SCHEMA).collect()))


def test_changed(spark):
    source = source_of(spark, ("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("b", 1, 3), ("c", None, 4), ("c", None, 4), (None, 1, 5), ("d", 1, 6))
    done = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 2)], "key string, version long")
    assert sorted((r.key, r.version) for r in changed(source, done).collect()) == [("a", 2), ("c", None), ("d", 1)]
    assert changed(source.limit(0), done).count() == 0 and changed(source, done.limit(0)).count() == 4


def test_runs_survive_failures_and_rivals(spark, tmp_path):
    target = Target(spark, f"file://{tmp_path}/t")
    source = source_of(spark, ("a", 1, 1), ("b", 1, 2), ("b", 1, 2))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_once(source, target, SCHEMA, broken)
    assert target.version() == 0 and held(target) == []
    assert run_once(source, target, SCHEMA, step) == 1
    assert run_once(source, target, SCHEMA, step) == 1  # nothing new
    with pytest.raises(Exception):  # fails while writing: nothing is published
        run_once(source.union(source_of(spark, ("c", 1, 0))), target, SCHEMA, lambda df: df.select("key", "version", F.raise_error(F.lit("no")).cast("long").alias("v")))
    assert target.version() == 1
    assert run_once(source.union(source_of(spark, ("c", 1, 3))), target, SCHEMA, step) == 2
    assert held(target) == [("a", 1, 10), ("b", 1, 20), ("c", 1, 30)]
    with pytest.raises(FileExistsError):  # a rival published version 2 first
        target.publish(spark.createDataFrame([("z", 1, 1)], SCHEMA), 1)
    assert len(held(target)) == 3
    target.vacuum(1)
    assert len(held(target)) == 3 and target.version() == 2


def test_a_new_version_takes_the_place_of_the_old_one(spark, tmp_path):
    target = Target(spark, f"file://{tmp_path}/t")
    rows = {k: (k, 1, n) for n, k in enumerate("abcdefghijklmnop")}
    run_once(source_of(spark, *rows.values()), target, SCHEMA, step)
    rng = random.Random(3)
    for run in range(2, 14):  # small runs, so that parts pile up, are merged, and lists of gone keys too
        for k in rng.sample(sorted(rows), 2):
            rows[k] = (k, run, run * 100 + ord(k[0]))
        rows[f"new{run}"] = (f"new{run}", run, run)
        assert run_once(source_of(spark, *rows.values()), target, SCHEMA, step) == run
        assert held(target) == sorted((k, v, 10 * x) for k, v, x in rows.values())
        assert len(target._lists(run)["parts"]) <= 6
    one = source_of(spark, *rows.values()).where("key = 'a'")
    assert run_once(one, target, SCHEMA, step) == 13  # what the source lacks stays, and is not due
    before = held(target)
    assert target.vacuum(2) and held(target) == before and target._versions() == [12, 13]


def test_of_two_rivals_one_wins(spark, tmp_path):
    target = Target(spark, f"file://{tmp_path}/t")
    for name in ("000000000001.json", "000000000002.json"):
        with ThreadPoolExecutor(8) as pool:
            assert sum(pool.map(lambda k, n=name: target._create(n, f"{k}"), range(32))) == 1
    assert not [n for n in os.listdir(f"{tmp_path}/t/_versions") if n.endswith(".staged")]


def test_rivals_with_whole_runs(spark, tmp_path):
    folder = f"file://{tmp_path}/t"

    def run(k):
        try:
            Target(spark, folder).publish(spark.createDataFrame([(f"k{k}", 1, k)], SCHEMA), 0)
            return k
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(run, range(4)) if k is not None]
    assert len(won) == 1 and held(Target(spark, folder)) == [(f"k{won[0]}", 1, won[0])]
