import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import learners, probes


def drawn(n, classes, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 4))
    x[:, 1] += y * 1.5
    x[:, 2] = np.where(rng.random(n) < 0.2, np.nan, x[:, 2])
    return x, y


@pytest.mark.parametrize("classes", [2, 4])
def test_boosted_trees_on_held_out_rows(classes):
    (x, y), (tx, ty) = drawn(3000, classes), drawn(2000, classes, 2)
    p = learners.boosted(x, y, classes, tx, 0)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == ty).mean() > {2: 0.74, 4: 0.5}[classes]
    assert np.array_equal(p, learners.boosted(x, y, classes, tx, 0))
    noise = learners.boosted(x[:, [0, 3]], y, classes, tx[:, [0, 3]], 0)
    assert abs(learners.area(noise[:, 1], ty == 1) - 0.5) < 0.06


def test_missing_values_and_shapes_beyond_a_line():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no single feature tells
    x[rng.random(2000) < 0.3, 0] = np.nan
    y[np.isnan(x[:, 0])] = 1
    p = learners.boosted(x[:1500], y[:1500], 2, x[1500:], 0)
    assert learners.area(p[:, 1], y[1500:] == 1) > 0.95
    assert learners.boosted(np.full((20, 1), np.nan), np.arange(20) % 2, 2, np.full((3, 1), np.nan), 0).shape == (3, 2)


def test_linear_model_is_at_its_minimum():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    x[:, 0] += y
    dense = learners.linear(x, y, 3, x, 1.0, 500)
    at = np.nonzero(np.ones_like(x))
    sparse = learners.Sparse(np.arange(301) * 5, at[1], x[at], 5)
    assert np.allclose(dense, learners.linear(sparse, y, 3, sparse, 1.0, 500), atol=1e-3)
    own = np.eye(3)[y]
    assert np.abs((dense - own).sum(0)).max() / 300 < 1e-3  # offsets are free, so their slopes vanish
    assert (dense.argmax(1) == y).mean() > 0.5


def test_area_equals_counted_pairs():
    rng = np.random.default_rng(5)
    s, own = rng.integers(0, 9, 200).astype(float), rng.random(200) < 0.3
    a, b = s[own][:, None], s[~own][None, :]
    assert abs(learners.area(s, own) - ((a > b).mean() + (a == b).mean() / 2)) < 1e-12


def test_weighted_runs():
    a, b = learners.weighted_runs([["x", "x", "y"], ["y"], []], [["x", "new"]])
    assert a.shape == (3, 2) and b.shape == (1, 2)
    dense = a @ np.eye(2)
    assert np.allclose(np.linalg.norm(dense, axis=1), [1, 1, 0]) and np.isclose((b @ np.eye(2)).max(), 1)
    rarity = [np.log(4 / 2) + 1, np.log(4 / 3) + 1]
    want = np.array([2 * rarity[0], rarity[1]])
    assert np.allclose(sorted(dense[0]), sorted(want / np.linalg.norm(want)))


def test_subsample_of_a_hot_class(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") < 4, None).otherwise("a").alias("label"))
    few = spark.createDataFrame([(30_000 + k, "c") for k in range(4)], "id long, label string")
    got = probes.subsample(df.unionByName(few), "label", 100, 7, "id").collect()
    assert sorted(r.label for r in got) == ["a"] * 100 + ["b"] * 100 and {r.place for r in got} == set(range(1, 101))
    again = probes.subsample(df.unionByName(few).repartition(7), "label", 100, 7, "id").collect()
    assert {r.id for r in got} == {r.id for r in again}


def test_probes(spark):
    rows = [(k, "abc"[k % 3], float(k % 3) if k % 5 else None, f"{'xyz'[k % 3]}{k}.png", [float(k % 7), float(k % 3)]) for k in range(300)] + [(1000, "d", 1.0, "d.png", [1.0, 1.0]), (1001, None, 1.0, "e.png", None)]
    df = spark.createDataFrame(rows, "id long, label string, v double, path string, vec array<double>")
    for r in (probes.numeric_probe(df, "id", "label", {"v": F.col("v")}), probes.vector_probe(df, "id", "label", "vec"), probes.filename_probe(df, "id", "label", "path", [])):
        assert r.n == 300 and r.classes == 3 and r.auc > 0.85
    assert probes.numeric_probe(df.where("label = 'a'"), "id", "label", {"v": F.col("v")}) is None
    assert probes.vector_probe(df.limit(0), "id", "label", "vec") is None
    chance = probes.numeric_probe(df, "id", "label", {"v": F.xxhash64("id").cast("double")})
    assert abs(chance.auc - 0.5) < 0.1


def test_runs_equal_those_of_the_expression(spark):
    for text in ("ab c", "", "  a  bcdef\t12 ", "é ü-x"):
        assert sorted(learners.runs_of(text)) == sorted(spark.range(1).select(probes.char_grams(F.lit(text))).first()[0])
