from collections import Counter, defaultdict

import numpy as np

from plumbline.llm import grouped_split as g

INDEX = "file_id long, label string, group_key string, split string, component int"


def rows_of(n, hot=0.0):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(n):
        group = "hot" if rng.random() < hot else f" G{int(rng.pareto(1.1) * 40) % 900}" if rng.random() < 0.8 else [None, "", "nan", " NaN "][k % 4]
        rows.append((k, [None, "a", "b", "c"][int(rng.choice(4, p=[0.02, 0.68, 0.2, 0.1]))], group, "train", k))
    return rows + rows[:30]


def shares(out, key=lambda r: 0):
    n = Counter((key(r), r.split) for r in out)
    total = Counter(key(r) for r in out)
    return {k: v / total[k[0]] for k, v in n.items()}


def test_whole_groups_and_shares(spark):
    for hot, tol in ((0.0, 0.01), (0.33, 0.02)):
        files = g.files_of(spark.createDataFrame(rows_of(6000, hot), INDEX))
        out = g.assign(files, block=300).collect()
        assert len(out) == len({r.file_id for r in out}) == 6000
        of = defaultdict(set)
        for r in out:
            of[r.component].add(r.split)
        assert all(len(s) == 1 for s in of.values())
        for name, want in zip(g.SPLITS, g.SHARES, strict=True):
            assert abs(shares(out)[0, name] - want) < tol
            for label in ("a", "b", "c"):
                assert abs(shares(out, lambda r: r.label)[label, name] - want) < 0.03


def test_annealing_improves_on_the_start():
    rng = np.random.default_rng(3)
    of = [[(int(rng.integers(5)), int(rng.integers(1, 9)))] for _ in range(400)]
    have = np.zeros(5)
    for c in of:
        for k, v in c:
            have[k] += v
    target = np.array(g.SHARES)[:, None] * have

    def off(split):
        x = -target.copy()
        for c, s in zip(of, split, strict=True):
            for k, v in c:
                x[s, k] += v
        return (x**2).sum()

    start = [g.hashed(str(k)) for k in range(400)]
    end = g.anneal(of, start, target, 1)
    assert off(end) < off(start) / 20
    assert end == g.anneal(of, start, target, 1)


def test_torn(spark):
    rows = [(1, "a", " X", "train", 0), (2, "a", "x ", "dev", 0), (3, "a", "y", "train", 0), (4, "a", "y", "holdout", 0), (5, "a", "nan", "train", 0), (6, "a", "NAN", "test", 0), (7, "a", None, "test", 0), (8, "a", "z", None, 0), (9, "a", "z", "test", 0)]
    df = spark.createDataFrame(rows, INDEX)
    assert [r.group_key for r in g.torn(df).collect()] == ["x"]
    assert g.torn(df.limit(0)).count() == 0


def test_empty_and_one(spark):
    df = spark.createDataFrame([(1, None, None, "train", 0)], INDEX)
    assert g.assign(g.files_of(df.limit(0))).count() == 0
    assert g.assign(g.files_of(df)).count() == 1
