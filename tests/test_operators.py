import math
import os
import random
from statistics import median
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import audits, duplicates, probes, relational, splitting, statistics
from plumbline.operators.duplicates import Duplicates, chunks, exact_groups, near_hashes
from plumbline.operators.graph import connected_components
from plumbline.operators.skew import hot_keys, join_skewed
from plumbline.plans import checks
from plumbline.plans.findings import Severity

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def bits(a, b):
    return bin((a ^ b) & MASK).count("1")


def components_of(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_chunks_cover_64_bits():
    for n in (1, 2, 5, 7, 9, 64):
        c = chunks(n)
        assert len(c) == n and sum(w for _, w in c) == 64 and all(a + w == b for (a, w), (b, _) in zip(c, c[1:]))
    with pytest.raises(ValueError):
        chunks(0)


@pytest.mark.parametrize("threshold,clean", [(4, 2), (6, 2), (8, 1), (0, 1), (6, 3)])
def test_near_hashes_equal_brute_force(spark, threshold, clean):
    rnd = random.Random(threshold)
    h = [rnd.getrandbits(64) for _ in range(200)] + [0, 2**63, MASK]
    for _ in range(60):
        x = rnd.choice(h)
        for b in rnd.sample(range(64), rnd.randint(1, 9)):
            x ^= 1 << b
        h.append(x)
    h = sorted({signed(x) for x in h})
    df = spark.createDataFrame([(x,) for x in h] + [(None,)], "h long")
    got = {tuple(r) for r in near_hashes(df, "h", threshold, clean=clean).collect()}
    assert got == {(a, b, bits(a, b)) for a in h for b in h if a < b and bits(a, b) <= threshold}
    assert near_hashes(df.limit(0), "h", threshold, clean=clean).count() == 0


def test_duplicates(spark):
    """Components by content and signatures as from all pairs; copies stay in stars; blank rows only match exactly."""
    rnd = random.Random(7)
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(30)]
    rows = []
    for k in range(300):
        p, d = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 2, 5, 8])):
            p ^= 1 << rnd.randrange(64)
        for _ in range(rnd.choice([0, 0, 4, 12])):
            d ^= 1 << rnd.randrange(64)
        rows.append((k, rnd.choice([None, f"c{k}", f"c{k}", f"c{k // 9}"]), signed(p) if rnd.random() < 0.9 else None, signed(d), rnd.random() < 0.1, rnd.choice(["train", "test", None]), "x"))
    df = spark.createDataFrame(rows, "id long, content string, h long, d long, blank boolean, split string, a string")
    usable = lambda r: r[2] is not None and not r[4]
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] is not None and a[1] == b[1]) or (usable(a) and usable(b) and bits(a[2], b[2]) <= 6 and bits(a[3], b[3]) <= 10))}
    dups = Duplicates(df, "id", "content", "h", "d", 6, 10, F.col("blank"))
    assert {r.node: r.component for r in dups.components.collect()} == components_of(pairs)
    got = {r.id for r in dups.touching(F.col("split") == "test", F.col("split") == "train").collect()}
    assert got == {x for a, b in pairs for x, y in ((a, b), (b, a)) if rows[x][5] == "test" and rows[y][5] == "train"}
    empty = Duplicates(df.limit(0), "id", "content", "h", "d", 6, 10)
    assert empty.links.count() == empty.components.count() == 0


def test_duplicate_fixtures(spark):
    one = lambda rows, t=6, blank=None, **kw: {r.node: r.component for r in Duplicates(spark.createDataFrame(rows, "id int, c string, h long, d long"), "id", "c", "h", "d", t, kw.get("second", 64), blank).components.collect()}
    assert one([(0, "a", 0, 0), (1, "a", 0, 0), (2, "b", 7, 0), (3, "c", -1, 0), (4, "d", -4, 0)]) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert one([(0, "a", 0, 0), (1, "b", 0, 0), (2, "c", 0, 0)], blank=F.lit(True)) == {}
    assert one([(0, "a", 1, 0), (1, "b", 3, 2**20 - 1), (2, "c", 255 << 8, 5), (3, "d", 255 << 8, 4)], second=10) == {2: 2, 3: 2}
    assert one([(0, "a", 0, 0), (1, "a", -1, -1)]) == {0: 0, 1: 0}


def test_verified_by_vectors(spark):
    rows = [(0, "a", 0, 0, [1.0, 0.0]), (1, "b", 1, 0, [0.9, 0.1]), (2, "c", 2, 0, [0.0, 1.0]), (3, "d", 4, 0, None), (4, "a", 0, 0, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "id int, c string, h long, d long, v array<double>")
    links = {(r.a, r.b) for r in Duplicates(df, "id", "c", "h", "d", 6, 10, None, "v", 0.65).links.collect()}
    assert (0, 1) in links and (0, 2) not in links and (0, 3) in links and (0, 4) in links


@pytest.mark.parametrize("block", [128, 3])
def test_vectors_equal_all_pairs(spark, monkeypatch, block):
    """Classes of equal signatures hold look-alikes and copies; vectors aren't transitive, may be missing or without edges."""
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rnd = random.Random(11)
    turn = lambda x: [math.cos(x), math.sin(x)]
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(6)]
    rows = []
    for k in range(240):
        p, d = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 0, 2, 5, 8])):
            p ^= 1 << rnd.randrange(64)
        v = rnd.choice([turn(rnd.randrange(12) * 0.5)] * 14 + [[0.0, 0.0], None])
        rows.append((k, rnd.choice([f"c{k}"] * 9 + [None]), signed(p), signed(d), v, rnd.choice(["train", "test", "val", None])))
    rows += [(300 + k, "copy", 1, 1, [0.0, 0.0], s) for k, s in enumerate(["train", "test", "test"])] + [(400, "d", 1, 1, [0.0, 0.0], "train")]
    # The look-alike with the smallest key must not hide that the other two are one picture.
    rows += [(500, "r", 99, 99, turn(0), "train"), (501, "m", 99, 99, turn(1.5), "test"), (502, "t", 99, 99, turn(1.6), "train")]
    df = spark.createDataFrame(rows, "id long, c string, h long, d long, v array<double>, split string")

    def linked(a, b):
        if a[1] is not None and a[1] == b[1]:
            return True
        near = bits(a[2], b[2]) <= 6 and bits(a[3], b[3]) <= 10
        return near and (a[4] is None or b[4] is None or sum(x * y for x, y in zip(a[4], b[4])) >= 0.65)

    of = {r[0]: r[5] for r in rows}
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and linked(a, b)}
    dups = Duplicates(df, "id", "c", "h", "d", 6, 10, None, "v", 0.65)
    links = {(r.a, r.b) for r in dups.links.collect()}
    assert links <= pairs and (501, 502) in links and (500, 501) not in links and (300, 400) not in links
    assert {r.node: r.component for r in dups.components.collect()} == components_of(pairs)
    got = {r.id for r in dups.touching(F.col("split") == "test", F.col("split") == "train").collect()}
    assert got == {x for a, b in pairs for x, y in ((a, b), (b, a)) if of[x] == "test" and of[y] == "train"}
    empty = Duplicates(df.limit(0), "id", "c", "h", "d", 6, 10, None, "v", 0.65)
    assert empty.links.count() == empty.components.count() == 0


@pytest.mark.parametrize("vector", [None, "v"])
def test_conflicts_equal_all_pairs(spark, vector):
    rnd = random.Random(5)
    turn = lambda x: [math.cos(x), math.sin(x)]
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(40)]
    rows = []
    for k in range(200):
        p, d = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 3, 6])):
            p ^= 1 << rnd.randrange(64)
        rows.append((k, rnd.choice([None, f"c{k}", f"c{k}", f"c{k // 7}"]), signed(p), signed(d), turn(rnd.randrange(8) * 0.5), rnd.random() < 0.1, rnd.choice(["x"] * 6 + ["y", None])))
    df = spark.createDataFrame(rows, "id long, c string, h long, d long, v array<double>, blank boolean, label string")

    def linked(a, b):
        if a[1] is not None and a[1] == b[1]:
            return True
        near = not a[5] and not b[5] and bits(a[2], b[2]) <= 6 and bits(a[3], b[3]) <= 10
        return near and (not vector or sum(x * y for x, y in zip(a[4], b[4])) >= 0.65)

    want = {x[0] for a in rows for b in rows if a[0] < b[0] and linked(a, b) and a[6] != b[6] for x in (a, b)}
    got = [r.id for r in Duplicates(df, "id", "c", "h", "d", 6, 10, F.col("blank"), vector, 0.65).conflicting("label").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 200


def test_label_conflict_counts_every_file(spark):
    """A class of 50 files of one label, the smallest key among them, and one of another."""
    rows = [(f"{k:03d}", f"c{k}", 5, 6, "a" if k < 50 else "b", f"r{k}") for k in range(51)] + [("900", "d", -1, -1, "a", "r900"), ("901", "e", -1, -1, "a", "r901")]
    dups = Duplicates(spark.createDataFrame(rows, "id string, c string, h long, d long, label string, relpath string"), "id", "c", "h", "d", 6, 10)
    ctx = SimpleNamespace(duplicates=dups, max_examples=3, pair_grid=lambda *_: [])
    found = checks.label_conflict(ctx)[0]
    assert found[0] is Severity.BLOCKER and found[2] == {"pairs": 1, "images": 51}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(pairs + [(None, 1), (5, 5)], "x int, y int")
    got = {r.node: r.component for r in connected_components(df, "x", "y").collect()}
    assert got == {r.node: r.component for r in connected_components(df, "x", "y", bound=0).collect()}
    named = df.select(F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"))
    assert {(r.node, r.component) for r in connected_components(named, "x", "y").collect()} == {(r.node, r.component) for r in connected_components(named, "x", "y", bound=0).collect()}
    assert got == components_of([p for p in pairs if p[0] != p[1]])
    assert connected_components(df.limit(0), "x", "y").count() == 0


def test_exact_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, c string")
    assert {(r.id, r["first"], r.n) for r in exact_groups(df, "id", "c").collect()} == {(1, 1, 2), (2, 1, 2)}


def test_skewed_join(spark):
    big = spark.createDataFrame([("hot" if k % 3 else f"k{k % 7}", k) for k in range(300)] + [(None, 1)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, w int")
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), "k", 0.3)
    assert hot == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, join_skewed(big, small, "k", hot, how).collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    assert hot_keys(big.limit(0).groupBy("k").agg(F.count("*").alias("n")), "k") == []


def naive_auc(values, y):
    v = [(x, c) for x, c in zip(values, y) if x is not None and not math.isnan(x) and c is not None]
    classes = sorted({c for _, c in v})
    if len(classes) < 2 or len(v) < 10:
        return 0.5
    out = []
    for c in classes:
        pos, neg = [x for x, k in v if k == c], [x for x, k in v if k != c]
        a = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        out.append(max(a, 1 - a))
    return sum(out) / len(out)


def test_rank_statistics(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, math.nan, 1.0, 2.0, 2.0, 3.5]), rnd.gauss(0, 1), 7.0) for _ in range(200)] + [("d", 9.0, None, 7.0)]
    df = spark.createDataFrame(rows, "label string, x double, z double, flat double")
    got = {r.feature: r.auc for r in statistics.single_feature_auc(df, "label", ["x", "z", "flat"]).collect()}
    for k, f in enumerate(("x", "z", "flat"), 1):
        assert abs(got[f] - naive_auc([r[k] for r in rows], [r[0] for r in rows])) < 1e-9
    k = {r.feature: r for r in statistics.kruskal(df, "label", ["x", "z", "flat"]).collect()}
    assert set(k) == {"x", "z"} and k["x"].dof == 2

    def h(col):
        groups = {}
        for r in rows:
            if r[0] is not None and r[col] is not None and not math.isnan(r[col]):
                groups.setdefault(r[0], []).append(r[col])
        groups = {c: v for c, v in groups.items() if len(v) > 1}
        flat = sorted(x for v in groups.values() for x in v)
        n = len(flat)
        rank = {x: flat.index(x) + (flat.count(x) + 1) / 2 for x in set(flat)}
        raw = 12 / (n * (n + 1)) * sum(sum(rank[x] for x in v) ** 2 / len(v) for v in groups.values()) - 3 * (n + 1)
        return raw / (1 - sum(flat.count(x) ** 3 - flat.count(x) for x in set(flat)) / (n**3 - n))

    assert abs(k["x"].h - h(1)) < 1e-6 and abs(k["z"].h - h(2)) < 1e-6
    assert statistics.single_feature_auc(df.limit(0), "label", ["x"]).count() == 0
    assert statistics.single_feature_auc(df.limit(5), "label", ["flat"]).first().auc == 0.5


def test_distribution_statistics(spark):
    rows = [("a", "t")] * 10 + [("b", "t")] * 20 + [("a", "v")] * 30 + [("b", "v")] * 40 + [(None, "t"), ("a", None)]
    df = spark.createDataFrame(rows, "l string, s string")
    c = statistics.chi2_independence(df, "l", "s").first()
    off = 10 - 40 * 30 / 100
    assert c.dof == 1 and abs(c.chi2 - (abs(off) - 0.5) ** 2 * sum(100 / (r * k) for r in (40, 60) for k in (30, 70))) < 1e-9
    js = statistics.js_distance(df, "l", "s", "t", "v").first().js
    p, q = (1 / 3, 2 / 3), (3 / 7, 4 / 7)
    want = math.sqrt(sum((a * math.log2(2 * a / (a + b)) + b * math.log2(2 * b / (a + b))) for a, b in zip(p, q)) / 2)
    assert abs(js - want) < 1e-9
    assert statistics.js_distance(df, "l", "s", "t", "t").first().js == 0
    i = statistics.imbalance(df, "l").first()
    assert (i.ratio, i.largest, i.smallest, i.classes) == (60 / 41, "b", "a", 2)
    assert statistics.imbalance(df.where("l = 'a'"), "l").first().ratio == 1
    assert statistics.chi2_independence(df.limit(0), "l", "s").first().chi2 is None
    # Known values of the chi-squared distribution.
    for x, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.0, 3, 1.0)):
        assert abs(statistics.chi2_survival(x, dof) - p) < 1e-6


def test_relational(spark):
    df = spark.createDataFrame([("a", "t", 1.0), ("a", "v", 2.0), ("b", "t", 3.0), (None, "t", None), ("a", None, 5.0)], "l string, s string, x double")
    assert {tuple(r) for r in relational.crosstab(df, "l", "s", ["t", "v"]).collect()} == {("a", 1, 1, 2), ("b", 1, 0, 1), (None, 1, 0, 1)}
    labels = df.where("l IS NOT NULL").select("l").distinct()
    assert {tuple(r) for r in relational.filled(df, "l", labels, "s", ["t", "v"]).collect()} == {("a", "t", 1), ("a", "v", 1), ("b", "t", 1), ("b", "v", 0)}
    assert {(r.l, r.s, r.share) for r in relational.proportions(df.where("l IS NOT NULL"), "l", "s", ["t", "v"]).collect()} == {("a", "t", 50), ("b", "t", 50), ("a", "v", 100), ("b", "v", 0)}
    assert {(r.l, r.n, r.share) for r in relational.shares(df, "l").collect()} == {("a", 3, 0.6), ("b", 1, 0.2), (None, 1, 0.2)}
    n = relational.counts(df.where("l IS NOT NULL AND s IS NOT NULL"), "s", "l")
    assert n.groupBy("s").agg(relational.largest("n", "l").alias("l")).where("s = 't'").first().l == "a"  # a tie, by name
    assert n.groupBy("s").agg(relational.smallest("n", "l").alias("l")).where("s = 't'").first().l == "a"
    assert relational.first_per_group(df, "l", 1, F.desc("x")).where("l = 'a'").first().x == 5
    assert relational.unpivoted(df, ["l"], ["x"]).count() == 4
    assert df.select(relational.pct(F.lit(1), F.lit(3)).alias("p"), relational.pct(F.lit(1), F.lit(0)).alias("z")).first()[:] == (33.33, 0.0)
    assert relational.crosstab(df.limit(0), "l", "s", ["t"]).count() == relational.shares(df.limit(0), "l").count() == 0


def test_robust_z(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 5.0), ("b", None), (None, 1.0), (None, 3.0)], "l string, x double")
    z = {(r.l, r.x): r.z for r in statistics.robust_z(df, "l", F.col("x")).collect()}
    assert abs(z["a", 100.0] - 97 / 1.4826) < 1e-9 and z["b", 5.0] == 0 and z["b", None] is None and abs(z[None, 3.0] - 1 / 1.4826) < 1e-9


def test_groups_and_splits(spark):
    df = spark.createDataFrame([(k, f"/d/{k // 4:03d}_{k % 4}.jpg", "ab"[k % 2], None if k % 5 else f"g{k // 10}") for k in range(800)], "id int, path string, label string, group string")
    assert splitting.infer_groups(df, "path", "label") == splitting.GROUP_PATTERNS[0]
    assert splitting.infer_groups(df.limit(0), "path", "label") is None
    links = spark.createDataFrame([(1, 1), (2, 1), (0, 3), (3, 3)], "node int, component int")
    units = splitting.split_groups(df, "id", "group", links)
    of = {r.id: r.unit for r in units.collect()}
    assert of[1] == of[2] and of[0] == of[3] == of[5] != of[1]
    out = splitting.suggest_splits(df, "id", "label", units)
    rows = out.collect()
    assert len(rows) == 800 and len({(r.unit, r.split) for r in rows}) == len({r.unit for r in rows})
    share = {s: sum(r.split == s for r in rows) / 800 for s in ("train", "val", "test")}
    assert abs(share["test"] - 1 / 7) < 0.03 and abs(share["val"] - 1 / 7) < 0.03
    assert splitting.suggest_splits(df.limit(13), "id", "label", units) is None
    for bad in ("(", "x"):
        with pytest.raises(ValueError):
            splitting.java_regex(bad)


def test_file_names(spark):
    names = ["/x/cat.001.jpg", "/x/cat.002.jpg", "/x/IMG cr_7.PNG", "/x/.hidden", "/x/"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(splitting.stem(F.col("p"))).collect()] == ["cat.001", "cat.002", "IMG cr_7", ".hidden", ""]
    assert df.select(probes.without_tokens(F.col("p"), ["cat", "cr"])).collect()[0][0] == " .001"
    assert df.select(probes.char_grams(F.lit("ab c"))).first()[0] == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    rows = [(f"/d/cat{k}.jpg", "cat") for k in range(20)] + [(f"/d/x{k}_q.jpg", "dog") for k in range(20)]
    tokens = {r.token for r in probes.naming_tokens(spark.createDataFrame(rows, "path string, label string"), "path", "label").collect()}
    assert tokens == {"cat", "dog", "x", "q"}


def test_measurements_of_an_empty_index(spark):
    df = spark.createDataFrame([], "file_id long, label string, split string, domain string, readable boolean, error string, ext string, magic_format string, sha256 string, width int, height int, brightness double, contrast double, sharpness double")
    for x in (audits.error_reasons(df), audits.format_mismatches(df), audits.duplicate_groups(df), audits.split_coverage(df, ["test"]), audits.stratification(df, ["train", "test"]), audits.blur_rates(df), audits.slices(df), audits.sizes_by_label(df), audits.dominant_values(df, "ext")):
        assert x.count() == 0
    assert audits.resolution(df).first().n == 0 and audits.majority(df, "train", "test").first().accuracy is None
    assert audits.fingerprint(df).count() == 1


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("ab1",), ("ab0",), ("cd",), (None,)], "sha256 string")
    b = spark.createDataFrame([("cd",), ("ab0",), ("ab1",)], "sha256 string")
    assert audits.fingerprint(a).first() == audits.fingerprint(b).first() != audits.fingerprint(b.limit(2)).first()


def test_medians(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, 2.0, rnd.random() * 9, None, math.nan]), rnd.randrange(5)) for _ in range(150)] + [("c", None, 4)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    median = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 if v else None
    good = lambda k, c: [r[c] for r in rows if r[0] == k and r[c] is not None and not math.isnan(r[c])]
    got = {r.k: (r.x, r.y) for r in statistics.medians(df, ["k"], ["x", "y"]).collect()}
    assert got == {k: (median(good(k, 1)), median(good(k, 2))) for k in ("a", "b", "c", None)}
    assert statistics.medians(df, [], ["y"]).first().y == median([r[2] for r in rows])
    assert statistics.medians(df.limit(0), ["k"], ["x"]).count() == 0 and statistics.medians(df.limit(0), [], ["x"]).first().x is None


def test_medians_of_many_values(spark):
    """Bounds from summaries, exact within them; heavy ties, infinities and a group that holds nearly all."""
    rng = np.random.default_rng(6)
    rows = [("big" if k % 50 else None, float(rng.normal()), float(rng.integers(0, 3)), float(rng.choice([-np.inf, np.inf, 1.0, np.nan]))) for k in range(60_001)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(7)
    got = {r.k: (r.x, r.y) for r in statistics.medians(df, ["k"], ["x", "y"]).collect()}
    assert got == {k: tuple(median([r[c] for r in rows if r[0] == k]) for c in (1, 2)) for k in ("big", None)}
    assert statistics.medians(df, [], ["z"]).first().z == median([r[3] for r in rows if not np.isnan(r[3])])


def test_scope_deletes_what_was_written(spark):
    from plumbline import storage

    kept = storage.cut(spark.range(3))
    with storage.scope(spark):
        inner = storage.cut(spark.range(5))
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.count() == 5
    assert not os.path.exists(path) and kept.count() == 3
