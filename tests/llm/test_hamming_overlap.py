import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import hamming_overlap as h

INDEX = "file_id long, split string, domain string, readable boolean, contrast double, entropy double, sha256 string, phash long, dhash long, extra string"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def flip(x, n, rnd):
    for b in rnd.sample(range(64), n):
        x ^= 1 << b
    return x


def brute(rows):
    of = {"train": 1, "training": 1, "val": 2, "dev": 2, "test": 2}
    seen, out = {r[0]: r for r in rows}, set()
    for a in seen.values():
        for b in seen.values():
            if not (a[3] and b[3]) or of.get((a[1] or "").strip(" \t").lower()) != 1 or of.get((b[1] or "").strip(" \t").lower()) != 2:
                continue
            same = a[6] is not None and b[6] is not None and a[6].lower() == b[6].lower()
            blank = lambda r: (r[4] is not None and r[4] < 2) or (r[5] is not None and r[5] < 0.5)
            near = None not in (a[7], a[8], b[7], b[8]) and not blank(a) and not blank(b)
            near = near and bin((a[7] ^ b[7]) & (2**64 - 1)).count("1") <= 6 and bin((a[8] ^ b[8]) & (2**64 - 1)).count("1") <= 10
            if same or near:
                out.add((a[0], b[0]))
    return out


def rows_of(rnd, n):
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(25)] + [(0, 0), (3, 0), (2**63, 5)]
    rows = []
    for k in range(n):
        p, d = rnd.choice(base)
        p, d = flip(p, rnd.choice([0, 0, 1, 3, 5, 6, 7]), rnd), flip(d, rnd.choice([0, 2, 9, 11]), rnd)
        rows.append((k, rnd.choice(["train", " Training\t", "val", "DEV", "test", "holdout", None, ""]), None, rnd.random() > 0.1, rnd.choice([10.0, 1.0, None, float("nan")]), rnd.choice([3.0, 3.0, 0.1, None]),
                     rnd.choice([None, "ab", "AB", "x" * 64, f"s{k}"]) if rnd.random() < 0.3 else f"s{k}", rnd.choice([signed(p)] * 9 + [None]), rnd.choice([signed(d)] * 9 + [None]), "e"))
    return rows + rows[:20]


@pytest.mark.parametrize("cell,clean", [(50_000, 2), (7, 2), (50_000, 3), (5, 3)])
def test_equals_brute_force(spark, monkeypatch, cell, clean):
    monkeypatch.setattr(h, "CELL", cell)
    rows = rows_of(random.Random(2), 500)
    found = h.Overlaps(h.records(spark.createDataFrame(rows, INDEX)), clean=clean)
    got = found.pairs.collect()
    assert found.counts.agg(F.sum("n_pairs"), F.sum("n_files")).first() == (len(got), len({r.held_id for r in got}))
    pairs = [(r.train_id, r.held_id) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows)
    assert all(r.phash_bits is None or (r.phash_bits <= 6 and r.dhash_bits <= 10) for r in got)


def test_copies_hold_a_third(spark):
    rows = [(k, "train" if k % 10 else "test", None, True, 9.0, 5.0, "same", 77, 88, "") for k in range(300)]
    rows += [(1000 + k, "train", None, True, 9.0, 5.0, f"s{k}", signed(random.Random(k).getrandbits(64)), k, "") for k in range(300)]
    got = h.overlaps(h.records(spark.createDataFrame(rows, INDEX))).collect()
    assert len(got) == 270 * 30


def test_empty(spark):
    empty = spark.createDataFrame([], INDEX)
    assert h.overlaps(h.records(empty)).count() == 0
    with pytest.raises(ValueError):
        h.overlaps(h.records(empty), max_p=20)
