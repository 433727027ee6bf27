import random

import numpy as np
import pytest

from plumbline.llm import shared_spans as module
from plumbline.llm.shared_spans import shared_spans, sliding_min


def brute(docs, least):
    seen: dict = {}
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            seen.setdefault(t[i : i + least], set()).add(d)
    out = set()
    for d, t in docs:
        covered = np.zeros(len(t or "") + 2, bool)
        for i in range(len(t or "") - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                covered[i + 1 : i + 1 + least] = True
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        out |= {(d, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)}
    return out


@pytest.mark.parametrize("seed,pieces,longest", [(0, 20_000, 2_000), (1, 20_000, 4), (2, 20_000, 2_000), (3, 6, 5), (4, 0, 2_000)])
def test_equals_brute_force(spark, monkeypatch, seed, pieces, longest):
    """Also with anchors of more pieces than a task should hold."""
    monkeypatch.setattr(module, "PIECES", pieces)
    monkeypatch.setattr(module, "LONGEST", longest)
    monkeypatch.setattr(module, "parts", lambda rows, each, least: max(least, min(50, rows // max(each, 1))))
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abé😀 ") for _ in range(rnd.randrange(5, 40))) for _ in range(12)]
    docs = [(k, "".join(rnd.choice(parts) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefé") for _ in range(rnd.randrange(20))) for _ in range(rnd.randrange(6)))) for k in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "a" * 70), (1003, "xx" + "a" * 50), (1004, docs[3][1]), (1005, docs[3][1])]
    df = spark.createDataFrame([(d, t, 0, "z") for d, t in docs], "doc_id long, text string, at int, anchor string")
    got = [tuple(r) for r in shared_spans(df, 12).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 12)


def test_no_text_repeats_itself_into_a_span(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, t + t), (2, "short")], "doc_id long, text string")
    assert shared_spans(df).count() == 0
    assert shared_spans(df.limit(0)).count() == 0


def test_a_third_are_copies_and_one_text_is_long(spark):
    rnd = random.Random(2)
    t = "".join(rnd.choice("abcdefgh") for _ in range(700))
    long = "".join(rnd.choice("abcdefgh") for _ in range(1_200_000))
    docs = [(k, t) for k in range(100)] + [(100 + k, "".join(rnd.choice("ijk") for _ in range(400))) for k in range(200)] + [(500, long[:899_999] + "Z" + t[100:450] + "Z" + long[900_000:])]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(k, 0, 700) for k in range(100)} | {(500, 900_000, 900_350)}


def test_intervals():
    rnd = random.Random(5)
    for _ in range(100):
        x = [(rnd.randrange(3), a := rnd.randrange(30), a + rnd.randrange(1, 6)) for _ in range(rnd.randrange(1, 12))]
        got = list(zip(*(c.tolist() for c in module._intervals(*map(np.array, zip(*x))))))
        want = []
        for d in range(3):
            inside = {p for e, a, b in x if e == d for p in range(a, b)}
            starts = sorted(p for p in inside if p - 1 not in inside)
            want += [(d, a, next(b for b in range(a, 99) if b not in inside)) for a in starts]
        assert got == want


def test_sliding_min():
    a = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for w in (1, 2, 7, 57, 58):
        assert sliding_min(a, w).tolist() == [int(a[i : i + w].min()) for i in range(len(a) - w + 1)]
