import os
import random
import re

import numpy as np
import pytest

from plumbline.llm import paragraphs as p
from plumbline.llm.words import words

from ..tables import FOLDER


def brute(docs):
    rows = []
    for d, t in docs:
        for k, x in enumerate(re.split(r"\n[^\S\n]*\n\s*", t) if t else []):
            w = words(x)
            if w:
                rows.append((d, k, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][2], rows[j][2]
            if len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[:2])
    return {tuple(sorted(g)) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("block,chunk,few", [(1000, 5000, 24), (4, 3, 24), (1000, 20, 0), (3, 500, 0)])
def test_clusters(spark, monkeypatch, block, chunk, few):
    monkeypatch.setattr(p, "CHUNK", chunk)
    monkeypatch.setattr(p, "FEW", few)
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.choice([6, 30, 80]))] for _ in range(15)]
    docs = []
    for k in range(90):
        text = []
        for _ in range(rnd.randrange(4)):
            w = list(rnd.choice(base)) if rnd.random() < 0.7 else [f"u{rnd.randrange(10**6)}" for _ in range(20)]
            if rnd.random() < 0.4:
                w[rnd.randrange(len(w))] = "changed"
            text.append(" ".join(w))
        docs.append((k, "\n\n".join(text)))
    docs += [(900, None), (901, ""), (902, "\n\n \n\n"), (903, "too few words"), (904, "A\n\nToo few, words!\n\n..."), (905, "too few"), (906, "a b c d e a b c d e"), (907, "?")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, paragraph int")
    got = p.clusters(df, block=block).collect()
    of: dict = {}
    for r in got:
        of.setdefault(r.cluster, []).append((r.doc_id, r.paragraph, r.removed))
    assert {tuple(sorted(x[:2] for x in g)) for g in of.values()} == brute(docs)
    assert all([x[2] for x in sorted(g)] == [False] + [True] * (len(g) - 1) for g in of.values())
    assert p.clusters(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    b, r = p.bands()
    assert b * r <= p.HASHES and 1 - (1 - p.SIMILARITY**r) ** b >= p.RECALL
    assert p.bands(1, 0.5, 0.999) == (1, 1)


@pytest.mark.parametrize("few", [24, 0])
def test_forest(monkeypatch, few):
    """The trees are the components, whether all pairs or those across two sides are linked."""
    monkeypatch.setattr(p, "FEW", few)
    rnd = random.Random(2)
    for across in (False, True):
        base = [rnd.sample(range(300), 12) for _ in range(6)]
        sets = [np.unique(np.array([x if rnd.random() > 0.08 else rnd.randrange(300) for x in rnd.choice(base)])) for _ in range(40)]
        sides = [k % 2 if across else 0 for k in range(40)]

        def labels(links):
            label = list(range(40))
            for _ in range(40):
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        true = [(a, b) for a in range(40) for b in range(a) if (sides[a] != sides[b] or not across) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        got = p.forest(sets, sides, 0.8)
        assert labels(got) == labels(true) and len(got) < 40 and len(true) > 15


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_recall_on_the_tables(spark):
    """Of all pairs of paragraphs similar by brute force, at least 0.9 are in one cluster; nothing else is."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.paragraph): r.cluster for r in p.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {x: k for k, g in enumerate(sorted(brute(rows))) for x in g}
    pairs = lambda of: {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    true, found = pairs(want), pairs(got)
    assert found <= true and len(found) >= 0.99 * len(true) and len(true) > 10
