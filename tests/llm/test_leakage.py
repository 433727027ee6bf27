import random

from plumbline.llm.leakage import Items, leaks
from plumbline.llm.words import myers, words


def distance(p, s):
    prev = [0] * (len(s) + 1)
    for i, x in enumerate(p, 1):
        cur = [i]
        for j, y in enumerate(s, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_myers_equals_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(1500):
        p, s = [rnd.randrange(4) for _ in range(rnd.randrange(1, 16))], [rnd.randrange(5) for _ in range(rnd.randrange(25))]
        assert myers(p)(s)[0] == distance(p, s)


def test_words():
    assert words("Ab­c d​e, ﬁn x²y_z ½ ÀB") == ["abc", "de", "fin", "x2y", "z", "1", "2", "àb"]
    assert words("") == words("  ..!") == []


def test_equals_brute_force():
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 13, 16, 25])))) for k in range(40)] + [(40, None or ""), (41, "w1")]
    items.append((42, items[5][1]))
    docs = []
    for k in range(120):
        body = [rnd.choice(vocab) for _ in range(rnd.randrange(60))]
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            if w:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + ["zz"] + w[at:], w[:at] + ["zz"] + w[at + 1 :]])
        docs.append((k, " ".join(body[:20] + w + body[20:])))
    docs += [(900, None), (901, "")]
    got = Items(items, 13, 2).scan(*map(list, zip(*docs, strict=True)))
    got = {(d, i): x for d, i, x in zip(*got, strict=True)}
    want = {}
    for d, t in docs:
        for i, text in items:
            w, s = words(text), words(t or "")
            if len(w) >= 13:
                best = min(distance(w[a : a + 13], s) for a in range(len(w) - 12))
                if best <= 2:
                    want[d, i] = best
    assert got == want and {0, 1, 2} <= set(want.values())


def test_blocks_and_empty_tables(spark):
    text = " ".join(f"t{k}" for k in range(20))
    items = spark.createDataFrame([(1, text, "z"), (2, None, "z"), (3, "t1 t2", "z"), (4, text + " more", "z")], "item_id long, item_text string, text string")
    docs = spark.createDataFrame([(7, "x " + text.upper() + " y", 1), (8, None, 1), (9, "", 1), (7, "x " + text, 1)], "doc_id long, text string, item_id long")
    for block in (10**6, 1):
        assert {tuple(r) for r in leaks(docs, items, block=block).collect()} == {(7, 1, 0), (7, 4, 0)}
    assert leaks(docs, items.limit(0)).count() == leaks(docs.limit(0), items).count() == 0


def test_short_items_equal_brute_force():
    """With short, an item of fewer words than a window is found as a whole, with its share of the budget."""
    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(1 + k % 15))) for k in range(45)] + [(90, "")]
    docs = []
    for k in range(150):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            if w:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + ["zz"] + w[at:], w[:at] + ["zz"] + w[at + 1 :]])
        body = [rnd.choice([*vocab, "o", "o", "o"]) for _ in range(rnd.randrange(20))]
        docs.append((k, " ".join(body[:8] + w + body[8:])))
    want = {}
    for d, t in docs:
        for i, text in items:
            w, s = words(text), words(t)
            if w:
                n = min(13, len(w))
                best = min(distance(w[a : a + n], s) for a in range(len(w) - n + 1))
                if best <= 2 * n // 13:
                    want[d, i] = best
    texts = list(map(list, zip(*docs, strict=True)))
    got = {(d, i): x for d, i, x in zip(*Items(items, 13, 2, short=True).scan(*texts), strict=True)}
    assert got == want and {1 + i % 15 for _, i in want} >= set(range(1, 13))
    long = {(d, i): x for d, i, x in zip(*Items(items, 13, 2).scan(*texts), strict=True)}
    assert long == {k: x for k, x in want.items() if 1 + k[1] % 15 >= 13}


def test_queries_on_short_items(spark, tmp_path):
    from plumbline.llm import queries

    text = " ".join(f"t{k}" for k in range(14))
    spark.createDataFrame([(1, text), (2, "Rank B and A"), (3, None), (4, "")], "item_id long, item_text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(7, f"x {text} y"), (8, "now rank b, and a!"), (9, "rank b or a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    of = lambda f: {tuple(r) for r in f(spark, str(tmp_path)).collect()}
    assert of(queries.p8_near) == {(7, 1, 0), (8, 2, 0)} and of(queries.p8_found) == {(7, 1)}
    assert of(queries.p8_items) == {(1, 1, 1), (2, 1, 1)}
