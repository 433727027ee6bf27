import random

import pytest

from plumbline.llm import hamming_overlap, suffixes

from .test_hamming_overlap import INDEX, signed


def brute(texts, held):
    """texts, held: by file. (bytes, shared, longest) of the files with a stretch on the other side."""
    out = {}
    for f, text in texts.items():
        others = [t for g, t in texts.items() if held[g] != held[f]]
        inside, longest = set(), 0
        for a in range(len(text)):
            for b in range(a + 8, len(text) + 1):
                if not any(text[a:b] in t for t in others):
                    break
                inside |= set(range(a, b))
                longest = max(longest, b - a)
        if inside:
            out[f] = len(text), len(inside), longest
    return out


def test_common_prefixes():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = (bytes(rnd.choices(b"ab", k=rnd.randrange(9))) for _ in range(2))
        n = suffixes.common(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("part,size,chunk", [(4_000_000, 200_000, 20_000), (300, 20, 7)])
def test_coverage_equals_brute_force(spark, monkeypatch, part, size, chunk):
    for name, n in (("PART", part), ("RANGE", size), ("CHUNK", chunk)):
        monkeypatch.setattr(suffixes, name, n)
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    pool = [digits(64) for _ in range(5)]
    hashes = [rnd.getrandbits(64) for _ in range(4)]
    rows, texts, held = [], {}, {}
    for k in range(80):
        sha, p, d = rnd.choice([None, "odd", digits(64), rnd.choice(pool), digits(20) + rnd.choice(pool)[10:40] + digits(14)]), rnd.choice([None, rnd.choice(hashes), rnd.getrandbits(64)]), rnd.choice([*hashes, 3])
        split = rnd.choice(["train", "train", "val", "test", None])
        rows.append((k, split, None, True, 9.0, 5.0, sha and sha.upper(), None if p is None else signed(p), signed(d), ""))
        text = bytes.fromhex((sha if sha and sha != "odd" else "") + (f"{p:016x}{d:016x}" if p is not None else ""))
        if split and text:
            texts[k], held[k] = text, split != "train"
    got = suffixes.coverage(hamming_overlap.records(spark.createDataFrame(rows + rows[:9], INDEX))).collect()
    want = brute(texts, held)
    assert {r.file_id: (r.n_bytes, r.n_shared, r.longest) for r in got} == want and len({x[1] for x in want.values()}) > 4 and len(got) == len(want)
    assert suffixes.coverage(hamming_overlap.records(spark.createDataFrame([], INDEX))).count() == 0
