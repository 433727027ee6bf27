import random

import numpy as np
import pytest

from plumbline.llm.components import components, union_find


def brute(pairs):
    near: dict = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = n
                    stack += near[x]
    return out


def run(spark, pairs, bound=1_000_000):
    df = spark.createDataFrame(pairs, "file_a long, file_b long")
    return {r.node: r.component for r in components(df, "file_a", "file_b", bound).collect()}


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_random_graphs(spark, bound):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)]
    pairs += [(None, 3), (5, None), (None, None), (7, 7), (1, 2), (2, 1), (1, 2)]
    assert run(spark, pairs, bound) == brute(pairs)


def test_long_chain_and_hot_star_with_tiny_partitions(spark):
    chain = [(k, k + 1) for k in range(1000, 1400)]
    star = [(5000, k) for k in range(6000, 6300)] + [(4000, 6100)]
    pairs = chain + star + [(-5, -6), (9_000_000_000_000, 3)]
    assert run(spark, pairs, 60) == brute(pairs)


def test_empty_and_loops_only(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (None, 2)]) == {}


def test_union_find_takes_the_smallest_rank():
    root = union_find(np.array([0, 2, 3]), np.array([1, 1, 4]), np.array([9, 8, 1, 7, 6]))
    assert root.tolist() == [2, 2, 2, 4, 4]
