"""Groups of records linked directly or through others, from billions of pairs.

Union-find runs within each partition of the edges and keeps only a spanning forest of it: one edge from every record
to the root of its local tree. As long as the forests together exceed one bounded partition, they are merged level by
level: a record that met several roots is linked to the smallest of them and leaves the graph, the roots go on to the
next level as edges between them. When the rest fits one bounded partition, union-find over it gives the global
components, which then flow back down the levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_skewed
from ..storage import cut
from .batches import column, gathered, parts

#: Edges in one partition, at most.
BOUND = 1_000_000
#: Fewer edges than this aren't worth another task.
PARALLEL = 50_000
FOREST = "u long, root long, low long"
_FOREST = pa.schema([("u", pa.int64()), ("root", pa.int64()), ("low", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    """A pseudo-random order of ids, the same in every partition, so that chains of growing ids shrink at every level."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def union_find(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of the nodes 0..len(rank)-1 the member of its component with the smallest rank. All edges that join two trees are united at once,
    the larger root under the smallest that an edge leads it to; then paths are compressed, and edges within a tree are done."""
    order = np.argsort(rank, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    parent = np.arange(len(rank))  # in places, so that the smaller place is the root
    x, y = place[a], place[b]
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(parent, up := parent[parent]):  # pointers only go to smaller places
            parent = up
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return order[parent[place]]


def _forest(batches):
    """Edges (a, b, low) of one partition to its spanning forest of stars (u, root, low); low is the smallest id known
    to be linked to a or b, and in the result to u. A loop only tells a record's low; without an edge in this partition the
    record has no root here."""
    t = gathered(batches)
    if t is None:
        return
    a, b = column(t, "a"), column(t, "b")
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = union_find(back[: len(a)], back[len(a) :], _mix(nodes))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root[back[: len(a)]], column(t, "low"))
    linked = np.zeros(len(nodes), bool)
    linked[back[np.concatenate([a, b]) != np.concatenate([b, a])]] = True
    for k in range(0, len(nodes), 100_000):
        s = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s]), pa.array(nodes[root][s], mask=~linked[s]), pa.array(low[root][s])], schema=_FOREST)


def components(pairs: DataFrame, a: str, b: str, bound: int = BOUND) -> DataFrame:
    """One row for each record that ``pairs`` links to another: node, component, the smallest id reachable from it.

    Ends are integers. Pairs with a null end or two equal ends link nothing; order and repeats don't matter; an empty
    table gives an empty result; other columns are ignored. No task ever holds more than about ``bound`` edges, however
    large a component is.
    """
    low, high = F.least(F.col(a), F.col(b)).cast("long"), F.greatest(F.col(a), F.col(b)).cast("long")
    edges = pairs.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b"), low.alias("low"))
    n, levels = edges.count(), []
    while True:
        some = max(parts(n, bound, 1), min(n // PARALLEL, parts(n, bound, 8)))
        forest = edges.repartition(some, "a", "b").mapInArrow(_forest, FOREST)
        if some > 1:
            forest = cut(forest)
            if forest.count() <= bound:
                some, forest = 1, forest.select(F.col("u").alias("a"), F.coalesce("root", "u").alias("b"), "low").repartition(1).mapInArrow(_forest, FOREST)
        if some == 1:  # one partition saw everything that is left: its trees are whole components
            return _resolve(levels, forest.select(F.col("u").alias("node"), F.col("low").alias("component")))
        edges, level = _contract(forest)
        levels.append(level)
        n = edges.count()


def _contract(forest: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The edges between roots that have a record in common, and what leads back from them: the root each record goes
    with, and each root's smallest id. In every partition all but the roots leave the graph, so it shrinks at each level."""
    order = F.when(F.col("root").isNotNull(), F.struct(F.xxhash64("root").alias("h"), "root"))
    up = cut(forest.groupBy("u").agg(F.min(order)["root"].alias("up"), F.count("root").alias("n"), F.min("low").alias("low")))
    roots = cut(up.groupBy(F.col("up").alias("root")).agg(F.min("low").alias("low")))
    met = up.where(F.col("n") > 1).select("u", "up")
    edges = forest.join(met, "u").where(F.col("root") != F.col("up")).select(F.col("root").alias("a"), F.col("up").alias("b")).distinct()
    edges = cut(edges)
    ends = edges.select(F.col("a").alias("root")).union(edges.select("b")).distinct()
    loops = roots.join(ends, "root", "left_semi").select(F.col("root").alias("a"), F.col("root").alias("b"), "low")
    return cut(edges.withColumn("low", F.least("a", "b")).unionByName(loops)), (up.select("u", "up"), roots)


def _resolve(levels: list, top: DataFrame) -> DataFrame:
    """From the components of the last roots back to those of all records."""
    for links, roots in reversed(levels):
        top = cut(top)
        alone = roots.join(top.select(F.col("node").alias("root")), "root", "left_anti")
        of_root = alone.select(F.col("root").alias("up"), F.col("low").alias("component")).unionByName(top.select(F.col("node").alias("up"), "component"))
        hot = hot_keys(links.groupBy("up").agg(F.count(F.lit(1)).alias("n")), "up")
        top = join_skewed(links, of_root, "up", hot, "inner").select(F.col("u").alias("node"), "component")
    return top
