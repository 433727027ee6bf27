"""Connected components as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .skew import hot_keys, join_skewed

#: Edges that one task takes.
BOUND = 1_000_000


def _smallest(batches):
    """node, component of edges that are all in one partition: labels fall to the smallest neighbour's and are followed to their ends, until both
    ends of every edge agree."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    both = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks()
    names = both.unique().sort()
    at = pa.compute.index_in(both, value_set=names).to_numpy()
    u, v, label = at[: t.num_rows], at[t.num_rows :], np.arange(len(names))
    while len(u):
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, further := label[label]):
            label = further
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "component"])


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 100, bound: int = BOUND) -> DataFrame:
    """node, component (the smallest reachable node) for each node with an edge to another one. Null ends and loops link nothing.

    Up to ``bound`` edges are settled in one task. Of more, large and small stars alternate: every node hands the smallest node it sees to
    its larger neighbours, then to its smaller ones, until nothing changes. The number of rounds grows with the logarithm of the longest
    chain. Nodes with very many neighbours don't move their edges. Every round writes its edges to the shared folder, so none is computed twice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    kind = dict(e.dtypes)["u"]
    n = e.count()
    if n <= bound:
        return e.repartition(1).mapInArrow(_smallest, f"node {kind}, component {kind}")
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        big = join_skewed(both, low.select("u", "m"), "u", hot_keys(low.select("u", "n"), "u"), "inner").where(F.col("v") > F.col("u"))
        big = cut(big.select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        # Every edge points from its larger end to smaller neighbours; these meet in the smallest.
        low = cut(big.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        met = join_skewed(big, low.select("v", "m"), "v", hot_keys(low.select("v", "n"), "v"), "inner")
        small = met.select(F.col("m").alias("x"), F.col("u").alias("y")).union(met.select(F.col("m").alias("x"), F.col("v").alias("y"))).where("x <> y")
        new = cut(small.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        more = new.count()
        same = more == n and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e, n = new, more
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
