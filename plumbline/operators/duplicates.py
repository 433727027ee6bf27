"""Exact and near duplicates by content hash and 64-bit signatures."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import connected_components

#: Keys of a row, at most.
MOST_KEYS = 300
#: Classes with the same signatures in one block; a cell of vectors to compare holds two blocks.
BLOCK = 128
#: Vectors in one partition, about.
PART = 1_000
#: From so many signatures on a key holds one run of bits more.
MANY = 10_000_000


def chunks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` disjoint runs of bits that cover 64, the wider ones first. Two
    signatures at most t bits apart agree in at least n - t of them."""
    if n not in range(1, 65):
        raise ValueError("from 1 to 64 runs")
    widths = [-(-(64 - k) // n) for k in range(n)]
    return list(zip(accumulate(widths, initial=0), widths))


def hamming(a: Column, b: Column) -> Column:
    """The number of different bits."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def near_hashes(hashes: DataFrame, h: str, threshold: int, second: str | None = None, second_threshold: int = 64, clean: int | None = None) -> DataFrame:
    """a, b, dist (and a2, b2, the second signatures) for all pairs of rows with h_a < h_b, or with the same h and a smaller second
    signature, at most ``threshold`` and ``second_threshold`` bits apart. ``hashes`` has each combination once; null signatures have no pairs.

    The bits are cut into threshold + ``clean`` runs, so close signatures agree in at least ``clean`` of them. Each row is keyed by every
    choice of that many runs; equal keys meet in a hash join.
    More clean runs mean more rows but longer, more selective keys: by default two up to ``MANY`` signatures, three beyond. Adaptive
    execution splits keys that are too frequent.
    """
    if clean is None:
        clean = 2 if hashes.count() <= MANY else 3
    runs = chunks(threshold + clean)
    choices = list(combinations(range(len(runs)), clean))
    if len(choices) > MOST_KEYS:
        raise ValueError(f"a threshold of {threshold} with {clean} clean runs needs {len(choices)} keys a row")
    rows = hashes.select(F.col(h).alias("h"), *([F.col(second).alias("h2")] if second else [])).where(F.col("h").isNotNull())
    key = lambda c: F.struct(F.lit(sum(1 << k for k in c)).cast("long").alias("choice"), F.col("h").bitwiseAND(F.lit(_signed(sum((2 ** runs[k][1] - 1) << runs[k][0] for k in c)))).alias("bits"))
    keyed = rows.select("*", F.explode(F.array(*map(key, choices))).alias("_x")).select("_x.choice", "_x.bits", *rows.columns)
    left = keyed.withColumnsRenamed({"h": "a", "h2": "a2"})
    right = keyed.withColumnsRenamed({"h": "b", "h2": "b2"})
    x = F.col("a").bitwiseXOR(F.col("b"))
    order = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a2") < F.col("b2"))) if second else F.col("a") < F.col("b")
    # Not to be broadcast, whatever the size before the keys multiplied the rows.
    pairs = left.join(right.hint("merge"), ["choice", "bits"]).where(order & (F.bit_count(x) <= threshold))
    if second:
        pairs = pairs.where(hamming(F.col("a2"), F.col("b2")) <= second_threshold)
    # A pair may agree in several choices; only the few true pairs are compared again.
    return pairs.select("a", "b", F.bit_count(x).cast("int").alias("dist"), *(["a2", "b2"] if second else [])).distinct()


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def exact_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, content, first, n: the rows whose non-null content is shared, with the smallest key of their group and its size."""
    g = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.select(key, content).join(g, content)


def _with_codes(rows: DataFrame, least: float) -> DataFrame:
    """``rows`` with v and v2, two digests of the vector (null without one), and alone: the id where a vector's product with itself is below
    ``least`` (a picture without edges), so that files with equal vectors don't match either; else null."""
    dot = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    some = F.col("vector").isNotNull()
    return rows.withColumns({"v": F.when(some, F.xxhash64("vector")), "v2": F.when(some, F.xxhash64(F.reverse("vector"))), "alone": F.when((dot < least) | F.isnan(dot), F.col("id"))})


def _compared(least: float):
    """The pairs of classes in each cell of a partition whose vectors match."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        ids, dist, vectors = (t.column(c).combine_chunks() for c in ("rep", "dist", "vector"))
        cell, side = (t.column(c).to_numpy() for c in ("cell", "side"))
        some = vectors.is_valid().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(int(some.sum()), -1) if some.any() else np.zeros((0, 1))
        at = np.cumsum(some) - 1

        def of(rows):
            out = np.zeros((len(rows), matrix.shape[1]))
            out[some[rows]] = matrix[at[rows[some[rows]]]]
            return out

        order = np.lexsort((side, cell))
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            left, right = own[side[own] == 0], own[side[own] == 1]
            within = not len(right)  # one block with itself
            right = left if within else right
            x = of(left)
            good = (x @ (x if within else of(right)).T >= least) | ~some[left][:, None] | ~some[right][None, :]
            i, j = np.nonzero(np.triu(good, 1) if within else good)
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[i])), ids.take(pa.array(right[j])), dist.take(pa.array(left[i]))], ["rep_a", "rep_b", "dist"])

    return run


def _verified(near: DataFrame, classes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """rep_a, rep_b, dist: all pairs of classes with the same signatures, or with signatures that are a pair of ``near``, whose vectors match.
    The classes of one pair of signatures are divided into blocks, and each two blocks that may match meet in a cell."""
    sizes = cut(classes.groupBy("h", "h2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
    end = lambda s: sizes.select(F.col("h").alias(s), F.col("h2").alias(f"{s}2"), F.col("blocks").alias(f"blocks_{s}"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    far = near.join(end("a"), ["a", "a2"]).join(end("b"), ["b", "b2"]).withColumn("i", F.explode(numbers("blocks_a"))).withColumn("j", F.explode(numbers("blocks_b")))
    own = sizes.where("n > 1").withColumn("i", F.explode(numbers("blocks"))).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    own = own.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("h").alias("b"), F.col("h2").alias("b2"), F.lit(0).alias("dist"), "i", "j")
    cells = cut(far.select(own.columns).unionByName(own).withColumn("cell", F.monotonically_increasing_id()))
    left = cells.select("cell", "dist", F.lit(0).alias("side"), F.col("a").alias("h"), F.col("a2").alias("h2"), F.col("i").alias("block"))
    right = cells.where("a <> b OR a2 <> b2 OR i <> j").select("cell", "dist", F.lit(1).alias("side"), F.col("b").alias("h"), F.col("b2").alias("h2"), F.col("j").alias("block"))
    placed = classes.join(sizes, ["h", "h2"]).select("h", "h2", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    members = cut(left.unionByName(right).join(placed, ["h", "h2", "block"]).select("cell", "dist", "side", "rep"))
    vectors = rows.select(F.col("id").alias("rep"), "vector").join(members.select("rep").distinct(), "rep", "left_semi")  # vectors are large, linked files few
    parts = max(-(-members.count() // PART), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(rows.dtypes)["id"]
    return members.join(vectors, "rep").repartition(parts, "cell").mapInArrow(_compared(least), f"rep_a {kind}, rep_b {kind}, dist int")


class Duplicates:
    """Near and exact duplicates of ``df``: one row per file with unique ``key``, a content hash and two signatures.

    Files that are byte-identical, or whose signatures agree, form classes first; pairs are only formed between representatives of
    classes (their smallest keys), and members are linked to their representative. So copies, however many, add one link each and no
    link between different contents is lost. ``exclude`` marks rows (blank images) that take part in exact matches only. ``vector`` may
    name an array column; then pairs that aren't byte-identical must have at least ``least`` as the dot product of their vectors, or one
    of them no vector. Members of a class then agree in their vectors, too, as the dot product isn't transitive; classes of equal or near
    signatures are compared in cells of bounded size, and all links found come out.
    """

    def __init__(self, df: DataFrame, key: str, content: str, h: str, second: str, threshold: int, second_threshold: int, exclude: Column | None = None, vector: str | None = None, least: float = 0.0):
        self.key, self.df = key, df
        usable = F.col(h).isNotNull() & F.col(second).isNotNull()
        if exclude is not None:
            usable = usable & ~F.coalesce(exclude, F.lit(False))
        extra = [F.col(vector).alias("vector")] if vector else []
        rows = df.select(F.col(key).alias("id"), F.col(content).alias("content"), F.when(usable, F.col(h)).alias("h"), F.when(usable, F.col(second)).alias("h2"), *extra)
        # Stars of byte-identical files.
        exact = rows.where(F.col("content").isNotNull()).groupBy("content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        self.exact = cut(rows.select("id", "content").join(exact, "content").select("id", "first", "content", "n"))
        # Stars of files with the same two signatures, and pairs of their representatives.
        usable_rows = rows.where(F.col("h").isNotNull())
        of = ["h", "h2"]
        if vector:
            usable_rows, of = cut(_with_codes(usable_rows, least)), ["h", "h2", "v", "v2", "alone"]
        classes = cut(usable_rows.groupBy(*of).agg(F.min("id").alias("rep")))
        near = near_hashes(classes.select("h", "h2").distinct() if vector else classes, "h", threshold, "h2", second_threshold)
        if vector:
            near = _verified(cut(near), classes, usable_rows, least)
        else:
            a = classes.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("rep").alias("rep_a"))
            b = classes.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("rep").alias("rep_b"))
            near = near.join(a, ["a", "a2"]).join(b, ["b", "b2"])
        near = near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "dist", F.lit(False).alias("star"))
        met = usable_rows.drop("vector").alias("x").join(classes.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in of]) if vector else usable_rows.join(classes, of)
        same = met.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist"), F.lit(True).alias("star"))
        self._near = links = cut(near.unionByName(same))
        stars = self.exact.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist"))
        self.links = cut(links.drop("star").unionByName(stars).groupBy("a", "b").agg(F.min("dist").alias("dist")))
        self._components = None

    @property
    def components(self) -> DataFrame:
        """node, component: the files with a duplicate, and the smallest key of their cluster."""
        if self._components is None:
            self._components = cut(connected_components(self.links, "a", "b"))
        return self._components

    @property
    def _members(self) -> DataFrame:
        """id, rep: the files with a link by signatures, and their class."""
        stars = self._near.where("star").select(F.col("a").alias("rep"), F.col("b").alias("id"))
        ends = self._near.select(F.col("a").alias("id")).union(self._near.select("b")).distinct()
        return ends.join(stars.groupBy("id").agg(F.min("rep").alias("rep")), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))

    @property
    def _both(self) -> DataFrame:
        """rep, other: linked classes, either way round."""
        far = self._near.where("NOT star")
        return far.select("a", "b").union(far.select("b", "a")).toDF("rep", "other")

    def touching(self, target: Column, source: Column) -> DataFrame:
        """id: the files of ``target`` (a condition on the columns of ``df``) that have a direct duplicate in ``source``, byte-identical or by
        signatures. Links run between representatives, so a class passes on whether it holds a file of ``source``."""
        flags = self.df.select(F.col(self.key).alias("id"), F.coalesce(target, F.lit(False)).alias("t"), F.coalesce(source, F.lit(False)).alias("s"))
        same = self.exact.join(flags, "id")
        hot = same.groupBy("first").agg(F.max("s").alias("s")).where("s").select("first")
        by_content = same.where("t").join(hot, "first", "left_semi").select("id")
        flagged = cut(self._members.join(flags, "id"))
        holds = flagged.groupBy("rep").agg(F.max("s").alias("s"), F.count_if("s").alias("n"))
        both = self._both
        reached = both.join(holds.where("s").select(F.col("rep").alias("other")), "other", "left_semi").select("rep")
        reached = reached.union(holds.where("s").select("rep")).distinct()
        return by_content.union(flagged.where("t").join(reached, "rep", "left_semi").select("id")).distinct()

    def conflicting(self, column: str) -> DataFrame:
        """id: the files that have a direct duplicate, byte-identical or by signatures, with another value of ``column``; null is a value. Counted
        per class, whose least and largest values tell, so pairs are never formed."""
        bounds = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))
        value = F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("value"))  # structs of nulls compare
        values = self.df.select(F.col(self.key).alias("id"), value.alias("x"))
        same = self.exact.join(values, "id")
        by_content = same.join(same.groupBy("first").agg(*bounds("x", "x")).where("lo <> hi"), "first", "left_semi").select("id")
        valued = cut(self._members.join(values, "id"))
        own = cut(valued.groupBy("rep").agg(*bounds("x", "x")))
        met = self._both.join(own.withColumnRenamed("rep", "other"), "other").select("rep", "lo", "hi")
        around = own.unionByName(met).groupBy("rep").agg(*bounds("lo", "hi"))
        return by_content.union(valued.join(around, "rep").where("NOT (lo <=> x AND hi <=> x)").select("id")).distinct()

    def with_columns(self, *columns: str) -> DataFrame:
        """The links with columns of both ends, as a_<name> and b_<name>."""
        side = lambda s: self.df.select(F.col(self.key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
        return self.links.join(side("a"), "a").join(side("b"), "b")
