"""The same or nearly the same records in a held-out split and in the training split.

This is multi-index hashing, not a suffix array: signatures that differ in scattered bits need not share any long stretch of digits, so no
suffixes of theirs are neighbours. (``suffixes`` has the suffix array and what it can tell.) Records with the same content hash and
signatures form a class first; classes are compared, and only the pairs found are expanded to records. If two signatures differ in at most
6 bits, at least two of their eight blocks are free of errors, or three of nine. Classes are keyed by all but the last of these error-free
blocks; where they meet, each partition sorts them by one later block at a time, adjacent or not, so that every qualifying pair shares such
blocks, at exactly one place that is its first. Content hashes are keyed by one 64-bit digest and compared by two. Pairs with equal keys
that cross the splits are then checked exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import split_of
from ..storage import cut
from .batches import column, gathered, parts

#: Error-free blocks that a pair must share: two, and three where there are more classes than this, so that buckets stay small.
CLEAN, MORE_CLEAN, MANY = 2, 3, 10_000_000
#: Rows in one partition, about.
PART = 200_000
#: A bucket of rows with the same key is divided into cells of at most so many rows of either side.
CELL = 50_000
#: Pairs compared at once within a task.
CHUNK = 4_000_000
#: Bits for the digits of a key; the number of its anchor stands above them.
DIGITS = 20
_OUT = pa.schema([("train_rep", pa.int64()), ("held_rep", pa.int64()), ("phash_bits", pa.int32()), ("dhash_bits", pa.int32())])
OUT = "train_rep long, held_rep long, phash_bits int, dhash_bits int"
#: What the records of a class have in common.
CLASS = ("c1", "c2", "phash", "dhash")


def records(index: DataFrame) -> DataFrame:
    """The readable files of a split: file_id, held (in val or test), split, domain, sha (lower case),
    and, where both hashes are usable, phash and dhash. A null hash, or a blank file, takes part by its content only; a null content hash by
    its signatures only; a null contrast or entropy isn't blank. A file delivered twice, whose rows are equal here, has two rows still; other
    columns are ignored."""
    blank = (F.col("contrast") < 2) | (F.col("entropy") < 0.5)
    usable = F.col("phash").isNotNull() & F.col("dhash").isNotNull() & ~F.coalesce(blank, F.lit(False))
    split = split_of(F.col("split"))
    rows = index.where(F.col("readable")).select("file_id", split.alias("split"), "domain", F.lower("sha256").alias("sha"), F.when(usable, F.col("phash")).alias("phash"), F.when(usable, F.col("dhash")).alias("dhash"))
    return rows.where(F.col("split").isNotNull()).withColumn("held", F.col("split") != "train")


def _coded(rows: DataFrame) -> DataFrame:
    """Records with two digests that stand for their content hash; those with nothing to compare are left out."""
    rows = rows.select("file_id", "held", "split", "domain", F.when(F.col("sha").isNotNull(), F.xxhash64("sha")).alias("c1"), F.when(F.col("sha").isNotNull(), F.xxhash64(F.reverse("sha"))).alias("c2"), "phash", "dhash")
    return rows.where("c1 IS NOT NULL OR phash IS NOT NULL")


def classes_of(rows: DataFrame) -> DataFrame:
    """The classes of equal records: their content and signatures, rep (the smallest file_id), and whether they hold records of train and held-out ones."""
    return _coded(rows).groupBy(*CLASS).agg(F.min("file_id").alias("rep"), F.bool_or(~F.col("held")).alias("in_train"), F.bool_or("held").alias("in_held"))


def members(rows: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, file_id, held, split, domain: the records of the classes in ``reps``, each once."""
    some = classes.join(reps, "rep", "left_semi").select("rep", *[F.col(c).alias(f"_{c}") for c in CLASS])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), CLASS, F.lit(True))
    return _coded(rows).join(some, same).select("rep", "file_id", "held", "split", "domain").distinct()


class Blocks:
    """The blocks of a signature, and the choices of blocks that key a row."""

    def __init__(self, max_p: int, clean: int):
        n = max_p + clean
        self.bounds = [64 * k // n for k in range(n + 1)]
        self.n, self.anchors = n, list(combinations(range(n - 1), clean - 1))

    def mask(self, k: int) -> int:
        return (1 << (self.bounds[k + 1] - self.bounds[k])) - 1

    def key(self, h: Column, anchor: tuple[int, ...]) -> Column:
        """The digits of an anchor's blocks as one number."""
        out = F.lit(0).cast("long")
        for k in anchor:
            width = self.bounds[k + 1] - self.bounds[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(h, self.bounds[k]).bitwiseAND(F.lit(self.mask(k))))
        return out

    def block(self, p: np.ndarray, k: int) -> np.ndarray:
        return (p >> np.uint64(self.bounds[k])) & np.uint64(self.mask(k))


def _keyed(classes: DataFrame, blocks: Blocks) -> DataFrame:
    """A row per class, side and key. bucket: the number of the anchor and its digits; the last number is for the content hash."""
    row = lambda number, digits, p, d: F.struct((F.lit(number << DIGITS) + digits).cast("int").alias("bucket"), p.alias("p"), d.alias("d"))
    p, c = F.col("phash"), F.col("c1")
    of_hash = [F.when(p.isNotNull(), row(k, blocks.key(p, a), p, F.col("dhash"))) for k, a in enumerate(blocks.anchors)]
    of_sha = F.when(c.isNotNull(), row(len(blocks.anchors), F.pmod(c, F.lit(1 << 16)), c, F.col("c2")))
    sides = F.array_compact(F.array(F.when(F.col("in_train"), F.lit(False)), F.when(F.col("in_held"), F.lit(True))))
    s = classes.select("rep", F.explode(sides).alias("held"), *CLASS).select("rep", "held", F.explode(F.array_compact(F.array(*of_hash, of_sha))).alias("s"))
    return s.select("rep", "held", "s.*")


def _with_cells(s: DataFrame) -> tuple[int, DataFrame]:
    """The number of rows, and the rows with the cells in which they are compared. Buckets with more than ``CELL`` rows of a side have
    several: each block of their train rows meets each block of their held-out rows in one."""
    counts = s.groupBy("bucket").agg(F.count_if(~F.col("held")).alias("t"), F.count_if("held").alias("h"))
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    counts = cut(counts.where("t > 0 AND h > 0").select("bucket", "t", "h", cells("t").alias("by_t"), cells("h").alias("by_h")))
    n = counts.agg(F.sum(F.col("t") * F.col("by_h") + F.col("h") * F.col("by_t"))).first()[0] or 0
    large = counts.where("by_t > 1 OR by_h > 1").select("bucket", "by_t", "by_h")
    if large.isEmpty():
        return n, s.withColumn("cell", F.lit(0))
    s = s.join(large, "bucket", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("by_t", "by_h")})
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("held"), F.col("by_h")).otherwise(F.col("by_t"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("held"), F.col("by_t")).otherwise(F.col("by_h")) - 1)
    cell = F.explode(F.transform(other, lambda o: F.when(F.col("held"), o * 65536 + mine).otherwise(mine * 65536 + o)))
    return n, s.withColumn("cell", cell).drop("by_t", "by_h")


def _pairs_of_runs(starts, ends, t_of):
    """Chunks of (train row, held row) for all cross pairs of the runs; rows are sorted so that in each run train comes
    first. starts, ends, t_of: bounds of runs and of their train part."""
    sizes = (t_of - starts) * (ends - t_of)
    keep = sizes > 0
    starts, ends, t_of, sizes = starts[keep], ends[keep], t_of[keep], sizes[keep]
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(total, CHUNK, "right")))
        if n == 1 and sizes[at] > CHUNK:  # one large run: blocks of its train rows against all its held rows
            step = max(1, CHUNK // int(ends[at] - t_of[at]))
            held = np.arange(t_of[at], ends[at])
            for lo in range(int(starts[at]), int(t_of[at]), step):
                train = np.arange(lo, min(lo + step, t_of[at]))
                yield np.repeat(train, len(held)), np.tile(held, len(train))
            at += 1
            continue
        s, z = slice(at, at + n), sizes[at : at + n]
        of = np.repeat(np.arange(n), z)
        k = np.arange(len(of)) - np.repeat(np.cumsum(z) - z, z)
        wide = (ends[s] - t_of[s])[of]
        yield starts[s][of] + k // wide, t_of[s][of] + k % wide
        at += n


def _overlaps(blocks: Blocks, max_p: int, max_d: int):
    shared = len(blocks.anchors[0])
    last = np.array([a[-1] for a in blocks.anchors] + [blocks.n])
    of_sha = len(blocks.anchors)

    def run(batches):
        t = gathered(batches)
        if t is None:
            return
        ids, held, bucket, cell = column(t, "rep"), column(t, "held"), column(t, "bucket").astype(np.int64), column(t, "cell").astype(np.int64)
        p, d = column(t, "p").view(np.uint64), column(t, "d").view(np.uint64)
        anchor = bucket >> DIGITS
        for j in range(shared, blocks.n + 1):  # a block after the anchor's; the last round is the content hash
            sha = j == blocks.n
            rows = np.flatnonzero(anchor == of_sha if sha else last[anchor] < j)
            if not len(rows):
                continue
            nxt = p[rows] if sha else blocks.block(p[rows], j)
            # Sorted by the key and this block; within equal ones train comes first.
            by = np.lexsort((held[rows], nxt, cell[rows], bucket[rows]))
            order, nn = rows[by], nxt[by]
            nb, nc = bucket[order], cell[order]
            new = np.ones(len(order), bool)  # where the neighbour differs
            new[1:] = (nb[1:] != nb[:-1]) | (nn[1:] != nn[:-1]) | (nc[1:] != nc[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order))
            t_of = starts + np.add.reduceat(~held[order], starts)
            for a, b in _pairs_of_runs(starts, ends, t_of):
                a, b = order[a], order[b]
                x = p[a] ^ p[b]
                if sha:
                    good = (x == 0) & (d[a] == d[b])
                    yield from _emit(ids[a[good]], ids[b[good]], None, None)
                    continue
                near = np.bitwise_count(x) <= max_p
                a, b, x = a[near], b[near], x[near]
                y = np.bitwise_count(d[a] ^ d[b])
                near = y <= max_d
                a, b, x, y = a[near], b[near], x[near], y[near]
                # Only at its first clean blocks, so that no pair comes out twice.
                before = np.zeros(len(a), np.int64)
                for k in range(j):
                    before += blocks.block(x, k) == 0
                first = before == shared
                yield from _emit(ids[a[first]], ids[b[first]], np.bitwise_count(x[first]), y[first])

    return run


def _emit(a, b, x, y):
    if len(a):
        none = pa.nulls(len(a), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none if x is None else pa.array(x.astype(np.int32)), none if y is None else pa.array(y.astype(np.int32))], schema=_OUT)


def class_pairs(classes: DataFrame, max_p: int = 6, max_d: int = 10, clean: int | None = None) -> DataFrame:
    """All pairs of a class with train records and a class with held-out records with the same content hash or with signatures at most
    ``max_p`` and ``max_d`` bits apart: train_rep, held_rep, phash_bits, dhash_bits (both null if the signatures are further apart or
    unusable); each pair once. A class with records of both sides is a pair with itself.

    ``classes`` is a table of :func:`classes_of`. A bucket of any size is divided into cells by blocks of its train rows and of its
    held-out rows, so that neither a task nor its memory grows with it. Empty tables give an empty result.
    """
    if clean is None:
        clean = CLEAN if classes.count() <= MANY else MORE_CLEAN
    if not 2 <= clean <= MORE_CLEAN or not 0 <= max_p <= 16:
        raise ValueError("2 or 3 clean blocks, and up to 16 bits")
    blocks = Blocks(max_p, clean)
    if max(b - a for a, b in zip(blocks.bounds, blocks.bounds[1:])) * (clean - 1) > DIGITS - 2:
        raise ValueError(f"{max_p} bits need more clean blocks")
    n, s = _with_cells(_keyed(classes, blocks))
    some = parts(n, PART, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = s.repartition(some, "bucket", "cell").mapInArrow(_overlaps(blocks, max_p, max_d), OUT)
    return found.groupBy("train_rep", "held_rep").agg(F.max("phash_bits").alias("phash_bits"), F.max("dhash_bits").alias("dhash_bits"))


class Overlaps:
    """The overlapping classes of ``rows``, a result of :func:`records`, and their records. Classes and pairs of classes are kept; pairs of
    records are only formed by :attr:`pairs`, as many as there are."""

    def __init__(self, rows: DataFrame, max_p: int = 6, max_d: int = 10, clean: int | None = None):
        classes = cut(classes_of(rows))
        self.classes = cut(class_pairs(classes, max_p, max_d, clean))
        ends = self.classes.select(F.col("train_rep").alias("rep")).union(self.classes.select("held_rep")).distinct()
        self.members = cut(members(rows, classes, ends))

    @property
    def pairs(self) -> DataFrame:
        """train_id, held_id, phash_bits, dhash_bits of all overlapping records, each pair once."""
        of = lambda side, condition: self.members.where(condition).select(F.col("rep").alias(f"{side}_rep"), F.col("file_id").alias(f"{side}_id"))
        return self.classes.join(of("train", "NOT held"), "train_rep").join(of("held", "held"), "held_rep").select("train_id", "held_id", "phash_bits", "dhash_bits")

    @property
    def counts(self) -> DataFrame:
        """split, domain, n_files, n_pairs: the held-out records that overlap with train and their pairs, counted per class."""
        train = self.members.where("NOT held").groupBy(F.col("rep").alias("train_rep")).agg(F.count(F.lit(1)).alias("n"))
        per = self.classes.join(train, "train_rep").groupBy(F.col("held_rep").alias("rep")).agg(F.sum("n").alias("n"))
        return self.members.where("held").join(per, "rep").groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_pairs"))


def overlaps(rows: DataFrame, max_p: int = 6, max_d: int = 10, clean: int | None = None) -> DataFrame:
    """:attr:`Overlaps.pairs`."""
    return Overlaps(rows, max_p, max_d, clean).pairs
