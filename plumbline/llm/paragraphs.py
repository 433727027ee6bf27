"""Paragraphs that stand in several documents, exactly or nearly, by MinHash banding.

Paragraphs with the same set of five-word shingles form a class (one of fewer words has one shingle of all its words); signatures, bands and
comparisons are made once per class. Classes that collide in a band are compared by the exact Jaccard similarity of their shingle sets, and the links
found are consolidated into clusters. Of each cluster the first paragraph stays, the others are removals.

Which buckets hold several classes is found in chunks of paragraphs: each chunk sends its distinct buckets, packed, to partitions by hash,
and gets back those in which classes collide; a bucket that a third of all paragraphs fall into is one entry per chunk. Shingles are
made again for the classes that collided, and never stored for the others.

A bucket's pairs are compared inside tasks that emit only a spanning forest of the links found, never the pairs; a bucket of
any size is divided into cells, each two blocks of its classes, so that no task holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_skewed
from ..storage import cut
from .batches import column, gathered, parts
from .components import components
from .words import words

SHINGLE = 5
SIMILARITY = 0.8
HASHES = 56
RECALL = 0.999
#: Classes of a bucket in one block; a cell holds two blocks.
BLOCK = 1_000
#: Rows with their shingles in one partition, about.
PART = 20_000
#: Documents of one chunk; entries of buckets in one partition, about.
CHUNK, ENTRIES = 5_000, 8_000_000
#: Bits of a bucket's number, and of the class beside it, in a packed entry; the last bit tells that the chunk has several classes.
BUCKET_BITS, CLASS_BITS = 40, 23
#: Cells of fewer classes are compared pair by pair.
FEW = 24
PARAGRAPHS = "doc_id long, paragraph int, chunk long, class long, bands array<long>"
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
_ODD, _ODD2 = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def bands(hashes: int = HASHES, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands with which a pair of the given similarity still collides with the wanted
    probability."""
    for rows in range(hashes, 0, -1):
        if 1 - (1 - similarity**rows) ** (hashes // rows) >= recall:
            return hashes // rows, rows
    return hashes, 1


class Shingles:
    """The shingle sets of paragraphs, as sorted 64-bit numbers. Hashes of words are remembered up to a bound."""

    def __init__(self, remembered: int = 300_000):
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def of(self, paragraphs: Iterable[str]) -> list[np.ndarray]:
        """One set per paragraph, empty for one without words."""
        if len(self.known) > self.remembered:
            self.known.clear()
        flat, sizes, known = [], [], self.known
        for paragraph in paragraphs:
            w = words(paragraph)
            for x in w:
                h = known.get(x)
                if h is None:
                    known[x] = h = xxhash.xxh64_intdigest(x)
                flat.append(h)
            sizes.append(len(w))
        x = np.array(flat, np.uint64)
        x ^= x >> np.uint64(31)
        grams = np.zeros(max(0, len(x) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams = grams * _ODD + x[k : k + len(grams)]
        grams ^= grams >> np.uint64(32)
        out, end = [], 0
        for n in sizes:
            end += n
            if n >= SHINGLE:
                out.append(np.unique(grams[end - n : end - SHINGLE + 1]))
            else:
                whole = np.full(min(n, 1), n, np.uint64)
                for k in range(end - n, end):
                    whole = whole * _ODD2 + x[k]
                out.append(whole)
        return out


def _class(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _codes(sets: list[np.ndarray], seeds: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The buckets of each set, one per band."""
    starts, joined = np.cumsum([0, *map(len, sets)])[:-1], np.concatenate(sets)
    least = np.empty((len(sets), len(seeds)), np.uint64)
    for k, seed in enumerate(seeds):
        y = (joined ^ seed) * _ODD2
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least[:, k] = np.minimum.reduceat(y ^ (y >> np.uint64(32)), starts)
    b, r = shape
    code = np.repeat(np.arange(b, dtype=np.uint64)[None, :], len(sets), 0)
    for k in range(r):
        code = (code ^ least[:, k : b * r : r]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    return code


def signed(documents: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """The paragraphs that have a word: doc_id, paragraph (its place among all paragraphs of the text), chunk, class, bands."""
    seeds = np.random.default_rng(7).integers(0, 2**64, shape[0] * shape[1], np.uint64)

    def run(batches):
        shingles, chunk, seen = Shingles(), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                row, number, texts = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, paragraph in enumerate(_BREAK.split(text)) if text else ():
                        row.append(doc)
                        number.append(i)
                        texts.append(paragraph)
                sets = shingles.of(texts)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    sets = [sets[i] for i in some]
                    code = np.ascontiguousarray(_codes(sets, seeds, shape)).view(np.int64).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * shape[0]), pa.array(code))
                    yield pa.RecordBatch.from_arrays([pa.array([row[i] for i in some], pa.int64()), pa.array([number[i] for i in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(list(map(_class, sets)), pa.int64()), lists], ["doc_id", "paragraph", "chunk", "class", "bands"])
                seen += part.num_rows
                if seen >= CHUNK:
                    chunk, seen = chunk + 1, 0

    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PARAGRAPHS)


def _several(entries: np.ndarray) -> np.ndarray:
    """Sorted packed entries to one per bucket: its number, a class, and whether there are several."""
    entries = np.sort(entries)
    bucket = entries >> np.uint64(CLASS_BITS + 1)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(entries)] - 1
    more = np.bitwise_or.reduceat(entries & np.uint64(1), starts) | ((entries[starts] >> np.uint64(1)) != (entries[ends] >> np.uint64(1))).astype(np.uint64)
    return (entries[starts] & ~np.uint64(1)) | more


def _packed(some: int):
    """The distinct buckets of each chunk, as one block of entries per partition."""

    def run(batches):
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            codes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            classes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - CLASS_BITS)
            entries = ((codes >> np.uint64(64 - BUCKET_BITS)) << np.uint64(CLASS_BITS + 1)) | (classes << np.uint64(1))[:, None]
            for chunk in np.unique(chunks).tolist():
                own = _several(entries[chunks == chunk].ravel())
                to = (own >> np.uint64(CLASS_BITS + 1)) % np.uint64(some)
                order = np.argsort(to, kind="stable")
                own, bounds = own[order], np.searchsorted(to[order], np.arange(some + 1))
                full = [k for k in range(some) if bounds[k] < bounds[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([own[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())], ["chunk", "part", "entries"])

    return run


def _collided(batches):
    """For each chunk its buckets that hold several classes."""
    t = gathered(batches)
    if t is None:
        return
    blocks = [np.frombuffer(x, np.uint64) for x in t.column("entries").to_pylist()]
    whole = _several(np.concatenate(blocks))
    many = whole[(whole & np.uint64(1)) == 1] >> np.uint64(CLASS_BITS + 1)
    for chunk, b in zip(t.column("chunk").to_pylist(), blocks, strict=True):
        own = b >> np.uint64(CLASS_BITS + 1)
        own = own[np.isin(own, many)]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["chunk", "buckets"])


def _banded(rows: pa.Table, buckets: pa.Table) -> pa.Table:
    """(bucket, class) of a chunk's classes in the buckets, once each."""
    out = pa.schema([("bucket", pa.int64()), ("class", pa.int64())])
    if not rows.num_rows or not buckets.num_rows:
        return out.empty_table()
    known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in buckets.column("buckets").to_pylist()]))
    codes = rows.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    classes = np.repeat(column(rows, "class"), len(codes) // rows.num_rows)
    kept = np.isin(codes >> np.uint64(64 - BUCKET_BITS), known)
    pairs = np.unique(np.stack([codes[kept].view(np.int64), classes[kept]], 1), axis=0)
    return pa.table({"bucket": pairs[:, 0], "class": pairs[:, 1]}, schema=out)


def _shingled(batches):
    """class, shingles of the listed paragraphs (place, class) of each text."""
    shingles = Shingles()
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts, of = [], []
            for text, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                split = _BREAK.split(text)
                for x in listed:
                    texts.append(split[x["paragraph"]])
                    of.append(x["class"])
            sets = shingles.of(texts)
            if sets:
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["class", "shingles"])


def forest(sets: list[np.ndarray], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets: of all pairs, or if there are two sides, of pairs across. A set that has joined a tree is
    compared with those outside it only."""
    n, across = len(sets), len(set(sides)) > 1
    size = np.array([len(s) for s in sets])
    out, left = [], np.ones(n, bool)
    plain = [set(s.tolist()) for s in sets] if n < FEW else None
    if plain is None:
        ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        mark = np.zeros(len(ids), bool)
    side = np.array(sides)
    for first in range(n):
        if not left[first]:
            continue
        left[first], tree = False, [first]
        while tree:
            a = tree.pop()
            near = left & (size >= similarity * size[a]) & (size * similarity <= size[a])
            near = np.flatnonzero(near & (side != side[a]) if across else near)
            if not len(near):
                continue
            if plain is not None:
                both = np.array([len(plain[a] & plain[b]) for b in near])
            else:
                own = flat[starts[a] : starts[a] + size[a]]
                mark[own] = True
                n_near = size[near]
                at = np.repeat(starts[near] - (np.cumsum(n_near) - n_near), n_near) + np.arange(n_near.sum())
                both = np.add.reduceat(mark[flat[at]], np.cumsum(n_near) - n_near, dtype=np.int64)
                mark[own] = False
            for b in near[both >= similarity * (size[a] + size[near] - both)].tolist():
                left[b] = False
                tree.append(b)
                out.append((a, b))
    return out


def _links(similarity: float):
    """The spanning forest of the links within each cell of a partition."""

    def run(batches):
        t = gathered(batches)
        if t is None:
            return
        bucket, cell, side, cls = (column(t, c) for c in ("bucket", "cell", "side", "class"))
        lists = t.column("shingles").combine_chunks()
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        order = np.lexsort((cls, cell, bucket))
        new = np.flatnonzero(np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (cell[order][1:] != cell[order][:-1])])
        a, b = [], []
        for own in np.split(order, new[1:]):
            for i, j in forest([flat[offsets[k] : offsets[k + 1]] for k in own], side[own].tolist(), similarity):
                a.append(cls[own[i]])
                b.append(cls[own[j]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def collisions(paragraphs: DataFrame) -> DataFrame:
    """bucket, class of the buckets with several classes; a class may come out of several chunks."""
    chunk = paragraphs.select("chunk", "class", "bands")
    n = paragraphs.agg(F.sum(F.size("bands"))).first()[0] or 0
    some = parts(n, ENTRIES, int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = chunk.mapInArrow(_packed(some), "chunk long, part int, entries binary")
    many = packed.repartitionById(some, "part").mapInArrow(_collided, "chunk long, buckets binary")
    return chunk.groupBy("chunk").cogroup(many.groupBy("chunk")).applyInArrow(_banded, "bucket long, class long")


def clusters(documents: DataFrame, similarity: float = SIMILARITY, hashes: int = HASHES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, paragraph, cluster, removed: the paragraphs that have an equal or similar one, directly or through others.
    cluster is the smallest class number in it; removed is false for its first paragraph by doc_id and place.

    ``documents`` has doc_id (unique) and text. Null and empty texts and paragraphs without a word have no rows; paragraphs of under five words are
    only similar if equal. A pair of classes at the similarity bound is compared with probability ``recall`` at least. Empty tables give an empty
    result.
    """
    shape = bands(hashes, similarity, recall)
    paragraphs = cut(signed(documents, shape))
    found = _compared(documents, paragraphs, similarity, block)
    counts = paragraphs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    met = cut(counts.join(found.select(F.col("node").alias("class"), "component"), "class", "left").where("n > 1 OR component IS NOT NULL").select("class", "n", F.coalesce("component", "class").alias("cluster")))
    rows = join_skewed(paragraphs.select("doc_id", "paragraph", "class"), met.select("class", "cluster"), "class", hot_keys(met.select("class", "n"), "class"), "inner")
    rows = cut(rows)
    whole = cut(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "paragraph")).alias("first")))
    rows = join_skewed(rows, whole.select("cluster", "first"), "cluster", hot_keys(whole.select("cluster", "n"), "cluster"), "inner")
    return rows.select("doc_id", "paragraph", "cluster", (F.struct("doc_id", "paragraph") != F.col("first")).alias("removed"))


def _compared(documents: DataFrame, paragraphs: DataFrame, similarity: float, block: int) -> DataFrame:
    """node, component: the classes linked to others."""
    banded = cut(collisions(paragraphs).distinct())
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y")).where("n > 1")
    # Buckets of different bands with the same members are compared once.
    kept = cut(sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    members = join_skewed(banded, kept, "bucket", hot_keys(kept, "bucket"), "inner")
    of = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("class"), of).cast("int")
    cells = F.transform(F.sequence(F.lit(0), of - 1), lambda o: F.struct((F.least(o, mine).cast("long") * 1_000_000 + F.greatest(o, mine)).alias("cell"), F.when(o < mine, 1).otherwise(0).alias("side")))
    members = cut(members.select("bucket", "class", F.explode(cells).alias("c")).select("bucket", "class", "c.cell", "c.side"))
    wanted = members.select("class").distinct()
    first = paragraphs.select("class", "doc_id", "paragraph").join(wanted, "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "paragraph")).alias("at"))
    listed = cut(first.select("at.doc_id", F.struct("at.paragraph", "class").alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("listed")))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(listed, "doc_id").select("text", "listed")
    shingles = texts.mapInArrow(_shingled, "class long, shingles array<long>")
    some = parts(members.count(), PART, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = members.join(shingles, "class").repartition(some, "bucket", "cell").mapInArrow(_links(similarity), "a long, b long")
    return cut(components(cut(links), "a", "b"))
