"""How much of each record's bytes also stands in records of the other side, by a suffix array.

A record's text is the bytes of its content hash and its two signatures, whatever of them it has; the texts are a corpus in two parts, train
and held-out. A suffix matters if its first ``LEAST`` bytes stand on both sides. Which ones do is found in chunks of texts: each
chunk sends its distinct beginnings, packed, to partitions by hash, and gets back those that another chunk has on the other side. Only the suffixes
that start so are formed, sorted by ranges into one array, and the longest common prefixes with the nearest suffixes of the other side, before and
after, give each its longest match. The matches of a record are merged into its coverage.

A beginning that a third of all records have is one entry per chunk, equal suffixes are one entry of the array, and ranges of the array have bounded
sizes whatever their suffixes begin with; the neighbours beyond a range's ends are handed to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_skewed
from ..storage import cut
from .batches import gathered, parts

#: Bytes of a match, at least: one whole signature.
LEAST = 8
#: Texts of one chunk.
CHUNK = 20_000
#: Beginnings in one partition, and suffixes in one range, about.
PART, RANGE = 4_000_000, 200_000
TRAIN, HELD = 1, 2
_ENTRY = np.dtype([("key", "<u8"), ("side", "u1")])


def _beginnings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, number) of the first bytes of all suffixes of at least ``LEAST`` bytes."""
    size = np.array([len(x) for x in texts])
    out = []
    for n in np.unique(size[size >= LEAST]).tolist():
        rows = np.flatnonzero(size == n)
        flat = np.frombuffer(b"".join([texts[k] for k in rows]), np.uint8).reshape(-1, n)
        windows = np.lib.stride_tricks.sliding_window_view(flat, LEAST, 1)
        keys = np.ascontiguousarray(windows).view(">u8")[:, :, 0].astype(np.uint64)
        out.append((np.repeat(rows, keys.shape[1]), np.tile(np.arange(keys.shape[1]), len(rows)), keys.ravel()))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _distinct(keys: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sides they stand on."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.bitwise_or.reduceat(sides[order], starts) if len(keys) else sides[:0]


def _packed(some: int):
    """Each chunk's distinct beginnings with their sides, as one block of bytes per partition."""

    def run(table: pa.Table) -> pa.Table:
        texts, side = table.column("text").to_pylist(), table.column("side").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8)
        row, _, keys = _beginnings(texts)
        keys, sides = _distinct(keys, side[row])
        to = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(some)
        entries = np.empty(len(keys), _ENTRY)
        order = np.argsort(to, kind="stable")
        entries["key"], entries["side"] = keys[order], sides[order]
        bounds = np.searchsorted(to[order], np.arange(some + 1))
        full = [k for k in range(some) if bounds[k] < bounds[k + 1]]
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(full), pa.int64()), "part": pa.array(full, pa.int32()), "entries": pa.array([entries[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())})

    return run


def _on_both(batches):
    """For each chunk the beginnings that stand on both sides of the corpus."""
    t = gathered(batches)
    if t is None:
        return
    blocks = [np.frombuffer(x, _ENTRY) for x in t.column("entries").to_pylist()]
    keys, sides = _distinct(np.concatenate([b["key"] for b in blocks]), np.concatenate([b["side"] for b in blocks]))
    both = keys[sides == (TRAIN | HELD)]
    if not len(both):
        return
    for chunk, b in zip(t.column("chunk").to_pylist(), blocks, strict=True):
        own = b["key"][np.isin(b["key"], both)]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["chunk", "keys"])


def _suffixes(texts: pa.Table, keys: pa.Table) -> pa.Table:
    """The suffixes of a chunk that begin with one of the keys."""
    own = texts.column("text").to_pylist()
    known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in keys.column("keys").to_pylist()])) if keys.num_rows else np.zeros(0, np.uint64)
    row, at, first = _beginnings(own if len(known) else [])
    kept = np.isin(first, known)
    row, at = row[kept], at[kept]
    return pa.table({"id": texts.column("id").combine_chunks().take(pa.array(row)), "at": pa.array(at, pa.int32()), "side": texts.column("side").combine_chunks().take(pa.array(row)), "suffix": pa.array([own[r][a:] for r, a in zip(row.tolist(), at.tolist())], pa.binary())})


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] isn't
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def matches(suffixes: list[bytes], sides: list[int], before: dict[int, bytes | None], after: dict[int, bytes | None]) -> list[int]:
    """Of each of the sorted suffixes the longest common prefix with a suffix of the other side. ``before`` and ``after``: the nearest suffix of
    each side beyond the ends."""
    best = [len(s) if side == (TRAIN | HELD) else 0 for s, side in zip(suffixes, sides, strict=True)]
    for nearest, way in ((dict(before), range(len(suffixes))), (dict(after), range(len(suffixes) - 1, -1, -1))):
        for k in way:
            for side, other in ((TRAIN, HELD), (HELD, TRAIN)):
                if sides[k] & side and nearest[other] is not None and best[k] < len(suffixes[k]):
                    best[k] = max(best[k], common(suffixes[k], nearest[other]))
            for side in (TRAIN, HELD):
                if sides[k] & side:
                    nearest[side] = suffixes[k]
    return best


def _matched(ends: dict[int, dict[int, tuple[bytes, bytes]]]):
    """``ends``: of each range the first and the last suffix of each side."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py() if table.num_rows else 0
        text, side = table.column("suffix").to_pylist(), table.column("side").to_pylist()
        order = sorted(range(len(text)), key=text.__getitem__)
        before = {s: max((e[s][1] for r, e in ends.items() if r < number and s in e), default=None) for s in (TRAIN, HELD)}
        after = {s: min((e[s][0] for r, e in ends.items() if r > number and s in e), default=None) for s in (TRAIN, HELD)}
        found = matches([text[k] for k in order], [side[k] for k in order], before, after)
        return pa.table({"suffix": pa.array([text[k] for k in order], pa.binary()), "length": pa.array(found, pa.int32())})

    return run


def array(suffixes: DataFrame) -> DataFrame:
    """suffix, length: the longest match on the other side of each of the distinct ``suffixes`` (suffix, side), by one array sorted across ranges."""
    n = suffixes.count()
    some = parts(n, RANGE, 1)
    ranged = cut(suffixes.repartitionByRange(some, "suffix").withColumn("range", F.spark_partition_id()))
    on = lambda s: F.when(F.col("side").bitwiseAND(F.lit(s)) != 0, F.col("suffix"))
    ends = {r.range: {s: (r[f"lo{s}"], r[f"hi{s}"]) for s in (TRAIN, HELD) if r[f"lo{s}"] is not None} for r in ranged.groupBy("range").agg(*[f(on(s)).alias(f"{k}{s}") for s in (TRAIN, HELD) for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
    ends = {r: {s: (bytes(lo), bytes(hi)) for s, (lo, hi) in e.items()} for r, e in ends.items()}  # four suffixes a range
    return ranged.groupBy("range").applyInArrow(_matched(ends), "suffix binary, length int")


def coverage(rows: DataFrame) -> DataFrame:
    """file_id, split, n_bytes, n_shared, longest: the records with a stretch of at least ``LEAST`` bytes that also stands in a record of
    the other side (train, or val and test), how many of their bytes lie in such stretches, and the longest of them.

    ``rows`` is the result of :func:`hamming_overlap.records`; content hashes that are no pairs of hexadecimal digits don't count. Equal texts are
    treated once. Empty tables give an empty result.
    """
    number = lambda h: F.coalesce(F.lpad(F.hex(h), 16, "0"), F.lit(""))
    sha = F.coalesce(F.when(F.col("sha").rlike("^([0-9a-f]{2})+$"), F.col("sha")), F.lit(""))
    texts = rows.select("file_id", "split", F.unhex(F.concat(sha, number("phash"), number("dhash"))).alias("text"), F.when(F.col("held"), HELD).otherwise(TRAIN).cast("byte").alias("side"))
    texts = texts.where(F.length("text") >= LEAST)
    once = cut(texts.groupBy("text").agg(F.bit_or("side").alias("side")).withColumn("id", F.monotonically_increasing_id()))
    once = once.withColumn("chunk", (F.col("id") / CHUNK).cast("long"))  # numbers follow each other within a partition
    n = once.agg(F.sum(F.length("text") - LEAST + 1)).first()[0] or 0
    some = parts(n, PART, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = once.groupBy("chunk").applyInArrow(_packed(some), "chunk long, part int, entries binary")
    both = packed.repartitionById(some, "part").mapInArrow(_on_both, "chunk long, keys binary")
    spots = once.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_suffixes, "id long, at int, side byte, suffix binary")
    spots = cut(spots)
    distinct = cut(spots.groupBy("suffix").agg(F.bit_or("side").alias("side"), F.count(F.lit(1)).alias("n")))
    found = array(distinct.select("suffix", "side")).where(F.col("length") >= LEAST)
    found = join_skewed(spots.select("id", "at", "suffix"), found, "suffix", hot_keys(distinct, "suffix"), "inner")
    per = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("length").alias("n")))).alias("m"), F.max("length").alias("longest"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["total"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("total"))
    per = cut(per.select("id", F.aggregate("m", start, step)["total"].alias("n_shared"), "longest"))
    per = once.join(per, "id").select("text", F.length("text").alias("n_bytes"), "n_shared", "longest")
    return texts.join(per, "text").select("file_id", "split", "n_bytes", "n_shared", "longest").distinct()
