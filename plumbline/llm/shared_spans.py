"""Spans of at least a given length that stand verbatim in more than one document.

Every stretch of ``least`` characters holds ``least - gram + 1`` grams; the smallest of their hashes is its anchor, the same
wherever the stretch stands. Neighbouring stretches mostly have the same anchor, so there are few anchors, about one in a hundred characters, and
only they are compared across all documents, by an aggregate per anchor that keeps the smallest and the largest text.

Where an anchor is in several texts, the pieces of text whose stretches have it meet in one task; the task hashes all stretches of the pieces (twice 64 bits) and
gives back intervals of those that stand in several documents. An anchor of more pieces than a task should hold is treated apart: its stretches are
compared one by one, by aggregates per hash, so that a passage that a third of all documents hold is no larger than any other. No pairs
are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_skewed
from ..storage import cut
from .batches import parts, texts

LEAST = 300
GRAM = 100
#: Pieces of text in one partition, about; anchors of more are treated by aggregates. Stretches of one piece, at most.
PIECES, LONGEST = 20_000, 2_000
#: Characters handled at once in a task, unless one text has more.
CHARS = 500_000
_SEEDS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAEF17502108EF2D9))


class Rolling:
    """Hashes of all stretches of a sequence of characters: sums of a random number per character times powers of an odd base,
    modulo 2^64."""

    def __init__(self, characters: np.ndarray, which: int):
        salt, base = _SEEDS[which]
        x = (characters.astype(np.uint64) + np.uint64(1)) * np.uint64(salt)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        powers, self.back = _powers(base, len(x) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])

    def of(self, at: np.ndarray | slice, length: int) -> np.ndarray:
        """The hash of ``length`` characters from each place."""
        if isinstance(at, slice):
            h = (self.sums[at.start + length : at.stop + length] - self.sums[at]) * self.back[at]
        else:
            h = (self.sums[at + length] - self.sums[at]) * self.back[at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse."""
    if base not in _CACHE or len(_CACHE[base][0]) < n:
        grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHARS), b, np.uint64)]), dtype=np.uint64)
        _CACHE[base] = grow(base), grow(pow(base, -1, 2**64))
    return _CACHE[base]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    padded = np.full(-(-len(a) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _pieces(batch: pa.RecordBatch, name: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with their code points and the n + 1 offsets of the rows among them."""
    data, offsets = texts(batch, name)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])[offsets]
    a = 0
    while a < len(points) - 1:
        b = max(a + 1, int(np.searchsorted(points, points[a] + CHARS, "right")) - 1)
        raw = data[offsets[a] : offsets[b]].tobytes().decode().encode("utf-32-le")
        yield slice(a, b), np.frombuffer(raw, np.uint32), points[a : b + 1] - points[a]
        a = b


def _stretches(bounds: np.ndarray, least: int) -> np.ndarray:
    """Whether a stretch of ``least`` characters starts at each place and ends in the same row."""
    step = np.zeros(bounds[-1] + 1, np.int32)
    size = np.maximum(np.diff(bounds) - least + 1, 0)
    np.add.at(step, bounds[:-1], (size > 0).astype(np.int32))
    np.add.at(step, bounds[:-1] + size, -(size > 0).astype(np.int32))
    return np.cumsum(step)[:-1] > 0


def _anchored(characters: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The places at which stretches start, and each one's anchor."""
    grams = Rolling(characters, 0).of(slice(0, max(0, len(characters) - gram + 1)), gram)
    lowest = sliding_min(grams, least - gram + 1)
    at = np.flatnonzero(_stretches(bounds, least)[: len(lowest)])
    return at, lowest[at]


def _anchors(least: int, gram: int):
    """The anchors of each text, once each, under the number of its class."""

    def run(batches):
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, characters, bounds in _pieces(batch, "text"):
                at, anchor = _anchored(characters, bounds, least, gram)
                if not len(at):
                    continue
                row = np.searchsorted(bounds, at, "right") - 1
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])  # neighbours mostly have the same anchor
                row, anchor = row[new], anchor[new]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                once = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(classes[rows][row[once]]), pa.array(anchor[once].view(np.int64))], ["class", "anchor"])

    return run


def _with_anchor(batch: pa.RecordBatch, name: str, least: int, gram: int):
    """Runs of rows as of :func:`_pieces`, and the places and anchors of their stretches whose anchor is listed in the column ``name`` of the row,
    or of a row beside it, which costs a comparison more."""
    lists = batch.column(batch.schema.get_field_index(name))
    for rows, characters, bounds in _pieces(batch, "text"):
        own = lists.slice(rows.start, rows.stop - rows.start).flatten().to_numpy(zero_copy_only=False)
        if len(own):
            at, anchor = _anchored(characters, bounds, least, gram)
            keep = np.isin(anchor, own.astype(np.int64).view(np.uint64))
            if keep.any():
                yield rows, characters, bounds, at[keep], anchor[keep]


def _cut_out(least: int, gram: int):
    """The pieces of the texts whose stretches have one of the listed anchors: anchor, doc_id, at and the piece."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, characters, bounds, at, anchor in _with_anchor(batch, "anchors", least, gram):
                row = np.searchsorted(bounds, at, "right") - 1
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
                sizes = np.diff(np.r_[new, len(at)])
                more = -(-sizes // LONGEST)  # long runs, as of a character repeated, are divided
                k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                first = np.repeat(new, more) + k * LONGEST
                last = np.minimum(first + LONGEST, np.repeat(new + sizes, more)) - 1
                raw = characters.tobytes()
                pieces = [raw[4 * a : 4 * (b + least)].decode("utf-32-le") for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[rows][row[first]]), pa.array(at[first] - bounds[row[first]]), pa.array(pieces)], ["anchor", "doc_id", "at", "piece"])

    return run


def _several(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each pair of hashes stands in more than one document."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h))
    new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    among = doc[order]
    more = np.minimum.reduceat(among, new) < np.maximum.reduceat(among, new)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(more, np.diff(np.r_[new, len(h)]))
    return out


def _intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the intervals of each document, as few as possible; those that touch are one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * (int(end.max()) + 1)  # so that ends of an earlier document lie below
    reach = np.maximum.accumulate(number + end)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] + start[1:] > reach[:-1])])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], (reach - number)[last]


SPANS = "doc_id long, span_start long, span_end long"


def _spans_of(doc, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _intervals(doc, start, end)], ["doc_id", "span_start", "span_end"])


def _compared(least: int):
    """Intervals of the stretches of the pieces of one partition that stand in several documents."""

    def run(batches):
        found = []
        for batch in batches:
            ids, places = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for rows, characters, bounds in _pieces(batch, "piece"):
                at = np.flatnonzero(_stretches(bounds, least))
                row = np.searchsorted(bounds, at, "right") - 1
                h, h2 = (Rolling(characters, k).of(at, least) for k in (0, 1))
                found.append((h, h2, ids[rows][row], places[rows][row] + at - bounds[row]))
        if found:
            h, h2, doc, at = (np.concatenate(x) for x in zip(*found))
            more = _several(h, h2, doc)
            if more.any():
                yield _spans_of(doc[more], at[more], at[more] + least)

    return run


def _hashed(least: int, gram: int):
    """doc_id, at and the hashes of the stretches with an anchor listed in ``often``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, characters, bounds, at, _ in _with_anchor(batch, "often", least, gram):
                row = np.searchsorted(bounds, at, "right") - 1
                h = [Rolling(characters, k).of(at, least).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][row]), pa.array(at - bounds[row]), *map(pa.array, h)], ["doc_id", "at", "h", "h2"])

    return run


def _merged(batches):
    """The intervals of whole documents, merged."""
    for batch in batches:
        lists = batch.column(1)
        if batch.num_rows:
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            start, end = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield _spans_of(doc, start, end)


def _elsewhere(rows: DataFrame) -> DataFrame:
    """The stretches that stand in more than one document."""
    keys = ["h", "h2"]
    counts = cut(rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select(*keys, "n"))
    return join_skewed(rows, counts.drop("n"), "h", hot_keys(counts.groupBy("h").agg(F.sum("n").alias("n")), "h"), "left_semi", ("h2",))


def shared_spans(documents: DataFrame, least: int = LEAST, gram: int | None = None) -> DataFrame:
    """doc_id, span_start, span_end: the longest runs of positions of a text that lie in ``least`` or more consecutive characters
    which stand exactly so in the text of another doc_id. Positions are code points from 0, the end is exclusive.

    ``documents`` has doc_id (unique) and text. Null, empty and shorter texts have no spans; of copies of a long enough text every
    one is a span from end to end. Texts are taken whole, whatever their length. Equality of stretches, and of whole texts, is that of two 64-bit
    hashes. Empty tables give an empty result.
    """
    gram = gram or max(1, GRAM * least // LEAST)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= least).withColumn("class", F.xxhash64("text"))
    # Copies are a class; the first of each goes on for what others share with it.
    keys = cut(docs.select("doc_id", "class", F.xxhash64(F.lit(1), "text").alias("second"), F.length("text").cast("long").alias("size")))
    classes = cut(keys.groupBy("class", "second").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    repeated = classes.where("n > 1")
    hot = hot_keys(repeated.groupBy("class").agg(F.sum("n").alias("n")), "class")
    copies = join_skewed(keys, repeated.select("class", "second"), "class", hot, "left_semi", ("second",))
    copies = copies.select("doc_id", F.lit(0).cast("long").alias("span_start"), F.col("size").alias("span_end"))

    anchors = cut(docs.select("class", "text").mapInArrow(_anchors(least, gram), "class long, anchor long"))
    shared = anchors.groupBy("anchor").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = cut(shared.select("anchor", "n", (F.col("n") > PIECES).alias("often")))
    some, often = shared.agg(F.sum(F.when(~F.col("often"), F.col("n"))), F.bool_or("often")).first()
    listed = join_skewed(anchors, shared.select("anchor", "often"), "anchor", hot_keys(shared.select("anchor", "n"), "anchor"), "inner")
    listed = listed.groupBy("class").agg(F.collect_set(F.when(~F.col("often"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("often"), F.col("anchor"))).alias("often"))
    listed = listed.join(classes.select("class", F.col("first").alias("doc_id"), (F.col("n") > 1).alias("copied")), "class").select("doc_id", "copied", "anchors", "often")
    listed = cut(listed)
    texts = docs.select("doc_id", "text").join(listed.drop("copied"), "doc_id").select("doc_id", "text", "anchors", "often")
    pieces = texts.mapInArrow(_cut_out(least, gram), "anchor long, doc_id long, at long, piece string")
    least_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces.repartition(parts(some or 0, PIECES, least_parts), "anchor").mapInArrow(_compared(least), SPANS)
    if often:
        stretches = cut(texts.where(F.size("often") > 0).mapInArrow(_hashed(least, gram), "doc_id long, at long, h long, h2 long"))
        found = found.unionByName(_elsewhere(stretches).select("doc_id", F.col("at").alias("span_start"), (F.col("at") + least).alias("span_end")))
    whole = found.groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    whole = whole.join(listed.where("copied").select("doc_id"), "doc_id", "left_anti")
    return whole.mapInArrow(_merged, SPANS).unionByName(copies)
