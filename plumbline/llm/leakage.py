"""Passages of held-out test items inside a large corpus.

A passage is a window of consecutive words of an item. It is split into budget + 1 pieces; a stretch of a document within
that edit distance (in words) of the window must hold one of the pieces exactly. So documents are scanned for exact hits of
pieces, by rolling hashes of word numbers, and each window with a hit is verified around it with Myers' bit-parallel
distance. The items are a small query set against the whole corpus: they go to every task, in blocks of bounded size, and
documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import myers, words

WINDOW, BUDGET = 13, 2
#: Characters of item texts that one pass over the corpus takes.
BLOCK = 4_000_000
OUT = "doc_id long, item_id long, distance int"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Items:
    """The windows and pieces of some items, ready for scanning. With ``short``, an item of fewer words than a window is one window of its own
    length, with its share of the budget, rounded down."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int, short: bool = False):
        self.number: dict[str, int] = {}
        self.ids: list[tuple[int, ...]] = []  # items with the same words are searched once
        same: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number)) for x in words(text))
            if len(w) >= (1 if short else window):
                same[w].append(item)
        self.texts = list(same)
        self.ids = [tuple(x) for x in same.values()]
        self.shapes: list[tuple[int, int, int]] = []  # of each text: words of a window, budget, words of a piece
        self.at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)  # piece -> (text, first word of its window)
        for t, w in enumerate(self.texts):
            size = min(window, len(w))
            own = budget * size // window
            length = size // (own + 1)
            self.shapes.append((size, own, length))
            for s in range(len(w) - size + 1):
                for p in range(own + 1):
                    a = s + p * length
                    self.at[w[a : a + length]].append((t, s, p))
        self.codes: dict[int, np.ndarray] = {}  # by the length of pieces
        for length in {len(k) for k in self.at}:
            codes = np.array([x for k in self.at if len(k) == length for x in k], np.int64)
            self.codes[length] = np.unique(self.code(codes, length)[::length])
        self.search = lru_cache(100_000)(lambda t, s: myers(list(self.texts[t][s : s + self.shapes[t][0]])))

    @staticmethod
    def code(numbers: np.ndarray, length: int) -> np.ndarray:
        """A hash of the ``length`` words from each place on; the last places have none."""
        x = (numbers.astype(np.uint64) + np.uint64(1)) * _ODD
        x ^= x >> np.uint64(29)
        out = np.zeros(max(0, len(x) - length + 1), np.uint64)
        for k in range(length):
            out = out * np.uint64(0xD1342543DE82EF95) + x[k : k + len(out)]
        return out

    def scan(self, ids: list[int], texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """(document, item, distance) of all items of which a window is in a document within the budget."""
        number, unknown = self.number, len(self.number)
        flat: list[int] = []
        ends = []
        for text in texts:
            if text:
                flat.extend([number.get(w, unknown) for w in words(text)])
            flat.append(unknown)
            ends.append(len(flat))
        numbers = np.array(flat, np.int64)
        best: dict[tuple[int, int], int] = {}
        done: set[tuple[int, int, int, int]] = set()
        for length, known in self.codes.items():
            hits = np.flatnonzero(np.isin(self.code(numbers, length), known))
            docs = np.searchsorted(ends, hits, "right")
            for hit, doc in zip(hits.tolist(), docs.tolist(), strict=True):
                first = ends[doc - 1] if doc else 0
                for t, s, p in self.at.get(tuple(flat[hit : hit + length]), ()):
                    start = hit - p * length
                    if best.get((doc, t)) == 0 or (doc, t, s, start) in done:
                        continue
                    done.add((doc, t, s, start))
                    window, budget, _ = self.shapes[t]
                    lo, hi = max(first, start - budget), min(ends[doc] - 1, start + window + budget)
                    distance, _ = self.search(t, s)(flat[lo:hi])
                    if distance <= budget and distance < best.get((doc, t), budget + 1):
                        best[doc, t] = distance
        out = [(ids[doc], item, distance) for (doc, t), distance in best.items() for item in self.ids[t]]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block: int = BLOCK, short: bool = False) -> DataFrame:
    """doc_id, item_id and the smallest word edit distance, at most ``budget``, of a window of the item to a stretch of the
    document; each pair once, only where there is one.

    ``documents`` has doc_id and text, ``items`` item_id and item_text. Null and empty texts hold no window, nor do items of
    fewer words than ``window``, unless ``short``: then each is one window as a whole, with its share of the budget (of 2 in 13: none up to 6
    words, 1 above). Items with equal words come out side by side. Empty tables give an empty result. The corpus is read once per ``block`` characters
    of items, which are all that a task is sent.
    """
    blocks, size = [[]], 0
    for r in items.where(F.col("item_text").isNotNull()).select("item_id", "item_text").orderBy("item_id").toLocalIterator():
        if size > block:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item_id, r.item_text))
        size += len(r.item_text)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())

    def scan(own):
        def run(batches):
            ready = Items(own, window, budget, short)
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    part = batch.slice(k, 500)
                    found = ready.scan(part.column(0).to_pylist(), part.column(1).to_pylist())
                    if found[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, _OUT, strict=True)], schema=_OUT)

        return run

    out = None
    for own in blocks:
        one = rows.mapInArrow(scan(own), OUT)
        out = one if out is None else out.unionByName(one)
    return out
