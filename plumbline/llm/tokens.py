"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut wherever two neighbouring bytes occur side by side in no token of the vocabulary: no token can span such a
place, so it is a token boundary whatever surrounds it. The fragments are encoded one by one, each distinct one once per
task as long as it is remembered, and their ids are concatenated.

The vocabulary is applied after a pattern has split the text into words, and that pattern looks around. So a cut is only
made where the pattern's matches are the same with and without it: between two characters, not after white space (whose
last character belongs to what follows) and not before an apostrophe (which may start a contraction).
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import texts

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments remembered by a task; then it starts anew.
REMEMBERED = 300_000
#: Fragments handled at once.
BLOCK = 1_000_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes fragments; built once per task."""

    def __init__(self, path: str, pattern: str = PATTERN, remembered: int = REMEMBERED):
        import tiktoken

        vocabulary = ranks(path)
        self.inside = np.zeros((256, 256), bool)  # whether two bytes are neighbours in some token
        for token in vocabulary:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
        self.known: dict[bytes, list[int]] = {}
        self.remembered = remembered
        bytes_ = np.arange(256)
        #: Last bytes of characters that may be white space: ASCII, and the last bytes of U+0085, U+00A0, U+1680, U+2000 to
        #: U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
        space = np.isin(bytes_, [*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F])
        starts = (bytes_ & 0xC0) != 0x80
        self.cut = ~self.inside & ~space[:, None] & (starts & (bytes_ != 0x27))[None, :]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The places in ``data`` at which fragments start, the starts of the rows among them."""
        at = np.zeros(len(data), bool)
        at[1:] = self.cut[data[:-1], data[1:]]
        at[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(at)

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments in order, and how many each has."""
        raw, known = data.tobytes(), self.known
        bounds = [*starts.tolist(), len(raw)]
        ids, sizes = [], []
        for k in range(0, len(starts), BLOCK):
            if len(known) > self.remembered:
                known.clear()
            some = bounds[k : k + BLOCK + 1]
            pieces = [raw[a:b] for a, b in zip(some[:-1], some[1:], strict=True)]
            for x in set(pieces).difference(known):
                known[x] = self.encode(x.decode())
            of = [known[x] for x in pieces]
            sizes.append(np.fromiter(map(len, of), np.int64, len(of)))
            ids.append(np.fromiter((i for x in of for i in x), np.int32, int(sizes[-1].sum())))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        """The list of ids of each row."""
        starts = self.cuts(data, offsets)
        ids, sizes = self.fragments(data, starts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(starts, offsets)].astype(np.int32)), pa.array(ids))


def encoded(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text``; an empty list for a null or empty text. The names of special tokens are
    ordinary text. Other columns are dropped; an empty table gives an empty result; a text of any length is encoded whole.
    """
    path = path or os.path.join(os.environ.get("PLUMBLINE_TOKENIZERS", FOLDER), VOCABULARY)
    rows = documents.select(documents[key], documents[text])
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.rows(*texts(part, part.schema.names[1]))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
