"""Reading Arrow batches in Python workers without making a Python object per row."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def numpy_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def gathered(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """A whole partition; its size is bounded by the caller's partitioning."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    a = batch.column(name)
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_string()) if a.type != pa.large_string() else a
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def parts(rows: int, each: int, least: int) -> int:
    """Partitions so that none has more than about ``each`` rows."""
    return max(least, -(-rows // each))
