"""Arrow string batches as numpy code-point arrays and back, without per-row calls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows of a string array, one after another, and the row
    offsets (rows + 1). Null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, heads[offs - offs[0]].astype(np.int64)


def to_strings(points: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``to_points``; rows where ``valid`` is false become null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[offs]
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data), mask)
