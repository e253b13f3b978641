"""Runs of wanted bytes in a column of texts, found for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space: space, and tab to carriage return. A word is a run of any other bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that aren't the first of a UTF-8 character.
INNER = (np.arange(256) & 0xC0) == 0x80


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after another, and the n + 1 offsets of the rows; a null is an empty row."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def totals(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of `mark` are set in each row."""
    before = np.r_[0, np.cumsum(mark, dtype=np.int64)]
    return before[offsets[1:]] - before[offsets[:-1]]


def runs(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The longest runs of wanted bytes within rows: the row of each, and the runs as a binary array, in order. `wanted` has a flag for each byte."""
    inside = np.r_[False, wanted, False]
    first = inside[1:-1] & ~inside[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] |= wanted[edges]  # a run doesn't cross into the next row
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    kept = np.r_[0, np.cumsum(wanted, dtype=np.int64)]
    at = np.r_[kept[starts], kept[-1]]
    body = np.ascontiguousarray(data[wanted])
    return row, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal values, and the distinct values by number."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
