"""Vectorised text helpers for Arrow tasks: bounded slices, words, lines.

ASCII white space (space, \\t \\n \\v \\f \\r) separates words, as in ``common.WORD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def plain_strings(column: pa.Array) -> pa.Array:
    """String array without nulls (null -> empty) and without large offsets."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``max_bytes`` of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, words per text)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(real), counts


def codes(values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(dense codes in order of first appearance, the distinct values)."""
    encoded = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lines per text) of the \\n-split lines of all texts."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    last = np.cumsum(per_text) - 1
    n = int(per_text.sum())
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[last - per_text + 1] = True
    is_last[last] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    return starts, ends, per_text


def counted(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of set flags in each [start, end)."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[ends] - run[starts]
