"""Texts in Arrow batches: bounded slices, words, word codes.

Every helper sees a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text (or of 4-byte list elements) that one step holds at a time. A single longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def byte_lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of 4-byte elements; 0 for null."""
    if pa.types.is_list(values.type):
        lengths = pc.multiply(pc.list_value_length(values), 4)
    else:
        lengths = pc.binary_length(values)
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)) + 16)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z in lower case, cut at ASCII white space, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = offsets_of(real)
    ends = seen[lists.offsets.to_numpy()]
    return flat.filter(pa.array(real)), np.diff(ends)


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words)."""
    if not len(words):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary
