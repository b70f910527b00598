"""Helpers inside tasks: Arrow batches in small slices, so that memory follows texts, not batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Characters taken from an Arrow batch at a time.
SLICE_CHARS = 1 << 21


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``chars`` bytes of text (one row at least)."""
    column = batch.column(text)
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > chars:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """Texts of a slice, a null as an empty text."""
    return [t or "" for t in batch.column(text).to_pylist()]
