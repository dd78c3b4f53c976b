"""Arrow batches in slices, so that what a kernel holds follows a slice and not whatever a batch came to."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa

PORTION = 1 << 20  # bytes of a slice, unless one row has more


def portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """batch, halved until a slice has `most` bytes or is one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from portions(batch.slice(0, half), most)
        yield from portions(batch.slice(half), most)


def sliced(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in slices; in the end the worker, which lives on for other tasks, gives back what is free."""
    for batch in batches:
        yield from portions(batch, most or PORTION)
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
