"""Decoders and byte scans over rows (file_id, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.batches import sliced
from foliant.functions.decoders import Decoder, fixed_values
from foliant.operators.decode import per_file


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, where each ends); null values have none."""
    c = column.cast(pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    if c.null_count:
        parts = [x or b"" for x in c.to_pylist()]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def decoded_values(df: DataFrame, decoder: Decoder, kind: str) -> DataFrame:
    """(file_id, pos, value) of the values that a decoder reads from each content. Values of a fixed width are read
    for a whole batch at once."""
    value = T._parse_datatype_string(kind)
    schema = T.StructType([df.schema["file_id"], T.StructField("pos", T.IntegerType()), T.StructField("value", value)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        target = to_arrow_type(value)
        for batch in sliced(batches):
            if decoder.fixed:
                data, ends = _bytes_of(batch.column("content"))
                values, counts = fixed_values(data, ends, decoder.fixed)
                values = pa.array(values.astype(values.dtype.newbyteorder("="))).cast(target)
            else:
                found = [decoder.decode(c).values if c is not None else [] for c in batch.column("content").to_pylist()]
                counts = np.array([len(v) for v in found], np.int64)
                values = pa.array([v for f in found for v in f], target)
            owner = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(owner)), pa.array(pos.astype(np.int32)), values], ["file_id", "pos", "value"])

    return df.select("file_id", "content").mapInArrow(run, schema)


def decoded_status(df: DataFrame, decoder: Decoder) -> DataFrame:
    """(file_id, n, bits_left, error, waits): how a decoder fares with each content. waits: what it lacks."""

    def kernel(content: bytes) -> list[tuple]:
        o = decoder.decode(content)
        return [(len(o.values), 8 * len(content) - o.at, o.error, o.short)]

    return per_file(df, kernel, "file_id {k}, n long, bits_left long, error string, waits string")


class ByteScan:
    """Arithmetic on every byte, put together step by step and run at once over all bytes of a batch. Values are
    64-bit numbers from the first step on."""

    def __init__(self, steps: tuple[Callable[[np.ndarray], np.ndarray], ...] = ()):
        self.steps = steps

    def map(self, f: Callable[[np.ndarray], np.ndarray]) -> ByteScan:
        return ByteScan((*self.steps, f))

    def __rshift__(self, other: ByteScan) -> ByteScan:
        return ByteScan((*self.steps, *other.steps))

    def apply(self, data: np.ndarray) -> np.ndarray:
        out = data.astype(np.int64)
        for f in self.steps:
            out = f(out)
        return out

    def _per_row(self, df: DataFrame, schema: str, totals: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                data, ends = _bytes_of(batch.column("content"))
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), *map(pa.array, totals(self.apply(data), ends))], [c.split()[0] for c in schema.split(", ")])

        return df.select("file_id", "content").mapInArrow(run, schema.format(k=df.schema["file_id"].dataType.simpleString()))

    def sums(self, df: DataFrame) -> DataFrame:
        """(file_id, n, total): the number of a content's bytes and the sum of what the steps make of them."""

        def totals(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
            sums = np.concatenate([[0], np.cumsum(values)])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
            return [np.asarray(ends - starts, np.int64), sums[ends.astype(np.int64)] - sums[starts]]

        return self._per_row(df, "file_id {k}, n long, total long", totals)
