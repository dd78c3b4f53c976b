"""Content-defined chunks of streams that are longer than a task.

A stream is laid out in blocks that overlap by a chunk's greatest length. Where chunks begin in a block depends on one
number alone, the place where the first begins; so each block is a function from that place to the place where the
next block's first chunk begins. These functions are composed, FAN blocks at a time, up to one a stream; going down
again, every block learns where its first chunk begins, and is cut on its own. No cell holds more than a block, or
FAN functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.fastcdc import Cutter
from foliant.plans.prefix import cut

BLOCK = 4 << 20  # bytes, at least the greatest length of a chunk
FAN = 32


def blocks(rows: DataFrame, size: int, more: int) -> DataFrame:
    """(stream_id, block, value): bytes size * block up to size * (block + 1) + more. rows: (stream_id, at, value), at:
    how many bytes of the stream stand before value."""
    end = F.col("at") + F.octet_length("value")
    first = F.greatest(F.floor((F.col("at") - more) / size), F.lit(0))
    spread = rows.where(F.octet_length("value") > 0).select("stream_id", "at", "value", F.explode(F.sequence(first, F.floor((end - 1) / size))).alias("block"))
    low, high = F.col("block") * size, (F.col("block") + 1) * size + more
    begin = F.greatest(low - F.col("at"), F.lit(0))
    length = F.least(high, end) - F.col("at") - begin
    pieces = spread.select("stream_id", "block", F.struct("at", F.substring(F.col("value"), begin.cast("int") + 1, length.cast("int")).alias("piece")).alias("x"), length.alias("n")).where("n > 0")
    parts = pieces.groupBy("stream_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # of one block
    whole = F.when(F.size("xs") == 1, F.col("xs")[0]["piece"]).otherwise(F.unhex(F.array_join(F.transform("xs", lambda x: F.hex(x["piece"])), "")))
    return parts.select("stream_id", "block", whole.alias("value")).where(F.octet_length("value") > 0)


def _functions(laid: DataFrame, size: int, sizes: tuple[int, int, int]) -> DataFrame:
    """(stream_id, block, leads): where each place leads, as packed 32-bit numbers."""
    schema = T.StructType([laid.schema["stream_id"], *T._parse_datatype_string("block long, leads binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Cutter(v.as_py(), *sizes).leads(size).astype("<u4").tobytes() for v in batch.column("value")]
            yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("block"), pa.array(made, pa.binary())], schema.names)

    return laid.mapInArrow(run, schema)


def _in_order(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    return sorted(zip(table.column("block").to_pylist(), (np.frombuffer(x, "<u4") for x in table.column("leads").to_pylist()), strict=True), key=lambda x: x[0])


def _composed(level: DataFrame) -> DataFrame:
    """One function for FAN neighbours."""
    schema = T.StructType(list(level.schema.fields))
    names = schema.names

    def one(table: pa.Table) -> pa.Table:
        held = _in_order(table)
        f = held[0][1]
        for _, g in held[1:]:
            f = g[f]
        return pa.table([table.column("stream_id").slice(0, 1), pa.array([held[0][0] // FAN], pa.int64()), pa.array([f.astype("<u4").tobytes()], pa.binary())], names=names)

    return level.withColumn("up", F.floor(F.col("block") / FAN)).groupBy("stream_id", "up").applyInArrow(one, schema)


def _entered(level: DataFrame, above: DataFrame) -> DataFrame:
    """(stream_id, block, enters): where the first chunk of each block begins. above: the same of FAN neighbours."""
    schema = T.StructType([level.schema["stream_id"], *T._parse_datatype_string("block long, enters long").fields])
    names = schema.names

    def one(table: pa.Table) -> pa.Table:
        place, enters, numbers = table.column("enters")[0].as_py(), [], []
        for number, f in _in_order(table):
            numbers.append(number)
            enters.append(place)
            place = int(f[place])
        ids = table.column("stream_id").take(pa.array([0] * len(numbers)))
        return pa.table([ids, pa.array(numbers, pa.int64()), pa.array(enters, pa.int64())], names=names)

    up = above.select(F.col("stream_id").alias("__id"), F.col("block").alias("__up"), "enters")
    joined = level.join(up, F.col("stream_id").eqNullSafe(F.col("__id")) & (F.floor(F.col("block") / FAN) == F.col("__up")))
    return joined.select("stream_id", "block", "leads", "enters", "__up").groupBy("stream_id", "__up").applyInArrow(one, schema)


def cut_streams(rows: DataFrame, least: int, average: int, most: int, block: int | None = None) -> DataFrame:
    """(stream_id, off, value): the chunks of each stream. rows: (stream_id, at, value) as blocks() takes them. The blocks
    and their functions, a function being four bytes for each place in a chunk's greatest length, are stored."""
    size = max(block or BLOCK, most)
    sizes = (least, average, most)
    laid = cut(blocks(rows, size, most))
    levels = [cut(_functions(laid, size, sizes))]
    while (levels[-1].agg(F.max("block")).head()[0] or 0) > 0:
        levels.append(cut(_composed(levels[-1])))
    entered = levels[-1].select("stream_id", "block", F.lit(0).cast("long").alias("enters"))
    for level in levels[-2::-1]:
        entered = _entered(level, entered)
    schema = T.StructType([laid.schema["stream_id"], *T._parse_datatype_string("off long, value binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (data, number, enters) in enumerate(zip(batch.column("value"), batch.column("block").to_pylist(), batch.column("enters").to_pylist(), strict=True)):
                data = data.as_py()
                starts = Cutter(data, *sizes).chain(enters, size) if enters < len(data) else []
                if len(starts) > 1:
                    ids = batch.column("stream_id").take(pa.array([k] * (len(starts) - 1)))
                    parts = [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([number * size + a for a in starts[:-1]], pa.int64()), pa.array(parts, pa.binary())], schema.names)

    own = entered.withColumnsRenamed({"stream_id": "__id", "block": "__block"})
    both = laid.join(own, F.col("stream_id").eqNullSafe(F.col("__id")) & (F.col("block") == F.col("__block")))
    return both.select("stream_id", "block", "value", "enters").mapInArrow(run, schema)
