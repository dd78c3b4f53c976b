"""Running sums over ordered streams of any length.

Rows are dealt out by ranges of (stream, order), so that one long stream is spread over all tasks and many short
ones share a task. Each partition sums on its own in one pass and ends with a marker row: its last stream, what
that stream came to within the partition, and whether it holds no other. From the markers, one a partition, follows
what each partition's first stream had before it; that is added to the rows of that first stream alone. Rows are
shuffled once; nothing is gathered by stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART, _FIRST, _END, _WHOLE = "__part", "__first", "__end", "__whole"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one spark.checkpoint.dir names. Where the session names none, one of
    this machine is taken if Spark runs within this process, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="foliant-checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A path in the folder that all executors share; what is there is deleted in the end."""
    sc, path = spark.sparkContext, f"{shared_folder(spark)}/held-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        held = sc._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(sc._jsc.hadoopConfiguration()).delete(held, True)


def starts_of_runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal neighbours begin; nulls equal nulls."""
    if not len(column):
        return np.zeros(0, np.int64)
    ends = np.asarray(pc.run_end_encode(column, run_end_type=pa.int64()).run_ends)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def before_in_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each value the sum of those before it in its run."""
    before = np.cumsum(values) - values
    return before - np.repeat(before[starts], np.diff(np.append(starts, len(values))))


def running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, under each name of sums, what its column (whole numbers, null counting as 0) comes to over the rows
    of the same `by` that stand before. order tells their order; rows equal in it are taken in any order.

    A null in `by` is a stream of its own. parts: the number of partitions, spark.sql.shuffle.partitions unless
    given. The result is stored once, so that both passes see one partitioning. Names beginning with two
    underscores and __part, __first, __end, __whole are this function's own."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kept = list(sums), rows.columns
    summed = rows.select("*", *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in sums.items()])
    placed = summed.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in placed.schema.fields] + [T.StructField(_PART, T.IntegerType())] + [T.StructField(x, T.BooleanType()) for x in (_FIRST, _END, _WHOLE)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, key, carry = TaskContext.get().partitionId(), True, None, np.zeros(len(names), np.int64)
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(by)
            starts = starts_of_runs(column)
            goes_on = last is not None and column[0].as_py() == key
            first = first and (last is None or goes_on)
            upto = int(starts[1]) if len(starts) > 1 else batch.num_rows
            arrays = {n: batch.column(n) for n in batch.schema.names}
            after = np.zeros(len(names), np.int64)
            for k, n in enumerate(names):
                values = batch.column(n).to_numpy(zero_copy_only=False)
                before = before_in_runs(values, starts)
                if goes_on:
                    before[:upto] += carry[k]
                arrays[n], after[k] = pa.array(before), before[-1] + values[-1]
            of_first = np.zeros(batch.num_rows, bool)
            if first:
                of_first[:upto] = True
                first = len(starts) == 1
            no = pa.array(np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([*arrays.values(), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(of_first), no, no], schema.names)
            key, carry, last = column[batch.num_rows - 1].as_py(), after, batch.slice(batch.num_rows - 1)
        if last is not None:
            arrays = [pa.array([int(carry[names.index(n)])], pa.int64()) if n in names else last.column(n) for n in last.schema.names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), pa.array([first]), pa.array([True]), pa.array([first])], schema.names)

    made = cut(placed.mapInArrow(local, schema))
    # one marker a partition, and the first stream of each
    ends = {r[_PART]: r for r in made.where(_END).select(_PART, _WHOLE, F.col(by).alias("k"), *[F.col(n).alias(f"s{i}") for i, n in enumerate(names)]).collect()}
    heads = {r[_PART]: r["k"] for r in made.where(f"{_FIRST} and not {_END}").groupBy(_PART).agg(F.first(by).alias("k")).collect()}
    offsets, before = [], None  # before: (stream, sums) of the last stream of all earlier partitions
    for part in sorted(ends):
        end = ends[part]
        had = before[1] if before is not None and before[0] == heads[part] else [0] * len(names)
        offsets.append((part, *had))
        came = [end[f"s{i}"] for i in range(len(names))]
        before = (end["k"], [a + b for a, b in zip(had, came, strict=True)] if end[_WHOLE] else came)
    table = spark.createDataFrame(offsets, f"{_PART} int, " + ", ".join(f"__add{i} long" for i in range(len(names))))
    joined = made.where(f"not {_END}").join(F.broadcast(table), _PART)  # a row for each partition at most
    return joined.select(*kept, *[F.when(F.col(_FIRST), F.col(n) + F.col(f"__add{i}")).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)])
