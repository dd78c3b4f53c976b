"""Sinks that say how much they took.

A batch of a stream is written under its number, with what `counts` came to over it, measured while it was written. A
batch that runs again after a restart replaces what it had written, so every row and count stands once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.plans.prefix import shared_folder


def counted_sink(rows: DataFrame, path: str, counts: dict[str, Column], then: Callable[[DataFrame, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Writes rows to path/rows and, a row for each batch, counts (aggregates over all rows) to path/counts. then: called
    with each batch as written and its number; must bear being called again with the same. trigger: availableNow
    unless given. Started again with the same path, it goes on where it was."""

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        batch.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        spark = batch.sparkSession
        kinds = batch.agg(*[c.alias(k) for k, c in counts.items()]).schema
        spark.createDataFrame([tuple(seen.get[k] for k in counts)], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        if then is not None:
            then(spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}"), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**trigger or {"availableNow": True}).start()


def taken(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """The rows of all batches, with the number of their batch."""
    return spark.read.schema(schema).parquet(f"{path}/rows").select("*", F.col("batch").cast("long").alias("__batch")).drop("batch").withColumnRenamed("__batch", "batch")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The counts of each batch."""
    return spark.read.parquet(f"{path}/counts")


def drained(rows: DataFrame, path: str | None = None) -> DataFrame:
    """All that a stream gives by the time it has caught up with its source, as a table in the shared folder."""
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def replayed(rows: DataFrame, files: int, per_batch: int = 1, path: str | None = None) -> DataFrame:
    """A table as a stream: its rows are stored in `files` files by a hash of all columns, so that they come in another
    order than they had, `per_batch` files at a time."""
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)
