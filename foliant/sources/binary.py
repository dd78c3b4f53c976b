"""Files of bytes as rows, in batch and as a stream, and rows as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rowcodec_columns
from foliant.functions.batches import sliced
from foliant.sources import ranges

MIME = "application/pdf"
MOST = 2**31 - 1


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", most: int = MOST) -> DataFrame:
    """(file_id, content): a row for each file. Files over `most` bytes are left out by the scan itself."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.where(F.col("length") <= most).select(F.col("path").alias("file_id"), "content")


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream; files_per_trigger holds back what one batch reads."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.select(F.col("path").alias("file_id"), "content")


def write_files(df: DataFrame, folder: str, name: str = "file_id", content: str = "content", suffix: str = ".pdf") -> int:
    """Each row's content to a file of its own in a folder all executors share, a path or the URI of a store that
    Arrow knows; the number of bytes written. Files appear when all are whole; a job that fails leaves none.
    Names must differ; a file of that name from before is replaced."""
    ranges.register(df.sparkSession)
    seen = Observation()
    rows = df.select(F.col(name).cast("string").alias("file_id"), F.lit(0).cast("long").alias("off"), F.coalesce(F.col(content), F.lit(b"")).alias("bytes"))
    rows.observe(seen, F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("n")).write.format("parts").mode("append").option("path", folder).option("suffix", suffix).save()
    return seen.get["n"]


def encode_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, bytes): each row's columns in the binary row form; flat rows column by column."""
    struct = df.select(*columns).schema
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = batch.select(columns)
            raw = rowcodec_columns.encode(own, struct)
            yield pa.RecordBatch.from_arrays([batch.column(key), raw], [key, "bytes"])

    return df.select(key, *[c for c in columns if c != key]).mapInArrow(run, f"{key} {kind}, bytes binary")


def decode_rows(df: DataFrame, schema, column: str = "bytes") -> DataFrame:
    """The rows of such bytes, by their schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in sliced(batches):
            yield rowcodec_columns.decode(batch.column(0), schema, target)

    return df.select(column).mapInArrow(run, schema)
