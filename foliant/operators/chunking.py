"""Content-defined chunks of binary payloads and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import fastcdc
from foliant.operators.decode import per_file


def chunks_df(df: DataFrame, least: int = 4096, average: int = 16384, most: int = 65536, with_bytes: bool = False) -> DataFrame:
    """(file_id, chunk_no, off, len, sha256) of each file's chunks; digests are made by Spark."""

    def kernel(content: bytes) -> list[tuple]:
        ends = fastcdc.cuts(content, least, average, most)
        return [(k, a, b - a, content[a:b]) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))] if ends else []

    rows = per_file(df, kernel, "file_id {k}, chunk_no int, off long, len int, bytes binary")
    return rows.select("file_id", "chunk_no", "off", "len", F.sha2("bytes", 256).alias("sha256"), *(["bytes"] if with_bytes else []))


def store_df(chunks: DataFrame) -> DataFrame:
    """(sha256, len, copies): each different chunk once."""
    return chunks.groupBy("sha256").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("copies"))
