"""What several corpus operators need: lineage cuts, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

PORTION = 4 << 20  # bytes of texts that a kernel works on at once


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one spark.checkpoint.dir names.

    Where the session names none, one of this machine is taken if Spark runs within this process, as in
    tests; on a cluster that would go wrong, so it is an error there."""
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
    """df computed once and stored in the shared folder; a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Intermediate results as tables in the shared folder, compressed and by column; they are deleted at
    the end of the with block, so nothing that is computed later may read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        shrink(self.spark)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files of steps that were cut off leave the
    executors' disks now and not whenever its heap happens to fill. The threads that tell Spark's listeners
    hold the step that ended last, with its shuffles, until the next one ends; so an empty one is run."""
    spark.sql("SELECT 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Has the executors collect their garbage. Their heaps grow to the limit over the steps of an operator and
    would stay so large beside the Python workers of what comes next; a full collection gives back what is free."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that each executor gets some
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes, and 64 rows at least."""
    rows = max(64, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, most: int = 1 << 62) -> DataFrame:
    """df through a kernel that turns one Arrow batch, or slices of it of about `most` bytes, into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, most):
                if (out := kernel(part)) is not None:
                    yield out
        batch = part = out = None
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that is free in this worker back to the machine, on which other workers need it."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


_holder: list = ["", None]


def hold(name: str, clear: Callable[[], None]) -> None:
    """Says that a kernel is about to fill its cache in this worker, and empties that of another one:
    workers live on from stage to stage, and what they remember for one is no use to the next."""
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
            gc.collect()
            trim()
        _holder[:] = [name, clear]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def pieces_for(rows: int, per_piece: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_piece))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends of links and the smallest that each reaches: parts hook onto the smallest neighbouring one
    and links are taken between what is left of them, till none is left."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    part, a, b = np.arange(len(ids)), ends[: len(u)], ends[len(u) :]
    while len(a):
        low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
        a, b = low[low < high], high[low < high]
        np.minimum.at(part, b, a)
        while (part[part] != part).any():
            part = part[part]
    return ids, ids[part]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64, few: int = 1 << 20) -> DataFrame:
    """(id, component): the smallest id that each endpoint of edges reaches.

    Up to `few` different edges between whole numbers are joined in one task, which saves many shuffles. More
    go through alternating large-star and small-star contraction: every node hooks its larger neighbours, then
    its smaller ones, onto the smallest id it sees. The minimum at a hub is aggregated before it is
    shuffled and joined back with an ordinary join, which adaptive execution may split, so a hub with
    very many neighbours isn't gathered in one task. Ids must be of one orderable type; null
    endpoints and loops link nothing. An empty input gives an empty result."""
    spark = edges.sparkSession
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    kind = e.schema["u"].dataType
    if isinstance(kind, IntegralType) and e.count() <= few:

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [x for x in batches if x.num_rows]:
                ids, least = least_reached(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])

        return e.coalesce(1).mapInArrow(joined, f"id {kind.simpleString()}, component {kind.simpleString()}")
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("m")), nodes["id"] == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))
