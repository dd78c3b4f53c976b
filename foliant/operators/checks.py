"""Structural validation and comparison of files: where files are given, each is one task's data and nothing is
shuffled; decoded objects are joined by file and number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import files, structure
from foliant.functions.batches import sliced
from foliant.operators import tree
from foliant.operators.decode import per_file, rows_batch
from foliant.plans.prefix import cut

FAULTS = "file_id {k}, kind string, owner long, target long"
TREE = "file_id {k}, node long, parent long, level int, kind string"
CHANGES = "file_id {k}, kind string, obj_num long, detail string"


def validate_files(df: DataFrame, single_references: bool = False, **options) -> DataFrame:
    """(file_id, kind, owner, target): every fault of every file; a valid file has no row."""

    def kernel(content: bytes) -> list[tuple]:
        d = files.decode(content, **options)
        return structure.faults(d.objects, len(d.xrefs), d.root, single_references)

    return per_file(df, kernel, FAULTS)


def page_tree_files(df: DataFrame, depth: int = 16, **options) -> DataFrame:
    """(file_id, node, parent, level, kind) of the nodes of each file's page tree."""

    def kernel(content: bytes) -> list[tuple]:
        d = files.decode(content, **options)
        return list(structure.page_tree(structure.by_number(d.objects), d.root, depth))

    return per_file(df, kernel, TREE)


def compare_files(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """(file_id, kind, obj_num, detail): Assembly and Validation faults of the versions under one file_id,
    ObjectMissing, ObjectAdded and DeletedStream. A version that isn't there is a file without objects."""
    pairs = old.select("file_id", F.col("content").alias("before")).join(new.select("file_id", F.col("content").alias("after")), "file_id", "full_outer")
    kind = pairs.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, rows = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                made = structure.compared(files.decode(a or b"", **options), files.decode(b or b"", **options))
                at += [i] * len(made)
                rows += made
            yield rows_batch(batch.column(0), at, rows, CHANGES)

    return pairs.mapInArrow(run, CHANGES.format(k=kind))


def page_tree(decoded: DataFrame, meta: DataFrame, depth: int = 16) -> DataFrame:
    """(file_id, node, parent, level, kind) of objects decoded before; depth may be as large as trees are deep."""
    objects = cut(tree.last_objects(decoded))
    return tree.page_tree(objects, cut(tree.roots(objects, meta).select("file_id", F.col("top").alias("node"))), depth)


def validate_df(decoded: DataFrame, meta: DataFrame, single_references: bool = False) -> DataFrame:
    """The faults of objects decoded before; meta as it was read from the files."""
    return tree.faults(decoded, meta, single_references)


def by_number(decoded: DataFrame) -> DataFrame:
    """The last object of each number."""
    last = F.max_by(F.struct("kind", "prim_json"), "seq")
    return decoded.groupBy("file_id", "obj_num").agg(last.alias("o")).select("file_id", "obj_num", (F.col("o.kind") == "content").alias("has_stream"), "o.prim_json")


def compare_df(old: DataFrame, new: DataFrame, on: str = "file_id") -> DataFrame:
    """(file_id, kind, obj_num): objects that the new version lacks, adds, or robbed of their stream."""
    a = by_number(old).select(on, "obj_num", F.col("has_stream").alias("had"), F.lit(True).alias("in_old"))
    b = by_number(new).select(on, "obj_num", F.col("has_stream").alias("has"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_new").isNull(), "ObjectMissing").when(F.col("in_old").isNull(), "ObjectAdded").when(F.col("had") & ~F.col("has"), "DeletedStream")
    return a.join(b, [on, "obj_num"], "full_outer").select(on, kind.alias("kind"), "obj_num").where("kind is not null")
