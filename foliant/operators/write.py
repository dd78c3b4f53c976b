"""Rows to files: object bytes, offsets by a running sum, cross-references, whole files; rewriting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions import files, filters
from foliant.functions.batches import sliced
from foliant.functions.objects import Malformed, from_json, to_json
from foliant.operators.decode import decoded_df, per_file


def encoded_df(parts: DataFrame) -> DataFrame:
    """parts (file_id, seq, obj_num, gen, prim_json, payload) with each object's bytes and its size."""
    schema = T.StructType([*parts.schema.fields, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = (batch.column(c).to_pylist() for c in ("obj_num", "gen", "prim_json", "payload"))
            out = [files.object_bytes(n, g, from_json(v), p) for n, g, v, p in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    return parts.mapInArrow(run, schema).withColumn("size", F.octet_length("bytes").cast("long"))


def offsets_df(encoded: DataFrame, base: int = len(files.HEADER)) -> DataFrame:
    """Each object's place: the sizes before it, from the end of the header on."""
    before = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return encoded.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)) + base)


def xref_df(offsets: DataFrame) -> DataFrame:
    """(file_id, obj_num, offset, gen, in_use): the last object of each number, gaps as free entries."""
    last = offsets.groupBy("file_id", "obj_num").agg(F.max_by(F.struct("offset", "gen"), "seq").alias("o"))
    span = last.groupBy("file_id").agg(F.max("obj_num").alias("top")).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("obj_num"))
    return span.join(last, ["file_id", "obj_num"], "left").select("file_id", "obj_num", F.coalesce("o.offset", F.lit(0)).alias("offset"), F.coalesce("o.gen", F.when(F.col("obj_num") == 0, 65535).otherwise(0)).alias("gen"), F.col("o").isNotNull().alias("in_use"))


def write_df(parts: DataFrame, trailers: DataFrame) -> DataFrame:
    """(file_id, content): a file of each file_id's parts in order of seq; trailers: (file_id, trailer_json).

    A file without parts isn't written. All parts of one file meet in one task, as a file is one value."""
    kind = parts.schema["file_id"].dataType.simpleString()
    rows = encoded_df(parts).join(trailers, "file_id").select("file_id", "seq", "obj_num", "gen", "bytes", "trailer_json")
    grouped = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("seq", "obj_num", "gen", "bytes"))).alias("objects"), F.first("trailer_json").alias("trailer_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for objects, trailer in zip(batch.column("objects").to_pylist(), batch.column("trailer_json").to_pylist(), strict=True):
                at, places = len(files.HEADER), {}
                for o in objects:
                    places[o["obj_num"]] = (at, o["gen"])
                    at += len(o["bytes"])
                out.append(files.HEADER + b"".join(o["bytes"] for o in objects) + files.xref_bytes(places, from_json(trailer), at))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(out, pa.binary())], ["file_id", "content"])

    return grouped.mapInArrow(run, f"file_id {kind}, content binary")


def parts_of(decoded: DataFrame) -> DataFrame:
    """Decoded objects as parts, unchanged."""
    return decoded.select("file_id", "seq", "obj_num", "gen", "prim_json", F.col("raw_stream").alias("payload"))


def map_contents(decoded: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """decoded with each content inflated, changed, and deflated anew. Images and encrypted streams, and
    streams whose filters fail, stay as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            headers, raws = batch.column("prim_json").to_pylist(), batch.column("raw_stream").to_pylist()
            for i, (h, raw) in enumerate(zip(headers, raws, strict=True)):
                if raw is not None:
                    v = from_json(h)
                    try:
                        if filters.rewritable(v):
                            v, raws[i] = filters.deflated(v, change(filters.decoded(v, raw)))
                            headers[i] = to_json(v)
                    except Malformed:
                        pass
            columns = {"prim_json": pa.array(headers, pa.string()), "raw_stream": pa.array(raws, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return decoded.mapInArrow(run, schema)


def transform_elements(decoded: DataFrame, change: Callable[[DataFrame], DataFrame], meta: DataFrame) -> DataFrame:
    """Files rebuilt from decoded objects that a DataFrame function has changed."""
    return write_df(parts_of(change(decoded)), meta.where("trailer_json is not null").select("file_id", "trailer_json"))


def rewrite_files(df: DataFrame, initial: object, collect: Callable[[object, tuple], tuple[list[tuple], object]], update: Callable[[object, tuple], tuple], **options) -> DataFrame:
    """(file_id, content, error): each file written anew from what `collect` makes of its objects, in order.

    collect takes the state and an object (number, generation, value, payload) and gives the objects that
    take its place and the next state; update takes the last state and the trailer, and gives the trailer
    to write. A file without a trailer, or of which no object is left, has an error in place of content."""

    def kernel(content: bytes) -> list[tuple]:
        d = files.decode(content, **options)
        state, out = initial, []
        for o in d.objects:
            made, state = collect(state, o)
            out += made
        if d.trailer is None:
            return [(None, "no trailer or root")]
        if not out:
            return [(None, "no objects to write")]
        return [(files.build(out, update(state, d.trailer)), None)]

    return per_file(df, kernel, "file_id {k}, content binary, error string")


def write_faults(parts: DataFrame, trailers: DataFrame) -> DataFrame:
    """(file_id, obj_num, error): why write_df doesn't write a file, or what is wrong in it: parts without a
    trailer, a trailer without parts, payloads that aren't as long as the column length says, if there is one."""
    own = parts.select("file_id").distinct()
    fault = lambda df, text: df.select("file_id", F.lit(None).cast("long").alias("obj_num"), F.lit(text).alias("error"))
    out = fault(own.join(trailers, "file_id", "left_anti"), "no trailer").unionByName(fault(trailers.join(own, "file_id", "left_anti"), "no objects to write"))
    if "length" in parts.columns:
        wrong = parts.where(F.octet_length("payload") != F.col("length"))
        text = F.concat(F.lit("payload of "), F.octet_length("payload"), F.lit(" bytes for a length of "), F.col("length"))
        out = out.unionByName(wrong.select("file_id", F.col("obj_num").cast("long").alias("obj_num"), text.alias("error")))
    return out


def xref_of_files(df: DataFrame, **options) -> DataFrame:
    """xref_df of the objects of files as they would be written one after the other."""
    return xref_df(offsets_df(encoded_df(parts_of(decoded_df(df, **options)))))
