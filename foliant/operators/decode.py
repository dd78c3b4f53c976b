"""Files to rows: events, decoded objects, classified elements, page text, cross-references, trailers.

A file is a row (file_id, content). Reading bytes takes place in one Arrow kernel per batch, so nothing
is shuffled before a join or an aggregation needs it; payloads are inflated only where asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import contents, files, filters, structure
from foliant.functions.batches import sliced
from foliant.functions.objects import Malformed, from_json, number_of, to_json
from foliant.functions.objects import get as value_at

EVENTS = "file_id {k}, seq int, kind string, obj_num long, gen int, prim_json string, payload binary, at long, detail string"
DECODED = "file_id {k}, seq int, kind string, obj_num long, gen int, prim_json string, raw_stream binary"
META = "file_id {k}, version string, trailer_json string, size long, root_num long, objects long, xrefs int, unparsed_bytes long, error string"
XREFS = "file_id {k}, xref_no int, table_no int, entry_no int, obj_num long, kind string, offset_raw string, generation_raw string, offset long, in_use boolean, container long, idx int"


ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def rows_batch(ids: pa.Array, at: list[int], rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows after the ids they belong to. schema: of ids and rows, with plain types."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, ARROW[t]) for c, t in zip(columns, types[1:], strict=True))], list(names))


def per_file(df: DataFrame, kernel: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that a kernel makes of each file's bytes, with its file_id before them. Null content gives none."""
    kind = df.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, data = batch.column(0), batch.column(1)
            at, rows = [], []
            for i in range(batch.num_rows):
                content = data[i].as_py()
                if content is not None:
                    made = kernel(content)
                    at += [i] * len(made)
                    rows += made
            yield rows_batch(ids, at, rows, schema)

    return df.select("file_id", "content").mapInArrow(run, schema.format(k=kind))


def per_file_struct(df: DataFrame, kernel: Callable[[object], dict], schema: str) -> DataFrame:
    """One row with nested columns that a kernel makes of each file. Null content gives none."""
    kind = T.StructType([T.StructField("file_id", df.schema["file_id"].dataType), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for batch in sliced(batches):
            ids, content = batch.column(0), batch.column(1).to_pylist()
            at, rows = [], []
            for i, c in enumerate(content):
                if c is not None:
                    at.append(i)
                    rows.append(kernel(c))
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(target)[1:]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], target.names)

    return df.select("file_id", "content").mapInArrow(run, kind)


def events_df(df: DataFrame, inline_max_bytes: int = 256 << 10, resolve_indirect_length: bool = False) -> DataFrame:
    """Parse events of each file, repeated objects left out. Payloads over inline_max_bytes come as rows
    of kind stream_start, stream_bytes (in order of seq) and stream_end."""

    def kernel(content: bytes) -> list[tuple]:
        out: list[tuple] = []

        def add(kind: str, e: files.Event, value: str | None, payload: bytes | None) -> None:
            out.append((len(out), kind, e.number, e.generation, value, payload, e.at, e.text))

        for e in files.without_repeats(files.events(content, inline_max_bytes, resolve_indirect_length)):
            value = None if e.value is None else to_json(e.value)
            if e.kind == "stream" and len(e.payload) > inline_max_bytes:
                add("stream_start", e, value, None)
                for i in range(0, len(e.payload), inline_max_bytes):
                    add("stream_bytes", e, None, e.payload[i : i + inline_max_bytes])
                add("stream_end", e, None, None)
            else:
                add(e.kind, e, value, e.payload)
        return out

    return per_file(df, kernel, EVENTS)


def without_linearization(decoded: DataFrame) -> DataFrame:
    """decoded without the dictionaries that say how a file is linearised, as a reader of the top level has it."""
    return decoded.where(~((F.col("kind") == "data") & F.coalesce(F.array_contains(F.json_object_keys("prim_json"), "Linearized"), F.lit(False))))


def decoded_df(df: DataFrame, **options) -> DataFrame:
    """Objects of each file, those inside object streams too. kind: data, or content if it has a stream."""

    def kernel(content: bytes) -> list[tuple]:
        d = files.decode(content, **options)
        return [(i, "data" if p is None else "content", n, g, to_json(v), p) for i, (n, g, v, p) in enumerate(d.objects)]

    return per_file(df, kernel, DECODED)


def meta_df(df: DataFrame, **options) -> DataFrame:
    """One row a file: version, merged trailer, counts, what was left unparsed, the first error."""

    def kernel(content: bytes) -> list[tuple]:
        d = files.decode(content, **options)
        return [(d.version, None if d.trailer is None else to_json(d.trailer), d.size, d.root, len(d.objects), len(d.xrefs), d.unparsed, d.error)]

    return per_file(df, kernel, META)


def xref_entries_df(df: DataFrame, last_first: bool = False, **options) -> DataFrame:
    """Every entry of each file's cross-references. xref_no counts sections from the file's beginning, or with last_first
    from its end, the order that a reader of the top level gives."""

    def kernel(content: bytes) -> list[tuple]:
        sections = files.decode(content, **options).xrefs
        return [(x, t, k, first + k, "compressed" if o is None else "regular", o, g, int(o) if o and o.isdigit() else None, used, c, i) for x, (tables, _, _) in enumerate(sections[::-1] if last_first else sections) for t, (first, entries) in enumerate(tables) for k, (o, g, used, c, i) in enumerate(entries)]

    return per_file(df, kernel, XREFS)


OPENED = "version string, trailer_json string, size long, root_num long, objects long, unparsed_bytes long, error string, length long, sha256 string, pages array<struct<page_obj:long,seq:int,text:string>>, xrefs array<struct<obj_num:long,kind:string,offset:long,in_use:boolean,container:long>>"


def opened_df(df: DataFrame, texts: bool = True, **options) -> DataFrame:
    """One row a file, read once: trailer and counts, length and digest, the text of each page, and the
    cross-reference entries."""

    def kernel(content: bytes) -> dict:
        d = files.decode(content, **options)
        pages = [{"page_obj": n, "seq": k, "text": t} for n, k, t in structure.page_texts(d.objects)] if texts else []
        entries = [{"obj_num": first + k, "kind": "compressed" if o is None else "regular", "offset": int(o) if o and o.isdigit() else None, "in_use": used, "container": c} for tables, _, _ in d.xrefs for first, es in tables for k, (o, _, used, c, _) in enumerate(es)]
        return {"version": d.version, "trailer_json": None if d.trailer is None else to_json(d.trailer), "size": d.size, "root_num": d.root, "objects": len(d.objects), "unparsed_bytes": d.unparsed, "error": d.error, "length": len(content), "sha256": hashlib.sha256(content).hexdigest(), "pages": pages, "xrefs": entries}

    return per_file_struct(df, kernel, OPENED)


def page_text_files(df: DataFrame, **options) -> DataFrame:
    """page_text_df from the files themselves: a page's contents are read where the file is."""

    def kernel(content: bytes) -> list[tuple]:
        return structure.page_texts(files.decode(content, **options).objects)

    return per_file(df, kernel, "file_id {k}, page_obj long, seq int, text string")


def decoded_with_digest(df: DataFrame, **options) -> DataFrame:
    """decoded_df with the length and digest of the whole file on each object, from one reading."""

    def kernel(content: bytes) -> list[tuple]:
        d, length, digest = files.decode(content, **options), len(content), hashlib.sha256(content).hexdigest()
        return [(i, "data" if p is None else "content", n, g, to_json(v), p, length, digest) for i, (n, g, v, p) in enumerate(d.objects)]

    return per_file(df, kernel, DECODED + ", length long, sha256 string")


def top_level_df(df: DataFrame, resolve_indirect_length: bool = False) -> DataFrame:
    """decoded_df of the top level alone, repeated objects included and object streams left packed."""

    def kernel(content: bytes) -> list[tuple]:
        found = [e for e in files.events(content, resolve_length=resolve_indirect_length) if e.kind in ("object", "stream")]
        return [(i, "data" if e.kind == "object" else "content", e.number, e.generation, to_json(e.value), e.payload) for i, e in enumerate(found)]

    return per_file(df, kernel, DECODED)


# ---- looking objects up --------------------------------------------------------------------------


def _payload(value: tuple, raw: bytes | None) -> bytes | None:
    try:
        return None if raw is None else filters.decoded(value, raw)
    except Malformed:
        return None


def object_numbers(df: DataFrame, numbers: list[int], raw: bool = False, **options) -> DataFrame:
    """(file_id, obj_num, gen, prim_json, payload) of the objects of these numbers, in order; payloads decoded,
    or with raw as they stand in top-level objects."""
    wanted = set(numbers)

    def kernel(content: bytes) -> list[tuple]:
        if raw:
            return [(e.number, e.generation, to_json(e.value), e.payload) for e in files.without_repeats(files.events(content)) if e.kind in ("object", "stream") and e.number in wanted]
        return [(n, g, to_json(v), _payload(v, p)) for n, g, v, p in files.decode(content, **options).objects if n in wanted]

    return per_file(df, kernel, "file_id {k}, obj_num long, gen int, prim_json string, payload binary")


def stream_texts(df: DataFrame, numbers: list[int], **options) -> DataFrame:
    """(file_id, obj_num, text): decoded payloads of these objects as UTF-8; null where they aren't."""
    rows = object_numbers(df, numbers, **options).where("payload is not null")
    return rows.select("file_id", "obj_num", F.when(F.is_valid_utf8(F.col("payload").cast("string")), F.col("payload").cast("string")).alias("text"))


def page_number(df: DataFrame, page: int, **options) -> DataFrame:
    """(file_id, obj_num) of the page at this place, from 0, of the first Pages node with kids; files without it
    have no row."""

    def kernel(content: bytes) -> list[tuple]:
        kids = structure.pages_of(structure.by_number(files.decode(content, **options).objects))
        return [(kids[page],)] if 0 <= page < len(kids) else []

    return per_file(df, kernel, "file_id {k}, obj_num long")


def page_object(df: DataFrame, page: int, **options) -> DataFrame:
    """(file_id, obj_num, prim_json) of that page."""

    def kernel(content: bytes) -> list[tuple]:
        objects = structure.by_number(files.decode(content, **options).objects)
        kids = structure.pages_of(objects)
        return [(kids[page], to_json(objects[kids[page]][0]))] if 0 <= page < len(kids) and kids[page] in objects else []

    return per_file(df, kernel, "file_id {k}, obj_num long, prim_json string")


def streams_of_page(df: DataFrame, page: int, **options) -> DataFrame:
    """(file_id, place, obj_num, text) of the contents that page lists, decoded, as UTF-8."""

    def kernel(content: bytes) -> list[tuple]:
        objects = structure.by_number(files.decode(content, **options).objects)
        kids = structure.pages_of(objects)
        if not 0 <= page < len(kids) or kids[page] not in objects:
            return []
        out = []
        for k, n in enumerate(structure.references(value_at(objects[kids[page]][0], "Contents"))):
            data = _payload(*objects[n]) if n in objects else None
            if data is not None:
                out.append((k, n, data.decode("utf-8", "replace")))
        return out

    return per_file(df, kernel, "file_id {k}, place int, obj_num long, text string")


def counted(df: DataFrame) -> DataFrame:
    """(file_id, n): how many rows each file gave, what a sink that counts would return."""
    return df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def digests_df(df: DataFrame) -> DataFrame:
    return df.select("file_id", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


def prim(path: str, column: str = "prim_json") -> Column:
    """The JSON of the value under a path of keys; null where there is none."""
    return F.get_json_object(column, "$." + path)


def name_at(path: str, column: str = "prim_json") -> Column:
    v = prim(path, column)
    return F.when(v.startswith("/"), F.substring(v, 2, 1 << 30))


def ref_number(v: Column) -> Column:
    return F.when(v.startswith("@"), F.split(F.substring(v, 2, 1 << 30), " ")[0].cast("long"))


def references(path: str, column: str = "prim_json") -> Column:
    """Object numbers of the references in an array; of other elements none."""
    return references_in(prim(path, column))


def references_in(array: Column) -> Column:
    """The same of an array's JSON."""
    return F.filter(F.transform(F.from_json(array, "array<string>"), ref_number), lambda x: x.isNotNull())


def at(path: str, kind: str = "string", column: str = "value") -> Column:
    """What a parsed value, a variant, has under a path of keys; null where that is of another kind."""
    return F.try_variant_get(F.col(column), "$." + path, kind)


def name_in(path: str, column: str = "value") -> Column:
    v = at(path, column=column)
    return F.when(v.startswith("/"), F.substring(v, 2, 1 << 30))


def elements_df(decoded: DataFrame, strict: bool = False) -> DataFrame:
    """decoded with kinds: page, pages, font_resource, info, array, general; image, embedded_file and
    general contents. A page without four numbers for its box, or a pages node with kids that aren't
    references, has an error; with strict the first that is met ends the job. Each value is parsed once."""
    # fixed values: keys by which an information dictionary is known
    info = ("Author", "Producer", "Creator", "CreationData", "ModDate")
    parsed = decoded.select("file_id", "seq", "kind", "obj_num", "gen", "prim_json", F.try_parse_json("prim_json").alias("value"))
    has = lambda *names: F.greatest(*[at(n, "variant").isNotNull() for n in names], F.lit(False))
    read = parsed.select(
        "file_id", "seq", "kind", "obj_num", "gen", "prim_json", name_in("Type").alias("type"), name_in("Subtype").alias("subtype"), name_in("Filter").alias("__codec"),
        has("Font").alias("__font"), has(*info).alias("__info"), at("MediaBox", "array<string>").alias("__box"), at("Kids", "array<string>").alias("__kids"), at("Parent").isNull().alias("__top"),
    )
    data = F.when(F.col("type") == "Page", "page").when(F.col("type") == "Pages", "pages").when(F.col("__font"), "font_resource").when(F.col("__info"), "info").when(F.col("prim_json").startswith("["), "array").otherwise("general")
    image = (F.col("subtype") == "Image") & F.col("__codec").isin("DCTDecode", "CCITTFaxDecode")
    content = F.when(image, "image").when(F.col("type") == "EmbeddedFile", "embedded_file").otherwise("general")
    is_data, pages = F.col("kind") == "data", F.col("type") == "Pages"
    good_box = (F.size("__box") == 4) & F.forall("__box", lambda x: F.coalesce(x.startswith("#"), F.lit(False)))
    good_kids = F.forall("__kids", lambda x: F.coalesce(x.startswith("@"), F.lit(False)))
    error = F.when(is_data & (F.col("type") == "Page") & ~F.coalesce(good_box, F.lit(False)), "MediaBox").when(is_data & pages & ~F.coalesce(good_kids, F.lit(False)), "Kids")
    out = read.select(
        "file_id", "seq", F.when(is_data, data).otherwise(F.concat(F.lit("content_"), content)).alias("kind"), "obj_num", "gen", "type", "subtype",
        F.transform("__box", lambda x: F.substring(x, 2, 1 << 30).try_cast("decimal(38,18)")).alias("media_box"), F.when(pages, F.filter(F.transform("__kids", ref_number), lambda x: x.isNotNull())).alias("kids"),
        F.when(pages, F.col("__top")).alias("root"), F.when(image & (F.col("__codec") == "DCTDecode"), "jpg").when(image, "tiff").alias("image_codec"), error.alias("error"), "prim_json",
    )
    if not strict:
        return out
    wrong = F.raise_error(F.concat(F.lit("object "), F.col("obj_num").cast("string"), F.lit(": "), F.col("error")))
    return out.withColumn("error", F.when(F.col("error").isNotNull(), wrong.cast("string")))


def uncompressed(decoded: DataFrame, column: str = "payload") -> DataFrame:
    """decoded with each content's decoded payload, or null where its filters fail."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decoded.schema) + f", `{column}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for header, raw in zip(batch.column("prim_json").to_pylist(), batch.column("raw_stream").to_pylist(), strict=True):
                try:
                    out.append(None if raw is None else filters.decoded(from_json(header), raw))
                except Malformed:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, column])

    return decoded.mapInArrow(run, schema)


def page_text_df(decoded: DataFrame) -> DataFrame:
    """(file_id, page_obj, seq, text): the contents that a page refers to, in order, decoded (raw where
    that fails) and read. References that lead to no stream are passed over."""
    rows = decoded.where((F.col("kind") == "data") & (name_at("Type") == "Page"))
    one = ref_number(prim("Contents"))
    wanted = rows.select("file_id", "seq", F.col("obj_num").alias("page_obj"), F.posexplode_outer(F.when(one.isNotNull(), F.array(one)).otherwise(references("Contents"))).alias("place", "target"))
    streams = uncompressed(decoded.where("kind = 'content'").select("file_id", F.col("obj_num").alias("target"), "seq", "prim_json", "raw_stream"))
    last = streams.groupBy("file_id", "target").agg(F.max_by(F.coalesce("payload", "raw_stream"), "seq").alias("payload"))
    parts = wanted.join(last, ["file_id", "target"], "left").groupBy("file_id", "page_obj", "seq").agg(F.sort_array(F.collect_list(F.when(F.col("payload").isNotNull(), F.struct("place", "payload")))).alias("parts"))
    kind = decoded.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [contents.text(b"".join(p["payload"] + b"\n" for p in parts)) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["file_id", "page_obj", "seq", "text"])

    return parts.mapInArrow(run, f"file_id {kind}, page_obj long, seq int, text string")


def tokens_df(decoded: DataFrame) -> DataFrame:
    """(file_id, obj_num, tok_no, kind, value) of the tokens of every content's decoded payload."""
    kind = decoded.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, rows = [], []
            for i, (header, raw) in enumerate(zip(batch.column("prim_json").to_pylist(), batch.column("raw_stream").to_pylist(), strict=True)):
                for k, (what, v) in enumerate(contents.tokens(_payload(from_json(header), raw) or b"")):
                    at.append(i)
                    rows.append((k, what, v.decode("latin-1") if isinstance(v, bytes) else str(v)))
            number, what, value = zip(*rows, strict=True) if rows else ((), (), ())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(take), batch.column("obj_num").take(take), pa.array(number, pa.int32()), pa.array(what, pa.string()), pa.array(value, pa.string())], ["file_id", "obj_num", "tok_no", "kind", "value"])

    return decoded.where("kind = 'content'").select("file_id", "obj_num", "prim_json", "raw_stream").mapInArrow(run, f"file_id {kind}, obj_num long, tok_no int, kind string, value string")


def image_files(decoded: DataFrame) -> DataFrame:
    """(file_id, obj_num, extension, bytes) of the images that can be saved as they are."""
    rows = elements_df(decoded).where("kind = 'content_image'").select("file_id", "seq", "image_codec").join(decoded, ["file_id", "seq"])

    kind = decoded.schema["file_id"].dataType.simpleString()

    def saved(header: str, raw: bytes, extension: str) -> bytes:
        v = from_json(header)
        if extension == "jpg":
            return raw
        group = number_of(value_at(filters.parameters(v, 0), "K")) if filters.parameters(v, 0) else 0
        return files.tiff_header(number_of(value_at(v, "Width")) or 0, number_of(value_at(v, "Height")) or 0, len(raw), 4 if (group or 0) < 0 else 3) + raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [saved(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("prim_json", "raw_stream", "image_codec")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("obj_num"), batch.column("image_codec"), pa.array(out, pa.binary())], ["file_id", "obj_num", "extension", "bytes"])

    return rows.select("file_id", "obj_num", "image_codec", "prim_json", "raw_stream").mapInArrow(run, f"file_id {kind}, obj_num long, extension string, bytes binary")
