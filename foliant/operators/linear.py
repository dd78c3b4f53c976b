"""Linearised files from object rows: what the first page needs comes first, behind a cross-reference section of its own.

What the first page refers to is found by rounds that each follow only what the round before has found. Offsets are two
running sums; how long the part before them is depends on numbers that depend on it, and is settled by trying until it
stays the same. A file comes as rows (file_id, off, bytes), as `ranges.write_parts` takes them; none is
gathered. Cross-references of the first page are sections of one entry each, as numbers stay what they were; the main
section has every number. There is no hint stream (`H` is [0 0])."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import files
from foliant.functions.batches import sliced
from foliant.functions.objects import from_json, num, write
from foliant.operators import decode, tree
from foliant.operators.decode import per_file_struct
from foliant.operators.write import encoded_df, parts_of
from foliant.plans.prefix import cut, running

ENTRIES = 4096  # of the main cross-reference section in a row


def needed(objects: DataFrame, start: DataFrame) -> DataFrame:
    """(file_id, node): all that the start nodes lead to by references, but those under Parent, themselves included.
    objects: as tree.last_objects gives them."""
    own = F.regexp_replace("prim_json", '"Parent":"@[0-9]+ [0-9]+"', '"Parent":null')
    links = cut(objects.select("file_id", "node", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(own, F.lit('"@([0-9]+) [0-9]+"')), lambda x: x.cast("long")))).alias("to")))
    new = cut(start.select("file_id", "node").distinct())
    met = new
    while not new.isEmpty():
        ahead = links.join(new, ["file_id", "node"]).select("file_id", F.col("to").alias("node")).distinct()
        new = cut(ahead.join(met, ["file_id", "node"], "left_anti").join(objects.select("file_id", "node"), ["file_id", "node"], "left_semi"))
        met = cut(met.union(new))
    return met


def first_pages(objects: DataFrame, tops: DataFrame) -> DataFrame:
    """(file_id, node): the page that first kids lead to from the root of the page tree."""
    kids = F.when(decode.name_at("Type") == "Pages", decode.references("Kids"))
    down = objects.select("file_id", kids[0].alias("parent"), F.lit(0).alias("place"), "node").where("parent is not null")
    ends = tree.forerunners(down, tops.where("false"))
    to = tops.select("file_id", "node").join(ends, ["file_id", "node"], "left").select("file_id", F.coalesce("fork", "node").alias("node"))
    return to.join(objects.where(decode.name_at("Type") == "Page").select("file_id", "node"), ["file_id", "node"])


def _prefix(row: dict) -> dict:
    """What stands before the first object, and what stands behind the main section's entries."""
    trailer = from_json(row["trailer_json"])
    top, own = row["top"], row["top"] + 1
    size = {"Size": num(own + 1)}
    head, at = b"xref\n0 %d\n" % (own + 1), 0
    entries = 20 * (own + 1)
    while True:
        end = at + row["first_size"]
        main = end + row["rest_size"]
        made = files.object_bytes(own, 0, files.linearization(row.get("length", 0), row["page"], end, row["pages"], main), None)
        begin = len(files.HEADER) + len(made)
        sections = [b"%d 1\n%010d %05d n \n" % (e["num"], at + e["rel"], e["gen"]) for e in row["first"]]
        sections.append(b"%d 1\n%010d 00000 n \n" % (own, len(files.HEADER)))
        own_trailer = ("dict", {**{k: v for k, v in trailer[1].items() if k != "Prev"}, **size, "Prev": num(main)})
        whole = files.HEADER + made + b"xref\n" + b"".join(sections) + b"trailer\n%s\nstartxref\n0\n%%%%EOF\n" % write(own_trailer)
        tail = b"trailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (write(("dict", {**{k: v for k, v in trailer[1].items() if k != "Prev"}, **size})), begin)
        length = main + len(head) + entries + len(tail)
        if len(whole) == at and row.get("length") == length:
            return {"head": whole, "main": main, "open": head, "tail": tail, "own": own}
        at, row["length"] = len(whole), length


def linearized(decoded: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_id, off, bytes): the files anew, of each number its last object. Files without a trailer, a page or a
    root have no rows."""
    objects = cut(tree.last_objects(decoded))
    whole = meta.where("trailer_json is not null")
    root = cut(tree.roots(objects, whole).where("top is not null"))
    tops = root.select("file_id", F.col("top").alias("node"))
    page = cut(first_pages(objects, tops))
    # the catalog leads to the page tree and all pages: of it, itself alone
    first = needed(objects, page).union(root.select("file_id", F.col("root").alias("node")).join(page.select("file_id"), "file_id", "left_semi")).distinct()
    last = decoded.groupBy("file_id", "obj_num").agg(F.max("seq").alias("seq"))
    parts = parts_of(decoded).join(last, ["file_id", "obj_num", "seq"], "left_semi").join(page.select("file_id"), "file_id", "left_semi")
    flagged = encoded_df(parts).join(first.select("file_id", F.col("node").alias("obj_num"), F.lit(0).alias("section")), ["file_id", "obj_num"], "left")
    placed = running(flagged.select("file_id", F.coalesce("section", F.lit(1)).alias("section"), "seq", "obj_num", "gen", "bytes", "size"), "file_id", ["section", "seq"], {"rel": F.col("size")})
    is_first = F.col("section") == 0
    entry = F.when(is_first, F.struct(F.col("obj_num").alias("num"), "rel", "gen"))
    sums = placed.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("first"), F.coalesce(F.sum(F.when(is_first, F.col("size"))), F.lit(0)).alias("first_size"), F.coalesce(F.sum(F.when(~is_first, F.col("size"))), F.lit(0)).alias("rest_size"), F.max("obj_num").alias("top"))
    pages = tree.page_tree(objects, tops, 1 << 30).where("kind = 'page'").groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"))
    info = sums.join(whole.select("file_id", "trailer_json"), "file_id").join(page.select("file_id", F.col("node").alias("page")), "file_id").join(pages, "file_id")
    content = F.struct("first", "first_size", "rest_size", "top", "trailer_json", "page", "pages")
    made = cut(per_file_struct(info.select("file_id", content.alias("content")), _prefix, "head binary, main long, open binary, tail binary, own long"))
    bodies = placed.join(made.select("file_id", F.octet_length("head").alias("at")), "file_id").select("file_id", (F.col("at") + F.col("rel")).alias("off"), "bytes")
    return made.select("file_id", F.lit(0).cast("long").alias("off"), F.col("head").alias("bytes")).union(bodies).union(_main_section(placed, made))


def _main_section(placed: DataFrame, made: DataFrame) -> DataFrame:
    """The main cross-references in rows of ENTRIES numbers, with what stands before and behind."""
    used = placed.join(made.select("file_id", F.octet_length("head").alias("at")), "file_id").select("file_id", "obj_num", (F.col("at") + F.col("rel")).alias("offset"), "gen")
    used = used.union(made.select("file_id", "own", F.lit(len(files.HEADER)).cast("long"), F.lit(0)))
    blocks = made.select("file_id", "main", "own", F.octet_length("open").alias("skip"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / ENTRIES))).alias("block"))
    held = used.groupBy("file_id", F.floor(F.col("obj_num") / ENTRIES).alias("block")).agg(F.collect_list(F.struct("obj_num", "offset", "gen")).alias("entries"))
    rows = blocks.join(held, ["file_id", "block"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            offs, out = [], []
            for main, own, skip, block, entries in zip(*(batch.column(c).to_pylist() for c in ("main", "own", "skip", "block", "entries")), strict=True):
                there = {e["obj_num"]: e for e in entries or ()}
                span = range(block * ENTRIES, min(own + 1, (block + 1) * ENTRIES))
                # free numbers aren't linked with each other: each leads back to number 0
                out.append(b"".join(b"%010d %05d n \n" % (there[n]["offset"], there[n]["gen"]) if n in there else b"%010d %05d f \n" % (0, 65535 if n == 0 else 0) for n in span))
                offs.append(main + skip + 20 * block * ENTRIES)
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(offs, pa.int64()), pa.array(out, pa.binary())], ["file_id", "off", "bytes"])

    kind = made.schema["file_id"].dataType.simpleString()
    lines = rows.select("file_id", "main", "own", "skip", "block", "entries").mapInArrow(run, f"file_id {kind}, off long, bytes binary")
    ends = made.select("file_id", (F.col("main") + F.octet_length("open") + 20 * (F.col("own") + 1)).alias("off"), F.col("tail").alias("bytes"))
    return made.select("file_id", F.col("main").alias("off"), F.col("open").alias("bytes")).union(lines).union(ends)
