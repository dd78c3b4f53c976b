"""Page trees and faults of files from object rows, joined by (file, number): no file is gathered.

Nodes with one parent find the nearest forerunner that has several, or the root, by pointers that double their reach
each round, so that a tree of depth n takes log n rounds. The others, which only shared or circular nodes are, form a
graph of their own that is gone through from the root. A node that several parents list is expanded once, at its least
level; a reference to a node's own forerunner is a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import decode
from foliant.plans.prefix import cut

KEY = ["file_id", "node"]


def last_objects(decoded: DataFrame) -> DataFrame:
    """(file_id, node, has_stream, prim_json): the last object of each number."""
    last = F.max_by(F.struct("kind", "prim_json"), "seq")
    return decoded.groupBy("file_id", F.col("obj_num").alias("node")).agg(last.alias("o")).select("file_id", "node", (F.col("o.kind") == "content").alias("has_stream"), "o.prim_json")


def roots(objects: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_id, root, found, top): the catalog's number, whether it is there, and the number under its Pages."""
    catalogs = objects.select("file_id", F.col("node").alias("root"), F.lit(True).alias("found"), decode.ref_number(decode.prim("Pages")).alias("top"))
    return meta.select("file_id", F.col("root_num").alias("root")).join(catalogs, ["file_id", "root"], "left").select("file_id", "root", F.coalesce("found", F.lit(False)).alias("found"), "top")


def forerunners(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """(file_id, node, fork, steps): for each node the nearest node at or above it that is the root, has no parent or
    several, and how far that is. Nodes of circles that nothing leads into have no row. edges: (file_id, parent, place,
    node); tops: (file_id, node)."""
    parents = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    all_ = edges.select(*KEY).union(edges.select("file_id", "parent")).union(tops.select(*KEY)).distinct()
    known = all_.join(parents, KEY, "left").join(tops.select(*KEY, F.lit(True).alias("top")), KEY, "left")
    alone = (F.col("n") == 1) & F.col("top").isNull()
    now = cut(known.select(*KEY, F.when(alone, F.col("parent")).otherwise(F.col("node")).alias("fork"), F.when(F.coalesce(alone, F.lit(False)), 1).otherwise(0).cast("long").alias("steps"), (~F.coalesce(alone, F.lit(False))).alias("done")))
    left = None
    while (open_ := now.where("not done").count()) and open_ != left:
        left = open_
        further = now.select("file_id", F.col("node").alias("fork"), F.col("fork").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = now.where("not done").join(further, ["file_id", "fork"]).select(*KEY, F.col("next").alias("fork"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        now = cut(now.where("done").union(moved))
    return now.where("done").select(*KEY, "fork", "steps")


def _levels(ways: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, fork, level) of forks that the root reaches, and (file_id, fork, above) of the fork each is reached
    from. ways: (file_id, above, fork, length, parent, place) between forks."""
    start = tops.select("file_id", F.col("node").alias("fork"), F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("above"))
    if ways.isEmpty():
        return start.select("file_id", "fork", "level"), start.select("file_id", "fork", "above")
    now, before = cut(start), None
    first = Window.partitionBy("file_id", "fork").orderBy("level", F.col("above").asc_nulls_first())
    while (state := now.agg(F.count(F.lit(1)), F.sum("level")).head()) != before:
        before = state
        reached = ways.join(now.select("file_id", F.col("fork").alias("above"), "level"), ["file_id", "above"]).select("file_id", "fork", (F.col("level") + F.col("length")).alias("level"), "above")
        now = cut(now.union(reached).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn"))
    return now.select("file_id", "fork", "level"), now.select("file_id", "fork", "above")


def _circular(ways: DataFrame, above: DataFrame) -> DataFrame:
    """Of ways, (file_id, parent, place, fork) of those that lead to a fork above themselves."""
    asked = cut(ways.select("file_id", "parent", "place", "fork", F.col("above").alias("at")))
    found = asked.where("at = fork")
    while not (asked := cut(asked.where("at <> fork").join(above.select("file_id", F.col("fork").alias("at"), F.col("above").alias("next")), ["file_id", "at"]).where("next is not null").select("file_id", "parent", "place", "fork", F.col("next").alias("at")))).isEmpty():
        found = found.union(asked.where("at = fork"))
    return found.select("file_id", "parent", "place", "fork")


def page_tree(objects: DataFrame, tops: DataFrame, depth: int = 16) -> DataFrame:
    """(file_id, node, parent, level, kind): a row for the root and one for each reference to a node that the root
    reaches. kind: pages, page, invalid, missing, or cycle for a node that is above itself or deeper than `depth`."""
    kinds = F.when(decode.name_at("Type") == "Pages", "pages").when(decode.name_at("Type") == "Page", "page").otherwise("invalid")
    typed = cut(objects.select(*KEY, kinds.alias("kind"), F.when(decode.name_at("Type") == "Pages", decode.references("Kids")).alias("kids")))
    tops = tops.where("node is not null")
    edges = typed.select("file_id", F.col("node").alias("parent"), F.posexplode("kids").alias("place", "node"))
    near = cut(forerunners(edges, tops))
    forks = near.where("steps = 0").select("file_id", F.col("node").alias("fork"))
    of_parent = near.select("file_id", F.col("node").alias("parent"), F.col("fork").alias("above"), (F.col("steps") + 1).alias("length"))
    placed = edges.join(of_parent, ["file_id", "parent"])
    ways = cut(placed.withColumnRenamed("node", "fork").join(forks, ["file_id", "fork"], "left_semi"))
    levels, above = _levels(ways, tops)
    rows = placed.join(levels.withColumnsRenamed({"fork": "above"}), ["file_id", "above"]).select("file_id", "node", "parent", "place", (F.col("level") + F.col("length")).alias("level"))
    top = tops.select("file_id", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("place"), F.lit(0).cast("long").alias("level"))
    circles = _circular(ways, above).select("file_id", "parent", "place", F.lit(True).alias("circle"))
    whole = rows.join(circles, ["file_id", "parent", "place"], "left").unionByName(top, allowMissingColumns=True).where(F.col("level") <= depth + 1)
    kind = F.when(F.coalesce("circle", F.lit(False)) | (F.col("level") > depth), "cycle").otherwise(F.coalesce("kind", F.lit("missing")))
    return whole.join(typed.select(*KEY, "kind"), KEY, "left").select("file_id", "node", "parent", F.col("level").cast("int").alias("level"), kind.alias("kind"))


def _fault(kind: str | Column, owner: Column | None = None, target: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("long")
    return ["file_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if owner is None else owner).alias("owner"), (none if target is None else target).alias("target")]


def content_faults(objects: DataFrame, single: bool = False) -> DataFrame:
    """(file_id, kind, owner, target): references under Contents that lead to no stream. Lists of references are followed
    to their end, one list deeper each round."""
    one = decode.ref_number(decode.prim("Contents"))
    many = decode.references("Contents")
    held = F.when(F.lit(single) & one.isNotNull(), F.array(one)).otherwise(many)
    listed = decode.references_in(F.col("prim_json"))
    target = objects.select("file_id", F.col("node").alias("target"), F.lit(True).alias("there"), "has_stream", F.when(~F.col("has_stream") & F.col("prim_json").startswith('["@'), listed).alias("list"))
    now = cut(objects.select("file_id", F.col("node").alias("owner"), F.explode(held).alias("target")).withColumn("path", F.array().cast("array<long>")))
    out = now.where("false").select(*_fault("", F.col("owner"), F.col("target")))
    while not now.isEmpty():
        met = cut(now.join(target, ["file_id", "target"], "left").withColumn("again", F.array_contains("path", F.col("target"))))
        kind = F.when(F.col("again"), "ContentTooDeep").when(F.col("there").isNull(), "ContentMissing").when(~F.col("has_stream") & F.col("list").isNull(), "ContentStreamMissing")
        out = out.union(met.select(*_fault(kind, F.col("owner"), F.col("target"))).where("kind is not null"))
        now = cut(met.where("not again and list is not null").select("file_id", "owner", F.explode("list").alias("next"), F.concat("path", F.array("target")).alias("path")).withColumnRenamed("next", "target").select("file_id", "owner", "target", "path"))
    return out


def faults(decoded: DataFrame, meta: DataFrame, single: bool = False) -> DataFrame:
    """(file_id, kind, owner, target): every fault of every file. Objects whose stream is broken count as missing."""
    meta = cut(meta)
    state = F.when(F.col("objects") == 0, "NoObjs").when(F.col("xrefs") == 0, "NoXrefs")
    assembled = meta.where(state.isNull())
    none = meta.select(*_fault(state)).where("kind is not null")
    # files are read once: what is stored are headers, and whether their stream is broken
    opened = decode.uncompressed(decoded.select("file_id", "seq", "kind", "obj_num", "prim_json", "raw_stream")).select("file_id", "seq", "kind", "obj_num", "prim_json", ((F.col("kind") == "content") & F.col("payload").isNull()).alias("fails"))
    mine = cut(opened.join(assembled.select("file_id"), "file_id", "left_semi"))
    broken = mine.where("fails").select("file_id", "obj_num")
    # a number that is broken once counts with its rows that have no stream alone
    sound = mine.join(broken.distinct().withColumn("bad", F.lit(True)), ["file_id", "obj_num"], "left").where("bad is null or kind = 'data'").drop("bad")
    objects = cut(last_objects(sound))
    at = cut(roots(objects, assembled).join(objects.select("file_id", F.col("node").alias("top"), F.lit(True).alias("there"), decode.name_at("Type").alias("type")), ["file_id", "top"], "left"))
    kind = F.when(F.col("root").isNull(), "NoRoot").when(~F.col("found"), "NoCatalog").when(F.col("top").isNull(), "NoPagesInCatalog").when(F.col("there").isNull(), "NoPageRoot").when(F.col("type") == "Page", "NoPages")
    wrong = at.select(*_fault(kind, None, F.when(kind == "NoCatalog", F.col("root")).when(kind.isin("NoPageRoot", "NoPages"), F.col("top")))).where("kind is not null")
    tree = page_tree(objects, at.where(kind.isNull()).select("file_id", F.col("top").alias("node")))
    of_tree = F.when((F.col("kind") == "missing") & (F.col("level") > 0), "PageMissing").when(F.col("kind") == "invalid", "InvalidPageTreeObject").when(F.col("kind") == "cycle", "PageTreeCycle")
    pages = tree.select(*_fault(of_tree, F.col("parent"), F.col("node"))).where("kind is not null")
    return none.union(broken.select(*_fault("BrokenStream", F.col("obj_num")))).union(content_faults(objects, single)).union(wrong).union(pages)
