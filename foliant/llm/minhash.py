"""Near copies of documents: a MinHash inverted join over signature coordinates.

Documents of one shingle set form a class. Each class is posted under pairs (coordinate, value) of its
signature: as any pair of classes at the threshold agrees in at least `least` of `posted` coordinates
(but for a chance of about one in 100,000), it suffices to post each class under the
posted - least + 1 of them that fewest classes share: the prefix. Values that very many documents share are
skipped. Members of a posting list are merged by counting collisions, coordinate by coordinate; pairs that
can't reach the match threshold any more are skipped half way. Pairs that reach it join classes to families.
Families are then confirmed on full shingle sets.

Long lists and large families are cut into blocks and contracted: first every block is compared within
itself and leaves at most one edge a member, then what these edges have joined is no longer compared; only
members outside the largest part of a list or family are sent to its other blocks. So a group of any number
of copies costs rows in proportion to it, and no link between different parts is lost. Before that, the
members of a large family that are like most others in their block are sent to all blocks, as the original
of many edited copies would be.

Nulls: a null text counts as empty; texts without words link with nothing. A null id links with
nothing and is kept. Rows are told apart by id and text: of rows of one id each is in the component of its
own text. Texts may be of any length; other columns are not read. An empty table gives no rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._shared import PORTION, Tables, components, cut, hold, map_batches, pieces_for, portions, trim

COORDINATES, POSTED, LEAST, MATCHES = 64, 24, 10, 36  # a pair with Jaccard 0.8 agrees in 36 of 64 but for one in a million
BLOCK, WIDE, SETS = 1024, 8192, 512  # members of a block of a list, of one that others are sent to, and of one with full sets
HUBS = 16
PAIRS = 1 << 17  # compared at once
_rng = np.random.default_rng(20240607)
A, B = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1), _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_words: dict[bytes, bytes] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M[1]
    x = (x ^ (x >> np.uint64(27))) * M[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold("words", _words.clear)
    out = list(map(_words.get, words))
    if None in out:
        if len(_words) > 300_000:
            _words.clear()
        for i, h in enumerate(out):
            if h is None:
                out[i] = h = xxhash.xxh3_64_intdigest(words[i]).to_bytes(8, sys.byteorder)
                if len(words[i]) <= 64:
                    _words[words[i]] = h
    return np.frombuffer(b"".join(out), np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence where it is shorter.
    Words are runs of bytes other than ASCII white space, with A-Z as a-z."""
    words = text.lower().split()
    return shingles_of(word_hashes(words), size) if words else np.zeros(0, np.uint64)


def shingles_of(w: np.ndarray, size: int) -> np.ndarray:
    return distinct(shingle_hashes(w, min(size, len(w))))


def shingle_hashes(w: np.ndarray, width: int) -> np.ndarray:
    n = len(w)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h = mix(h * M[0] + w[k : n - width + 1 + k])
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique takes longer over short arrays."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, h, n_shingles, set_hash, posted: 24 values of 32 bits, signature: 64 bytes). docs: id, h, text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in bytes_of(batch.column("text"))]
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        there = counts > 0
        least = np.zeros((len(sets), COORDINATES), np.uint32)
        if there.any():
            every = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum(counts[there])[:-1]])
            for k in range(COORDINATES):
                least[there, k] = np.minimum.reduceat(((every * A[k] + B[k]) >> np.uint64(32)).astype(np.uint32), starts)
        sketch = (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(counts), pa.array(hashes, pa.binary()), pa.array([x.tobytes() for x in least[:, :POSTED]], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "h", "n_shingles", "set_hash", "posted", "signature"])

    return map_batches(docs, kernel, f"id {docs.schema['id'].dataType.simpleString()}, h long, n_shingles long, set_hash binary, posted binary, signature binary", PORTION)


class Parts:
    """Union-find over the members of a task, by their numbers or those of parts known before."""

    def __init__(self, part: np.ndarray):
        self.parent = np.unique(part, return_inverse=True)[1].tolist()
        seen: dict[int, int] = {}
        for i, p in enumerate(self.parent):
            self.parent[i] = seen.setdefault(p, i)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        x, y = self.root(a), self.root(b)
        self.parent[x] = y
        return x != y


def square(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def pairs_of(group: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), in portions, of rows of one group (rows stand by group): all pairs, or, where rows ask, those of
    one that asks and one that doesn't."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    sizes = np.diff(bounds)
    plain = np.add.reduceat(asks, bounds[:-1]) == 0
    for g in np.unique(sizes[plain & (sizes > 1)]).tolist():
        begin = bounds[:-1][plain & (sizes == g)]
        i, j = np.triu_indices(g, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(begin), step):
            some = begin[at : at + step, None]
            for cut_ in range(0, len(i), PAIRS):
                yield (some + i[None, cut_ : cut_ + PAIRS]).ravel(), (some + j[None, cut_ : cut_ + PAIRS]).ravel()
    for k in np.flatnonzero(~plain).tolist():
        rows = np.arange(bounds[k], bounds[k + 1])
        asking, held = rows[asks[rows] > 0], rows[asks[rows] == 0]
        step = max(1, PAIRS // max(1, len(held)))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            yield np.repeat(some, len(held)), np.tile(held, len(some))


def collisions(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that agree in `matches` coordinates or more, in how many). Those that can't any more after half of
    the coordinates are skipped."""
    half = sketch.shape[1] // 2
    count = (sketch[a, :half] == sketch[b, :half]).sum(axis=1, dtype=np.int16)
    live = np.flatnonzero(count >= matches - (sketch.shape[1] - half))
    count = count[live] + (sketch[a[live], half:] == sketch[b[live], half:]).sum(axis=1, dtype=np.int16)
    met = count >= matches
    return live[met], count[met]


def likely(table: pa.Table, share: float, matches: int, parts: Parts, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, collisions) of pairs above the match threshold that aren't too unlike in size."""
    size, part = table.column("n_shingles").to_numpy(), table.column("part").to_numpy()
    group = table.column("group").to_numpy()
    for a, b in pairs_of(group, table.column("ask").to_numpy().astype(np.int8)):
        ok = (np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b])) & (part[a] != part[b])
        a, b = a[ok], b[ok]
        if len(a):
            met, count = collisions(sketch, a, b, matches)
            yield a[met], b[met], count


def edge_table(c: np.ndarray, found: list[tuple[int, int]], degree: list[int | None]) -> pa.Table:
    rows = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table([pa.array(c[rows[:, 0]], pa.int64()), pa.array(c[rows[:, 1]], pa.int64()), pa.array(degree, pa.int64())], ["a", "b", "degree"])


def by_collisions(share: float, matches: int) -> Callable[[pa.Table], pa.Table]:
    """Edges, at most one a member, that join what the lists of one task hold."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        c, sketch, parts = table.column("c").to_numpy(), square(table.column("signature"), np.uint8), Parts(table.column("part").to_numpy())
        number, out = np.unique(c, return_inverse=True)[1], []
        for a, b, _ in likely(table, share, matches, parts, sketch):
            first = np.unique(np.minimum(number[a], number[b]) * len(c) + np.maximum(number[a], number[b]), return_index=True)[1]
            out += [(i, j) for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True) if parts.join(i, j)]
        return edge_table(c, out, [None] * len(out))

    return run


def by_sets(percent: int, matches: int) -> Callable[[pa.Table], pa.Table]:
    """Links confirmed on full sets, 100 |A n B| >= percent |A u B|, at most one a member; and, with their own
    class at both ends, the two members of each block of a large family that are likest to most others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        c, sketch, parts = table.column("c").to_numpy(), square(table.column("signature"), np.uint8), Parts(table.column("part").to_numpy())
        sets, group, blocks = table.column("shingles"), table.column("group").to_numpy(), table.column("blocks").to_numpy()
        degree = np.zeros(len(c), np.int64)
        held: dict[int, np.ndarray] = {}

        def full(r: int) -> np.ndarray:
            if r not in held:
                if len(held) > 4096:
                    held.clear()
                held[r] = np.frombuffer(sets[r].as_py(), np.uint64)
            return held[r]

        out, degrees = [], []
        for a, b, count in likely(table, percent / 100, matches, parts, sketch):
            near = count * 100 >= percent * sketch.shape[1]
            degree += np.bincount(a[near], minlength=len(c)) + np.bincount(b[near], minlength=len(c))
            order = np.argsort(-count, kind="stable")
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                if parts.root(i) != parts.root(j):
                    x, y = full(i), full(j)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        parts.join(i, j)
                        out.append((i, j))
                        degrees.append(None)
        if not table.column("ask").to_numpy().any():
            order = np.lexsort((-degree, group))
            place = np.arange(len(order)) - np.searchsorted(group, group[order])
            for r in order[(place < 2) & (blocks[order] > 1)].tolist():
                out.append((r, r))
                degrees.append(int(degree[r]))
        return edge_table(c, out, degrees)

    return run


EDGES = "a long, b long, degree long"


def blocked(members: DataFrame, of: str, total: str, size: int) -> DataFrame:
    """members with the number of blocks of `size` members of their list or family `of`, and their own block."""
    rows = members.withColumn("blocks", F.ceil(F.col(total) / F.lit(size)).cast("long"))
    return rows.withColumn("block", F.pmod(F.xxhash64("c", of, F.lit(7)), F.col("blocks")))


def compared(rows: DataFrame, of: str, kernel: Callable[[pa.Table], pa.Table], per_task: int) -> DataFrame:
    """Edges of rows (of, block, blocks, c, part, ask, ...), many lists or families in a task."""
    rows = rows.withColumn("group", F.xxhash64(of, "block"))
    shard = F.pmod(F.xxhash64("group"), F.lit(per_task))
    return rows.withColumn("shard", shard).drop(of, "block").groupBy("shard").applyInArrow(kernel, EDGES)


def strangers(members: DataFrame, of: str, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of lists or families that hold several parts, those of them outside the largest part), with
    their part."""
    rows = members.drop("part").join(parts.toDF("c", "part"), "c", "left").withColumn("part", F.coalesce("part", "c"))
    counts = rows.groupBy(of, "part").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy(of).agg(F.max_by("part", F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1").select(of, "top")
    rows = rows.join(tops, of)
    return rows.drop("top"), rows.where("part <> top").drop("top")


def against_all(held: DataFrame, asking: DataFrame) -> DataFrame:
    """held rows in their own block, asking ones in every block of their list or family."""
    every = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return held.withColumn("ask", F.lit(False)).unionByName(every.withColumn("ask", F.lit(True)))


def families(lists: DataFrame, share: float, matches: int, keep: Tables) -> DataFrame:
    """(id, component) of the classes c that lists (key, c, total, n_shingles, signature) join by collisions."""
    kernel = by_collisions(share, matches)
    lists = keep(lists.withColumn("part", F.col("c")))
    n = lists.count()
    edges = keep(compared(blocked(lists, "key", "total", BLOCK).withColumn("ask", F.lit(False)), "key", kernel, pieces_for(n, 1 << 13)))
    long_ = lists.where(F.col("total") > BLOCK)
    parts = components(edges)
    if not long_.isEmpty():
        held, asking = strangers(blocked(long_, "key", "total", WIDE), "key", keep(parts))
        rows = keep(against_all(held, asking))
        more = keep(compared(rows, "key", kernel, pieces_for(rows.count(), WIDE)))
        parts = components(edges.unionByName(more))
    return keep(parts)


def confirmed(full: DataFrame, percent: int, matches: int, keep: Tables) -> DataFrame:
    """(id, component): the components of links, confirmed on full sets, among the classes c of each family.
    full: component, c, total, n_shingles, signature, shingles."""
    kernel = by_sets(percent, matches)
    rows = blocked(full.withColumn("part", F.col("c")), "component", "total", SETS)
    size = full.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")).head()
    tasks = max(pieces_for(size["n"], 1 << 13), pieces_for(size["bytes"] or 0, 8 << 20))
    first = keep(compared(rows.withColumn("ask", F.lit(False)), "component", kernel, tasks))
    edges = first.where("degree is null")
    large = rows.where("blocks > 1")
    if not large.isEmpty():
        best = Window.partitionBy("component").orderBy(F.col("degree").desc(), "c")
        hubs = large.join(first.where("degree is not null").select(F.col("a").alias("c"), "degree"), "c").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HUBS).drop("rank", "degree")
        edges = keep(edges.unionByName(compared(against_all(large, hubs), "component", kernel, tasks)))
        held, asking = strangers(large, "component", keep(components(edges)))
        edges = keep(edges.unionByName(compared(against_all(held, asking), "component", kernel, tasks)))
    return components(edges)


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): components of documents whose sets of `size`-word shingles
    have a Jaccard similarity of percent / 100 or more. component_id: the smallest id; its document is kept."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    with Tables(docs.sparkSession) as keep:
        signed = keep(signatures(source, size))
        classes = signed.where("set_hash is not null and id is not null").groupBy("set_hash").agg(F.min(F.struct("id", "h")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("posted").alias("posted"), F.first("signature").alias("signature"))
        classes = keep(classes.withColumn("c", F.monotonically_increasing_id()))  # of the stored table, so that it stays
        # a row for each class, coordinate and value; values that one class alone has can't collide
        posts = classes.select("c", F.posexplode(F.expr(f"transform(sequence(0, {POSTED - 1}), i -> substring(posted, 4 * i + 1, 4))")).alias("k", "v"))
        posts = posts.select("c", F.xxhash64("k", "v").alias("key"))
        shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
        posted = posts.join(shared, "key").withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("total", "key"))).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("c")))
        posted = keep(posted.where(F.col("rank") <= F.col("held") - F.lit(LEAST - 1)).select("c", "key"))
        totals = posted.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
        lists = posted.join(totals, "key").join(classes.select("c", "n_shingles", "signature"), "c")
        found = families(lists, percent / 100, MATCHES, keep)
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
        members = found.withColumnRenamed("id", "c").join(sizes, "component").join(classes.select("c", "at.id", "at.h", "n_shingles", "signature"), "c")
        texts = source.join(members, ["id", "h"]).dropDuplicates(["c"])
        linked = keep(confirmed(keep(with_sets(texts, size)), percent, MATCHES, keep))
        joined = classes.select("set_hash", "c", "at.id").join(linked.toDF("c", "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        least = joined.groupBy("component").agg(F.min("id").alias("found"))
        of_class = joined.join(least, "component").select("set_hash", "found")
        out = signed.select("id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
        return cut(out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def with_sets(rows: DataFrame, size: int) -> DataFrame:
    """Members of families with their full shingle sets."""
    columns = ["component", "c", "total", "n_shingles", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION):
                sets = [shingles(text, size).tobytes() for text in bytes_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(sets, pa.binary())], [*columns, "shingles"])
        batch = part = sets = None
        trim()

    return rows.select(*columns, "text").mapInArrow(run, "component long, c long, total long, n_shingles long, signature binary, shingles binary")
