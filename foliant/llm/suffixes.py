"""Removal of repeated substrings, found in sorted suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Suffixes are sorted by
external induced sorting (module induced), in shards: windows of `length` bytes are dealt by their
minimizer, the least hash of their grams, so that equal windows meet in one shard. Two neighbours among a
shard's sorted suffixes that have `length` bytes in common mark repeated windows.

What needs no sorting is left out before. A minimizer met once, with no repetition inside its run of
windows, proves them unique. Runs of windows are counted by their content; one run of each content goes on,
and none where a minimizer has one content alone, whose runs are copies of each other. Within a shard,
windows that hold a gram met nowhere else in it are unique, too, and cut out.

A minimizer whose contents would take an eighth of a shard (a common line within different texts) is split: the
windows under it are dealt anew by the minimizers of longer grams, again and again, at last by themselves.

Nulls: a null text counts as empty. Rows are told apart by id and text, so null and repeated ids keep
their own text; a row that occurs twice is a repetition. Texts are taken whole as UTF-8, matches don't
cross rows. Other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import Tables, cut, hold, map_batches, pieces_for, release, trim
from foliant.llm.induced import Scratch, places, sorted_suffixes
from foliant.llm.minhash import bytes_of, mix

GRAM = 32
SAMPLED = 8  # one gram in so many is looked at within a shard
GROUP = 1 << 18  # bytes hashed at once
LONG = 4096  # windows in a run; longer runs are cut
_rng = np.random.default_rng(977)
TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
BASES = np.array(BASE, dtype=np.uint64)
INVERSE = np.array([pow(b, -1, 1 << 64) for b in BASE], dtype=np.uint64)


def window_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `width` bytes, from prefix sums of the bytes' random values times powers of an odd base."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLES[which][data] * powers(n, BASES[which]), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n - width + 1, INVERSE[which]))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base squared, ... modulo 2 to the 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def sliding(x: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Least (or greatest) of each run of `width` values: of the two block-wise accumulations that meet in it."""
    n = len(x)
    blocks = -(-n // width)
    op, fill = (np.minimum, np.iinfo(np.uint64).max) if low else (np.maximum, 0)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    right = op.accumulate(rows, axis=1).reshape(-1)
    left = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(left[: n - width + 1], right[width - 1 : n])


def runs_of(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimizer, whether it occurs more than once in the run) of each run."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    empty = np.zeros(0, np.int64)
    nothing = empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    if len(data) < length:
        return nothing
    w = length - gram + 1
    grams = window_hashes(data, gram)
    least = sliding(grams, w, True)
    n = len(least)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    valid = np.arange(n) + length <= ends[owner]
    change = np.ones(n, bool)
    if w > 1:
        change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(change & valid)
    if not len(starts):
        return nothing
    bounds = np.flatnonzero(change | ~valid)
    nxt = np.searchsorted(bounds, starts, "right")
    count = np.where(nxt < len(bounds), bounds[np.minimum(nxt, len(bounds) - 1)], n) - starts
    value = least[starts]
    # minimizer positions: grams that are the least of some window around them
    again = np.zeros(len(starts), bool)
    top = sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, False)
    spots = np.flatnonzero(grams == top[: len(grams)])
    p, q = spots[:-1], spots[1:]
    same = (grams[p] == grams[q]) & (q - p <= w)
    p, q = p[same], q[same]
    if len(p):
        lo, hi = np.maximum(np.searchsorted(starts, p - w + 1, "right") - 1, 0), np.searchsorted(starts, q, "right") - 1
        for d in range(int((hi - lo).max(initial=-1)) + 1):
            r = lo + d
            ok = (r <= hi) & (r < len(starts))
            ok[ok] = value[r[ok]] == grams[p[ok]]
            again[r[ok]] = True
    parts = -(-count // LONG)
    if parts.max() > 1:
        of = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, count, value, again = starts[of] + k * LONG, np.minimum(count[of] - k * LONG, LONG), value[of], again[of]
    text = owner[starts]
    return text, starts - (ends - sizes)[text], count, value, again


def grouped(sizes: list[int]) -> Iterator[slice]:
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


RUN = "m long, c long, a long, b long, start int, n int, again boolean"


def runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of windows of each text: minimizer m, hash c of the content, row (a, b), n windows from start on."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hold("runs", lambda: None)
        texts = bytes_of(batch.column("text"))
        out: list[tuple[np.ndarray, ...]] = []
        for part in grouped([len(t) for t in texts]):
            own = texts[part]
            text, start, count, value, again = runs_of(own, length)
            c = [xxhash.xxh3_64_intdigest(own[t][s : s + k + length - 1]) for t, s, k in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)]
            out.append((text + part.start, start, count, value, again, np.array(c, dtype=np.uint64)))
        text, start, count, value, again, c = (np.concatenate(x) for x in zip(*out, strict=True))
        take = pa.array(text)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(c.view(np.int64)), batch.column("a").take(take), batch.column("b").take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], ["m", "c", "a", "b", "start", "n", "again"])

    return map_batches(docs, kernel, RUN)


def equal_runs(text: np.ndarray, start: np.ndarray, count: np.ndarray, value: np.ndarray, again: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(first of each different run of a text, how many are equal to it, again of any of them) and (text, first
    window, windows) of all that have an equal one in their text, joined where they touch."""
    order = np.lexsort((start, c, value, text))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (text, value, c)], axis=0)
    begin = np.flatnonzero(new)
    copies = np.diff(np.append(begin, len(order)))
    any_again = np.maximum.reduceat(again[order], begin) if len(begin) else again
    known = np.sort(order[np.repeat(copies, copies) > 1])  # runs stand by text and start
    t, s, z = text[known], start[known], start[known] + count[known]
    opens = np.ones(len(known), bool)
    opens[1:] = (t[1:] != t[:-1]) | (s[1:] > z[:-1])
    closes = np.append(opens[1:], np.ones(min(1, len(opens)), bool))
    return order[begin], copies, any_again, (t[opens], s[opens], z[closes] - s[opens])


def runs_within(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of each piece (m, copies, a, b, start, content) by the minimizers of longer grams, with their
    content and the piece's copies. Windows under another minimizer of the piece stay apart.

    Runs that are equal within a piece are one row, of as many copies; where they stand is known to be repeated
    and comes in rows of its own, so that a piece of few different windows (a line of one word again and again)
    has few rows."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_of(batch.column("content"))
        out: list[tuple[np.ndarray, ...]] = []
        contents: list[bytes | None] = []
        for part in grouped([len(t) for t in texts]):
            own = texts[part]
            text, start, count, value, again = runs_of(own, length, gram)
            c = np.array([xxhash.xxh3_64_intdigest(own[t][s : s + k + length - 1]) for t, s, k in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)], dtype=np.uint64)
            first, times, any_again, (at, begin, windows) = equal_runs(text, start, count, value, again, c)
            contents += [own[t][s : s + k + length - 1] for t, s, k in zip(text[first].tolist(), start[first].tolist(), count[first].tolist(), strict=True)]
            out.append((text[first] + part.start, start[first], count[first], value[first], any_again, c[first], times, np.zeros(len(first), bool)))
            contents += [None] * len(at)
            none = np.zeros(len(at), np.uint64)
            out.append((at + part.start, begin, windows, none, none.astype(bool), none, none.astype(np.int64), np.ones(len(at), bool)))
        text, start, count, value, again, c, times, known = (np.concatenate(x) for x in zip(*out, strict=True))
        take = pa.array(text)
        m = mix(batch.column("m").to_numpy().view(np.uint64)[text] * BASES[0] + value)
        at = batch.column("start").to_numpy()[text] + start
        copies = batch.column("copies").to_numpy()[text] * times
        return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), batch.column("a").take(take), batch.column("b").take(take), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again), pa.array(copies), pa.array(contents, pa.binary()), pa.array(known)], ["m", "c", "a", "b", "start", "n", "again", "copies", "content", "known"])

    return map_batches(pieces, kernel, RUN + ", copies long, content binary, known boolean")


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def in_doubt(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each place of the joined pieces, whether a window begins there of which all sampled grams occur
    elsewhere in them, too."""
    place = np.arange(len(data), dtype=owner.dtype)
    flags = place + length <= ends[owner]
    if len(data) >= GRAM:
        h = window_hashes(data, GRAM)
        spots = np.flatnonzero((h % np.uint64(SAMPLED) == 0) & (place[: len(h)] + GRAM <= ends[owner[: len(h)]]))
        order = np.argsort(h[spots])
        v = h[spots][order]
        edge = np.ones(len(v) + 1, bool)
        edge[1:-1] = v[1:] != v[:-1]
        once = spots[order[edge[1:] & edge[:-1]]]
        # windows over a gram met once; those of the pieces before and after don't reach it
        ruled = np.bincount(np.maximum(once - (length - GRAM), 0), minlength=len(data)) - np.bincount(once + 1, minlength=len(data) + 1)[: len(data)]
        flags &= np.cumsum(ruled) == 0
    return flags


def repeated_windows(pieces: list[bytes], length: int, room: int = 1 << 22) -> list[np.ndarray]:
    """For each piece, whether the window at each of its places is repeated among all pieces. room: suffix
    tuples held in memory; more go to disk."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    kind = places(len(data))
    ends = np.cumsum(sizes).astype(kind)
    first, number = stretches(in_doubt(data, ends, np.repeat(np.arange(len(pieces), dtype=kind), sizes), length))
    flags = np.zeros(len(data), bool)
    if len(first):
        # the open stretches, bytes counted from 2, a 1 behind each, and 0 at the end
        widths = number + length
        begin = np.cumsum(widths) - widths
        source = np.repeat((first - begin).astype(kind), widths) + np.arange(int(widths.sum()), dtype=kind)
        t = np.append(data[np.minimum(source, len(data) - 1)].astype(np.uint16) + 2, np.uint16(0))
        t[begin + widths - 1] = 1
        hit = np.zeros(len(t), bool)
        with Scratch(room) as scratch:
            before = np.zeros(1, np.int64)
            for position, common in sorted_suffixes(t, 258, scratch, length):
                both = np.flatnonzero(common >= length)
                hit[position[both]] = True
                hit[np.where(both > 0, position[both - 1], before[0])] = True
                before = position[-1:].copy()
        inside = np.arange(len(source), dtype=kind) < np.repeat((begin + number).astype(kind), widths)
        flags[source[hit[:-1] & inside]] = True
    return np.split(flags, ends[:-1])


def shard_sorter(length: int, room: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        hold("shards", lambda: None)
        copies, start = table.column("copies").to_numpy(), table.column("start").to_numpy()
        keep, s, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, flags in enumerate(repeated_windows(table.column("content").to_pylist(), length, room)):
            if copies[i] == 1:  # of copied ones it is known
                first, number = stretches(flags)
                keep.append(np.full(len(first), i))
                s.append(start[i] + first)
                n.append(number)
        trim()
        take = pa.array(np.concatenate(keep))
        return pa.table([table.column("a").take(take), table.column("b").take(take), pa.array(np.concatenate(s).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32))], ["a", "b", "start", "n"])

    return run


def slices(fetched: DataFrame, length: int) -> DataFrame:
    """(m, copies, crowded, a, b, start, content) of the wanted parts of each text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, m, copies, crowded, start, content = [], [], [], [], [], []
        for r, (text, parts) in enumerate(zip(bytes_of(batch.column("text")), batch.column("parts").to_pylist(), strict=True)):
            for p in parts:
                rows.append(r)
                m.append(p["m"])
                copies.append(p["copies"])
                crowded.append(p["crowded"])
                start.append(p["start"])
                content.append(text[p["start"] : p["start"] + p["n"] + length - 1])
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(copies, pa.int64()), pa.array(crowded, pa.bool_()), batch.column("a").take(take), batch.column("b").take(take), pa.array(start, pa.int32()), pa.array(content, pa.binary())], ["m", "copies", "crowded", "a", "b", "start", "content"])

    return map_batches(fetched, kernel, "m long, copies long, crowded boolean, a long, b long, start int, content binary")


def grams(length: int) -> list[int]:
    """Sizes of grams, each level's closer to the window; those of the last are the windows."""
    out, gram = [], min(GRAM, length)
    while gram < length:
        out.append(gram)
        gram = length - (length - gram) // 3
        if length - gram < 4:
            break
    return [*out, length]


def spans(docs: DataFrame, length: int, shard_bytes: int, room: int, keep: Tables) -> DataFrame:
    """(a, b, spans): n windows from byte start on are repeated, for each of spans. docs: a, b, text."""
    span = ["a", "b", "start", "n"]
    found: list[DataFrame] = []
    source = runs(docs, length).withColumn("copies", F.lit(1).cast("long"))
    for level, gram in enumerate(grams(length)):
        content = ["content"] if level else []
        every = keep(source)
        if level:
            found.append(every.where("known").select(span))
            every = every.where("not known").drop("known")
        counts = every.groupBy("m").agg(F.sum("copies").alias("k"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("again").alias("again")).where("k > 1 or again")
        counts = counts.select("m", (F.col("c1") == F.col("c2")).alias("alone"), "k")
        hits = keep(every.drop("again").join(counts, "m"))
        found.append(hits.where("alone and k > 1").select(span))
        open_ = hits.where("not (alone and k > 1)")
        # a minimizer's contents, each with a row that holds it
        contents = keep(open_.groupBy("m", "c").agg(F.sum("copies").alias("copies"), F.min(F.struct(*span, *content)).alias("x")))
        found.append(open_.join(contents.where("copies > 1").select("m", "c"), ["m", "c"], "left_semi").select(span))
        sizes = contents.groupBy("m").agg(F.sum(F.col("x.n").cast("long") + (length - 1)).alias("bytes"))
        chosen = contents.join(sizes.where(F.col("bytes") > shard_bytes // 8), "m", "left").withColumn("crowded", F.col("bytes").isNotNull())
        if level:
            pieces = chosen.select("m", "copies", "crowded", "x.a", "x.b", "x.start", "x.content")
        else:
            wanted = chosen.groupBy("x.a", "x.b").agg(F.collect_list(F.struct("m", "copies", "crowded", "x.start", "x.n")).alias("parts"))
            pieces = slices(docs.join(wanted, ["a", "b"]).dropDuplicates(["a", "b"]), length)
        pieces = keep(pieces)
        usual = pieces.where("not crowded")
        total = usual.agg(F.sum(F.octet_length("content"))).head()[0] or 0
        if total:
            shard = F.pmod(F.xxhash64("m"), F.lit(pieces_for(total, shard_bytes)))
            found.append(keep(usual.withColumn("shard", shard).groupBy("shard").applyInArrow(shard_sorter(length, room), "a long, b long, start int, n int")))
        crowd = pieces.where("crowded")
        if gram == length or crowd.isEmpty():
            break
        source = runs_within(crowd, length, grams(length)[level + 1])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out.groupBy("a", "b").agg(F.collect_set(F.struct("start", "n")).alias("spans")))


def removed(starts: list[dict[str, int]] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs, [from, to)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] + length - 1) for x in starts or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def located(docs: DataFrame, length: int, id_col: str, text_col: str, shard_bytes: int, room: int) -> DataFrame:
    """(row, spans): docs' columns as one struct, so that their names can't clash with others. Two hashes of
    id and text tell rows apart."""
    text, none = F.coalesce(text_col, F.lit("")), F.col(id_col).isNull()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), none, text).alias("a"), F.xxhash64(text, F.lit(1), F.col(id_col), none).alias("b"), F.col(text_col).alias("text"))
    with Tables(docs.sparkSession) as keep:
        found = spans(rows.select("a", "b", "text"), length, shard_bytes, room, keep)
    release(docs.sparkSession)
    return rows.select("row", "a", "b").join(found, ["a", "b"], "left").select("row", "spans")


def fields(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    row = batch.column("row")
    return dict(zip([f.name for f in row.type], row.flatten(), strict=True))


def dedup_digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20, room: int = 1 << 22) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = located(docs.select(id_col, text_col), length, id_col, text_col, shard_bytes, room)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, count, sha = [], [], [], []
        row = fields(batch)
        for text, s in zip(bytes_of(row[text_col]), batch.column("spans").to_pylist(), strict=True):
            parts = removed(s, length)
            digest, at = hashlib.sha256(), 0
            for a, b in parts:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            size.append(len(text))
            gone.append(sum(b - a for a, b in parts))
            count.append(len(parts))
            sha.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([row[id_col], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(rows, kernel, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20, room: int = 1 << 22) -> DataFrame:
    """docs with the repeated bytes of their texts removed; code points of which a part would be left go whole."""
    rows = located(docs, length, id_col, text_col, shard_bytes, room)
    names = docs.columns

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: list[str | None] = []
        row = fields(batch)
        for text, s in zip(row[text_col].to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if s is None:
                texts.append(text)
                continue
            raw, kept, at = (text or "").encode(), [], 0
            for a, b in removed(s, length):
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            texts.append("".join(p.decode("utf-8", "ignore") for p in kept))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else row[c] for c in names], names)

    return map_batches(rows, kernel, docs.schema)
