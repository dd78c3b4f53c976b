"""Repeated passages: MinHash banding of paragraphs, exact verification, clusters by components.

Paragraphs (lines of at least `min_words` words; 1 takes every line) of one set of five-word shingles form a
class. Bands of three of 24 MinHash values, eight of them, bring together 99.7 % of pairs with a Jaccard
similarity of 0.8; what collides in a band is joined by counted collisions, and each resulting family is
confirmed on full shingle sets. The components of confirmed links are clusters; the first paragraph of each,
by document and place, is kept.

Passages that begin, end or break lines anywhere are cut out by their content: of any 39 neighbouring runs of
12 words the one of the least hash is an anchor, so that equal passages of 50 words have an anchor alike.
Anchors that repeat, and what lies between them, are followed from each place to the first place they stand
at, and extended word by word to the ends of what both have in common. Passages of at least `min_run` words
are reported under their first place, which is kept; passages unlike each other are never joined.

Nulls: a null text counts as empty. Rows are told apart by id and text, null ids are kept. Rows that
are equal count as one. Texts are read whole. Other columns are not read; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._shared import Tables, cut, map_batches, texts_of
from foliant.llm.minhash import A, B, M, bytes_of, confirmed, families, mix, shingle_hashes

BANDS, ROWS = 8, 3
MATCHES = 11  # of 24; a pair at 0.8 has fewer with a chance of one in 20,000

ANCHOR, AMONG = 12, 39  # words of an anchor, and runs among which it is chosen
PARAGRAPH = pa.struct([("number", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("n_shingles", pa.int64()), ("c", pa.binary()), ("bands", pa.binary()), ("signature", pa.binary())])
FOUND = pa.struct([("s", pa.int64()), ("u", pa.int64()), ("at", pa.int32()), ("next", pa.int32())])
B64, B64_INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
LONG = 64  # bytes of a word that is hashed by itself beyond
LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
AT_ONCE = 1 << 19  # bytes of texts


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def lists_of(counts: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def split_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places at which words open and close; words are runs of bytes other than ASCII white space."""
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], IS_SPACE[b], [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def hashes_of(raw: bytes, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z: eight bytes at a time of all words at once, long words each by itself."""
    raw = raw.lower() + bytes(8)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    size = closes - opens
    h = size.astype(np.uint64)
    short = live = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        if not len(live):
            break
        h[live] = mix(h[live] * M[0] + (lanes[opens[live] + k] & LANE[np.minimum(size[live] - k, 8)]))
        live = live[size[live] > k + 8]
    if len(short) < len(size):
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[opens[i] : closes[i]])
    return h


def anchors_of(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the words from the anchor to the end of the next one, place, the next one's) of each anchor
    of texts with `counts` words each, and the anchors of each text."""
    h = run_hashes(w, ANCHOR)
    of, firsts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    n = max(0, len(h) - AMONG + 1)
    at = chosen(h, AMONG, of[:n] == of[len(w) - n :])
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(mix(w) * powers(len(w), B64), out=sums[1:])
    text = of[at]
    goes_on = np.append(text[1:] == text[:-1], np.zeros(len(at[:1]), bool))
    following = np.where(goes_on, np.append(at[1:], at[-1:]), at)
    return h[at], mix((sums[following + ANCHOR] - sums[at]) * powers(len(w), B64_INVERSE)[at]), at - firsts[text], following - firsts[text], np.bincount(text, minlength=len(counts))


def sets_of(w: np.ndarray, k: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each) of the sets of five-word shingles of the runs of `size` words from k on, sorted
    and distinct; of the whole run where it is shorter."""
    counts = np.maximum(size - 4, 1).astype(np.int64)
    at = np.cumsum(counts) - counts
    every = np.zeros(counts.sum(), np.uint64)
    if len(w) >= 5:
        runs = shingle_hashes(w, 5)
        every = runs[np.minimum(np.repeat(k - at, counts) + np.arange(len(every)), len(runs) - 1)]
    for i in np.flatnonzero(size < 5).tolist():
        every[at[i]] = shingle_hashes(w[k[i] : k[i] + size[i]], int(size[i]))[0]
    for x, y in zip(at.tolist(), (at + counts).tolist(), strict=True):
        every[x:y].sort()
    new = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    new[at] = True
    return every[new], np.add.reduceat(new, at, dtype=np.int64) if len(at) else counts


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def read(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(id, h, paragraphs, anchors) of each text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_of(batch.column("text"))
        raw = b"\n".join(texts)  # all lines of all texts
        opens, closes = split_words(raw)
        w = hashes_of(raw, opens, closes)
        b = np.frombuffer(raw, np.uint8)
        breaks, inner = np.flatnonzero(b == 10), np.flatnonzero((b & 0xC0) == 0x80)
        starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(raw))
        sizes = np.array([len(t) for t in texts]) + 1
        begins = np.cumsum(sizes) - sizes
        first = np.searchsorted(opens, starts)
        words = np.searchsorted(opens, ends) - first
        held = np.flatnonzero(words >= max(1, min_words))
        k, size = first[held], words[held]
        text = np.searchsorted(begins, starts[held], "right") - 1
        number = held - np.searchsorted(starts, begins)[text]
        start, end, zero = (x - np.searchsorted(inner, x) for x in (starts[held], ends[held], begins[text]))
        n = len(held)
        every, counts = sets_of(w, k, size)
        at = np.cumsum(counts) - counts
        least, digests = np.zeros((n, BANDS * ROWS), np.uint64), []
        if n:
            for c in range(BANDS * ROWS):
                least[:, c] = np.minimum.reduceat(every * A[c] + B[c], at) >> np.uint64(32)
            view = memoryview(every).cast("B")
            digests = [xxhash.xxh3_128_digest(view[8 * x : 8 * y]) for x, y in zip(at.tolist(), (at + counts).tolist(), strict=True)]
        band = np.zeros((n, BANDS), np.uint64)
        for c in range(ROWS):
            band = mix(band + least[:, c::ROWS])
        sketch = (mix(least) & np.uint64(255)).astype(np.uint8)
        columns = [*(pa.array(x.astype(np.int32)) for x in (number, start - zero, end - zero, size)), pa.array(counts), pa.array(digests, pa.binary()), binaries(band.astype(np.uint32)), binaries(sketch)]
        s, u, place, following, anchored = anchors_of(w, np.diff(np.searchsorted(opens, np.append(begins, len(raw)))))
        anchors = pa.StructArray.from_arrays([pa.array(s.view(np.int64)), pa.array(u.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(following.astype(np.int32))], fields=list(FOUND))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), lists_of(np.bincount(text, minlength=len(texts)), pa.StructArray.from_arrays(columns, fields=list(PARAGRAPH))), lists_of(anchored, anchors)], ["id", "h", "paragraphs", "anchors"])

    return map_batches(docs, kernel, f"id {kind}, h long, paragraphs array<struct<number:int,start:int,end:int,words:int,n_shingles:long,c:binary,bands:binary,signature:binary>>, anchors array<struct<s:long,u:long,at:int,next:int>>", AT_ONCE)


def run_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(w) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, at, power, width, rest = None, 0, w, 1, size
    while rest:
        if rest & 1:
            part = power[at : at + n]
            out, at = part if out is None else mix(out * M[0] + part), at + width
        rest >>= 1
        if rest:
            power, width = mix(power[:-width] * M[0] + power[width:]), 2 * width
    return out


def chosen(h: np.ndarray, among: int, whole: np.ndarray) -> np.ndarray:
    """Places of the least hash of every `among` neighbours, the last of equal ones. whole: for each place,
    whether the neighbours from there on are those of one text."""
    if len(h) < among:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(h)), 1
    while width < among:
        step = min(width, among - width)
        a, b = h[:-step], h[step:]
        at, h, width = np.where(b <= a, at[step:], at[:-step]), np.minimum(a, b), width + step
    at = at[whole]  # rises from window to window
    return at[np.append(np.ones(len(at[:1]), bool), at[1:] != at[:-1])]


def reach(text: str, p: np.ndarray, q: np.ndarray, begins: Sequence[int] | np.ndarray = (0,), of: np.ndarray | int = 0) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs from the anchor at p to the one at q: the text of the AMONG words before and behind, and the
    character and line at which they start and those at which they end. text: one, or several joined by line
    ends, which begin at the bytes `begins`; of: that of each run, from whose start all places count."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    opens, closes = split_words(raw)
    breaks, inner = np.flatnonzero(b == 10), np.flatnonzero((b & 0xC0) == 0x80)
    first, zero = np.searchsorted(opens, np.append(begins, len(raw))), np.asarray(begins)[of]
    p, last = first[of] + p, first[of] + q + ANCHOR - 1
    start, end = opens[p], closes[last]
    lead, trail = opens[np.maximum(first[of], p - AMONG)], closes[np.minimum(first[of + 1] - 1, last + AMONG)]
    before = [raw[x:y] for x, y in zip(lead.tolist(), start.tolist(), strict=True)]
    behind = [raw[x:y] for x, y in zip(end.tolist(), trail.tolist(), strict=True)]
    chars = lambda x: x - np.searchsorted(inner, x)
    line = lambda x: np.searchsorted(breaks, x) - np.searchsorted(breaks, zero)
    return before, behind, chars(start) - chars(zero), line(start), chars(end) - chars(zero), line(opens[last])


class Parts(NamedTuple):
    """Short texts, their words numbered through."""

    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word of each, and one behind the last
    opens: np.ndarray  # of each word, and one behind the last
    closes: np.ndarray
    words: np.ndarray  # hashes
    breaks: np.ndarray
    inner: np.ndarray  # bytes of a character but its first

    @classmethod
    def of(cls, texts: list[bytes]) -> Parts:
        raw = b"\n".join(texts)
        b = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        opens, closes = split_words(raw)
        first = np.searchsorted(opens, np.append(ends - sizes, len(raw)))
        return cls(ends - sizes, ends, first, np.append(opens, len(raw)), np.append(closes, len(raw)), hashes_of(raw, opens, closes), np.flatnonzero(b == 10), np.flatnonzero((b & 0xC0) == 0x80))

    def between(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and line ends."""
        inner, breaks = (np.searchsorted(v, y) - np.searchsorted(v, x) for v in (self.inner, self.breaks))
        return y - x - inner, breaks


def agreeing(a: Parts, b: Parts, backwards: bool) -> np.ndarray:
    """How many of the first words, or of the last, are equal in the texts of a and b at one place."""
    most = np.minimum(np.diff(a.first), np.diff(b.first))
    x, y, way = (a.first[1:] - 1, b.first[1:] - 1, -1) if backwards else (a.first[:-1], b.first[:-1], 1)
    out, live = np.zeros(len(most), np.int64), np.flatnonzero(most > 0)
    while len(live):
        n = out[live]
        live = live[a.words[x[live] + way * n] == b.words[y[live] + way * n]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def stretched(lead: bytes | Parts, trail: bytes | Parts, start: np.ndarray, line: np.ndarray, end: np.ndarray, last_line: np.ndarray, before: np.ndarray, behind: np.ndarray, at: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first line, last line) of a run with so many words more at its ends; lead, trail: the text
    before and behind it, or those of many runs, of which the ones `at` are asked for."""
    lead, trail = (Parts.of([x]) if isinstance(x, bytes) else x for x in (lead, trail))
    chars, lines = lead.between(np.where(before, lead.opens[lead.first[at + 1] - before], lead.ends[at]), lead.ends[at])
    more, below = trail.between(trail.begins[at], np.where(behind, trail.closes[trail.first[at] + behind - 1], trail.begins[at]))
    return start - chars, end + more, line - lines, last_line + below


def repeated_runs(source: DataFrame, anchors: DataFrame, kind: str, min_run: int, keep: Tables) -> DataFrame:
    """(id, h, number, start, end, words, first_id, first_h, first_number, itself, alone): each maximal run of
    min_run words or more, over any lines, that stands word for word at its first place, or stands there itself
    and elsewhere too. alone: the run and its first place each lie within one line. anchors: id, h, s, u, at, next."""
    at = F.struct("id", "h", "at", "u")
    # stored, so that the join reads both sides from shuffles and an anchor that very many places have can be dealt anew
    firsts = keep(anchors.groupBy("s").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = anchors.join(firsts, "s").where("not (id <=> first.id and h = first.h and at = first.at)")
    met = met.select("id", "h", "at", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), (F.col("first.at") - F.col("at")).alias("shift"), F.when(F.col("u") == F.col("first.u"), F.col("next")).alias("goes_on"))
    own = Window.partitionBy("id", "h", "first_id", "first_h", "shift").orderBy("at")  # anchors of one document
    chain = met.withColumn("begins", F.coalesce(F.lag("goes_on").over(own) != F.col("at"), F.lit(True)).cast("int")).withColumn("run", F.sum("begins").over(own))
    key = ["id", "h", "first_id", "first_h", "shift"]
    runs = keep(chain.groupBy(*key, "run").agg(F.min("at").alias("p"), F.max("at").alias("q")).drop("run"))
    theirs = runs.select(F.col("first_id").alias("id"), F.col("first_h").alias("h"), (F.col("p") + F.col("shift")).alias("p"), (F.col("q") + F.col("shift")).alias("q"))
    wanted = runs.select("id", "h", "p", "q").unionByName(theirs).groupBy("id", "h").agg(F.collect_set(F.struct("p", "q")).alias("places"))
    fields = [("p", "int"), ("q", "int"), ("before", "binary"), ("behind", "binary"), *((n, "int") for n in ("start", "line", "end", "last_line"))]
    reached = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.binary()) for n, t in fields]))

    def reaching(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, texts = batch.column("places"), texts_of(batch.column("text"))
        p, q = (x.to_numpy() for x in places.flatten().flatten())
        counts, sizes = places.value_lengths().to_numpy(), np.array([len(t.encode()) for t in texts]) + 1
        before, behind, *numbers = reach("\n".join(texts), p, q, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), counts))
        values = [pa.array(p), pa.array(q), pa.array(before, pa.binary()), pa.array(behind, pa.binary()), *(pa.array(x.astype(np.int32)) for x in numbers)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), lists_of(counts, pa.StructArray.from_arrays(values, fields=list(reached.value_type)))], ["id", "h", "reached"])

    row = F.struct("id", "h").alias("row")  # equal with a null id too; joined and told apart by one key, texts are dealt out once
    here = wanted.select(row, "places").join(source.select(row, "text"), "row").dropDuplicates(["row"])
    ends = map_batches(here.select("row.id", "row.h", "text", "places"), reaching, f"id {kind}, h long, reached array<struct<{','.join(f'{n}:{t}' for n, t in fields)}>>", AT_ONCE)
    ends = keep(ends.select("id", "h", F.explode("reached").alias("x")).select("id", "h", "x.p", "x.q", F.struct("x.before", "x.behind", "x.start", "x.line", "x.end", "x.last_line").alias("x")))
    a, b = ends.toDF("a_id", "a_h", "a_p", "a_q", "a"), ends.toDF("b_id", "b_h", "b_p", "b_q", "b")
    pairs = runs.join(a, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")) & (F.col("p") == F.col("a_p")) & (F.col("q") == F.col("a_q")))
    pairs = pairs.join(b, F.col("first_id").eqNullSafe(F.col("b_id")) & (F.col("first_h") == F.col("b_h")) & (F.col("p") + F.col("shift") == F.col("b_p")) & (F.col("q") + F.col("shift") == F.col("b_q")))

    def extended(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, q = (batch.column(c).to_numpy() for c in ("p", "q"))
        sides = [batch.column(c).flatten() for c in ("a", "b")]
        (lead, trail), (first_lead, first_trail) = ([Parts.of(c.to_pylist()) for c in x[:2]] for x in sides)
        before, behind = agreeing(lead, first_lead, True), agreeing(trail, first_trail, False)
        words = q + ANCHOR + behind - p + before
        rows = np.flatnonzero(words >= min_run)
        p, words, before, behind = (x[rows] for x in (p, words, before, behind))
        own, theirs = ([c.to_numpy()[rows] for c in x[2:]] for x in sides)
        columns = [p - before, words, *stretched(lead, trail, *own, before, behind, rows), *stretched(first_lead, first_trail, *theirs, before, behind, rows)]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in key), *(pa.array(c.astype(np.int32)) for c in columns)], [*key, *placed])

    placed = ["begin", "words", "start", "end", "line", "last_line", "first_start", "first_end", "first_line", "first_last_line"]
    schema = f"id {kind}, h long, first_id {kind}, first_h long, shift int, " + ", ".join(f"{c} int" for c in placed)
    long_ = keep(map_batches(pairs.select(*key, "p", "q", "a", "b"), extended, schema, AT_ONCE))

    def merged(rows: DataFrame, of: list[str], line: list[Column]) -> DataFrame:
        """Of runs of one kind in a document that overlap, one."""
        order = Window.partitionBy(*of).orderBy("start", F.col("end").desc())
        past = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(past), F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(order))
        far = F.struct("begin_end", "end", "last_line", "first_last_line")
        rows = rows.withColumn("begin_end", F.col("begin") + F.col("words"))
        rows = rows.groupBy(*of, "span").agg(F.min(F.struct("begin", "start", "line", "first_line")).alias("x"), F.max(far).alias("y"))
        return rows.select(*line, F.col("x.line").alias("number"), "x.start", "y.end", (F.col("y.begin_end") - F.col("x.begin")).alias("words"), F.col("x.first_line").alias("first_number"), ((F.col("x.line") == F.col("y.last_line")) & (F.col("x.first_line") == F.col("y.first_last_line"))).alias("alone"))

    copies = merged(long_, key, [F.col(c) for c in key[:4]]).withColumn("itself", F.lit(False))
    heads = long_.select(F.col("first_id").alias("id"), F.col("first_h").alias("h"), (F.col("begin") + F.col("shift")).alias("begin"), "words", F.col("first_start").alias("start"), F.col("first_end").alias("end"), F.col("first_line").alias("line"), F.col("first_last_line").alias("last_line"), "first_line", "first_last_line").distinct()
    heads = merged(heads, ["id", "h"], [F.col("id"), F.col("h"), F.col("id").alias("first_id"), F.col("h").alias("first_h")]).withColumn("itself", F.lit(True))
    return keep(copies.unionByName(heads))


def with_sets(rows: DataFrame) -> DataFrame:
    columns = ["component", "c", "total", "n_shingles", "signature"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = Parts.of(bytes_of(batch.column("paragraph")))
        every, counts = sets_of(parts.words, parts.first[:-1], np.diff(parts.first))
        ends = np.concatenate([[0], np.cumsum(counts)]) * 8
        sets = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(every)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), sets], [*columns, "shingles"])

    return map_batches(rows.select(*columns, "paragraph"), kernel, "component long, c long, total long, n_shingles long, signature binary, shingles binary", AT_ONCE)


def clustered(source: DataFrame, found: DataFrame, percent: int, keep: Tables) -> DataFrame:
    """(id, h, number, start, end, n_words, first_id, first_h, first_number) of paragraphs that have a copy or a
    near copy. found: a row for each paragraph of each different row."""
    classes = found.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "h", "number", "start", "end")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = keep(classes.withColumnRenamed("c", "set_hash").withColumn("c", F.monotonically_increasing_id()))  # of the stored table, so that it stays
    posts = classes.select("c", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(bands, 4 * i + 1, 4))")).alias("k", "v")).select("c", F.xxhash64("k", "v").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
    members = classes.select("c", "n_shingles", "signature")
    joined = families(posts.join(shared, "key").join(members, "c"), percent / 100, MATCHES, keep)
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    family = joined.withColumnRenamed("id", "c").join(sizes, "component").join(classes.select("c", "n_shingles", "signature", "at.start", "at.end", F.col("at.id").alias("doc"), F.col("at.h").alias("doc_h")), "c")
    texts = source.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "text")
    texts = family.join(texts, F.col("doc").eqNullSafe(F.col("__id")) & (F.col("doc_h") == F.col("__h")))
    # only the paragraph goes on, not its text
    texts = texts.select("component", "c", "total", "n_shingles", "signature", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("paragraph")).dropDuplicates(["c"])
    clusters = keep(confirmed(keep(with_sets(texts)), percent, MATCHES, keep)).toDF("c", "cluster")
    whole = classes.select("set_hash", "c", "copies").join(clusters, "c", "left").where("copies > 1 or cluster is not null").select(F.col("set_hash").alias("c"), F.coalesce("cluster", "c").alias("cluster"))
    rows = keep(found.select("id", "h", "number", "start", "end", "words", "c").join(whole, "c"))
    firsts = rows.groupBy("cluster").agg(F.min(F.struct("id", "h", "number")).alias("first"))
    return keep(rows.join(firsts, "cluster").select("id", "h", "number", "start", "end", F.col("words").cast("long").alias("n_words"), F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), F.col("first.number").alias("first_number")))


def once(rows: DataFrame, keep: Tables) -> DataFrame:
    """One of the rows of each id and h; rows: id, h, row, ... What they hold is dealt out only where some repeat."""
    again = keep(rows.groupBy("id", "h").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("h").alias("__h"), "least"))
    if again.isEmpty():
        return rows
    own = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")) & (F.col("row") > F.col("least"))
    return keep(rows.join(again, own, "left_anti"))


def repeated_passages(docs: DataFrame, min_words: int = 25, percent: int = 80, min_run: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, start, end, n_words, cluster_doc, cluster_paragraph, kept) of each paragraph, or passage
    over lines or within them, that stands elsewhere too; start and end count characters of the text.
    min_words: of a paragraph. min_run: of a passage, at least ANCHOR + AMONG - 1."""
    if min_run < ANCHOR + AMONG - 1:
        raise ValueError(f"passages of fewer than {ANCHOR + AMONG - 1} words aren't all found")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    with Tables(docs.sparkSession) as lasting:
        every = once(lasting(read(source, kind, min_words).withColumn("row", F.monotonically_increasing_id())), lasting)
        with Tables(docs.sparkSession) as keep:
            entire = lasting(clustered(source, every.select("id", "h", F.explode("paragraphs").alias("x")).select("id", "h", "x.*"), percent, keep))
        entire = entire.withColumn("kept", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")) & (F.col("number") == F.col("first_number")))
        with Tables(docs.sparkSession) as keep:
            runs = lasting(repeated_runs(source, every.select("id", "h", F.explode("anchors").alias("x")).select("id", "h", "x.*"), kind, min_run, keep))
        lines = entire.select(F.col("id").alias("l_id"), F.col("h").alias("l_h"), F.col("number").alias("l_number"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
        within = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")) & (F.col("number") == F.col("l_number")) & (F.col("start") >= F.col("l_start")) & (F.col("end") <= F.col("l_end"))
        runs = runs.join(lines, within, "left_anti")
        # where the first place is within a paragraph that has a cluster, that one's
        heads = entire.select(F.col("id").alias("e_id"), F.col("h").alias("e_h"), F.col("number").alias("e_number"), F.col("first_id").alias("e_first_id"), F.col("first_h").alias("e_first_h"), F.col("first_number").alias("e_first_number"))
        headed = F.col("first_id").eqNullSafe(F.col("e_id")) & (F.col("first_h") == F.col("e_h")) & (F.col("first_number") == F.col("e_number")) & F.col("alone")
        runs = runs.join(heads, headed, "left")
        pick = lambda new, old: F.when(F.col("e_h").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
        runs = runs.select("id", "number", "start", "end", F.col("words").cast("long").alias("n_words"), pick("e_first_id", "first_id"), pick("e_first_number", "first_number"), F.col("itself").alias("kept"))
        out = entire.select(*runs.columns).unionByName(runs)
        return cut(out.select(F.col("id").alias(id_col), F.col("number").alias("paragraph"), "start", "end", "n_words", F.col("first_id").alias("cluster_doc"), F.col("first_number").alias("cluster_paragraph"), "kept"))
