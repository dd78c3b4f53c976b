"""I-Match fingerprints, in DataFrame operations alone.

A lexicon is made of terms whose inverse document frequency lies in a band: not the commonest, which
say nothing, nor the rare ones, which edits and typing errors add. A text's distinct lexicon terms,
sorted, are hashed for several randomised subsets of the lexicon of different sizes; the list of these
hashes is the fingerprint. The likeness of two fingerprints is the share of equal hashes among the
subsets of which either text holds a term. A text without any lexicon term has the hash of all its
distinct terms as its fingerprint, alike only to its equals.

The lexicon holds every term of the band. Its size is bounded whatever the corpus: terms in at least a
share s of the documents number at most (mean distinct terms a document) / s. It is made from all
documents, and joined as one row of numbers, dealt to slots, so that a term is looked for in one slot.

Nulls: a null text counts as empty; an empty text's fingerprint is that of no terms. Rows with a null
id, ties and repeated rows keep their own rows. Texts are used whole. Other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
#: Randomised subsets of the lexicon: {one in this many of its terms: so many subsets}.
RATES = {1: 1, 2: 2, 4: 3, 8: 4, 16: 6, 32: 8, 64: 8, 128: 8}


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def band_terms(docs: DataFrame, text_col: str = "text", least_share: float = 0.002, most_share: float = 0.2) -> DataFrame:
    """(term, n, docs): every term of the band, with the number of documents that have it."""
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(F.broadcast(total), (F.col("n") >= F.greatest(F.lit(2.0), F.col("docs") * least_share)) & (F.col("n") <= F.greatest(F.lit(3.0), F.col("docs") * most_share)))


def slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def slots(docs: DataFrame, text_col: str = "text", **band: float) -> DataFrame:
    """One row: lexicon, an array of SLOTS arrays that hold all terms of the band."""
    filled = band_terms(docs, text_col, **band).groupBy(slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("held"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    dense = every.join(filled, "slot", "left").select("slot", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("slot", "held"))).alias("x")).select(F.col("x.held").alias("lexicon"))


def dealt(rate: int, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A test of the subset to which a term is dealt."""
    return lambda t: test(F.pmod(F.xxhash64(t, F.lit(rate)), F.lit(rate)))


def subsets(own: Column, some: Callable[[int], Column]) -> Column:
    """The terms of each subset of the lexicon. own: the text's lexicon terms, sorted; some: of a rate with fewer
    subsets than it could have, those of them that are in any.

    The subsets of one rate are disjoint: a hash of the term deals it to one of `rate` subsets, of which the
    first ones count. So terms that are in none of a rate's subsets are passed over once for all of them."""
    parts = []
    for rate, count in RATES.items():
        held = own if count >= rate else some(rate)
        parts += [held if rate == 1 else F.filter(held, dealt(rate, lambda d: d == k)) for k in range(count)]  # noqa: B023
    return F.array(*parts)


def as_text(subsets: Column) -> Column:
    return F.array_join(F.transform(subsets, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    same_kind = F.size(a) == F.size(b)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    told = F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    equal = F.filter(told, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))
    return F.when(same_kind & (F.size(told) > 0), F.size(equal) / F.size(told)).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band: float) -> DataFrame:
    """(id, fingerprint) of every row."""
    return with_hashes(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), {"own": "__text"}, slots(docs, text_col, **band)).select(F.col("__id").alias(id_col), as_text(F.col("own")).alias("fingerprint"))


def with_hashes(df: DataFrame, texts: dict[str, str], words: DataFrame) -> DataFrame:
    """df with a column for each text column named in texts: a hash, or null, for each subset of the lexicon.

    Each step is a projection of its own, as Spark computes anew what one expression names twice."""
    df = df.withColumns({f"__all_{name}": terms(F.col(col)) for name, col in texts.items()})
    df = df.join(F.broadcast(words))  # one row of bounded size
    df = df.withColumns({f"__in_{name}": F.array_sort(F.filter(f"__all_{name}", lambda t: F.array_contains(F.element_at("lexicon", slot(t) + 1), t))) for name in texts}).drop("lexicon")
    df = df.withColumns({f"__some_{name}_{rate}": F.filter(f"__in_{name}", dealt(rate, lambda d: d < count)) for name in texts for rate, count in RATES.items() if count < rate})  # noqa: B023
    df = df.withColumns({f"__held_{name}": subsets(F.col(f"__in_{name}"), lambda rate: F.col(f"__some_{name}_{rate}")) for name in texts})  # noqa: B023
    each = lambda held, k: F.when(F.size(held) > 0, F.xxhash64(held, k))
    alone = lambda name: F.array(F.xxhash64(F.array_sort(f"__all_{name}"), F.lit(-1)))
    return df.withColumns({name: F.when(F.size(f"__in_{name}") > 0, F.transform(f"__held_{name}", each)).otherwise(alone(name)) for name in texts})


FAN = 32


def place_among(bounds: list, x: Column) -> Column:
    """How many of the ascending bounds are at most x, found in steps of one in FAN."""
    levels = [bounds]
    while len(levels[0]) > FAN:
        levels.insert(0, levels[0][FAN - 1 :: FAN])
    at = F.lit(0)
    for level in levels:
        part = F.slice(F.array(*[F.lit(b) for b in level]), at * FAN + 1, F.lit(FAN)) if len(levels) > 1 else F.array(*[F.lit(b) for b in level])
        at = at * FAN + F.size(F.filter(part, lambda b: b <= x))
    return at


def with_next(rows: DataFrame, ids: DataFrame, more: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """rows, which have __id and __text, with the columns that `more` adds from the text and with
    __next_<column> for __text and each of them: that of the next document in descending id, after the last
    that of the first.

    Documents are dealt to buckets of neighbouring ids by approximate quantiles, half the root of their number
    of buckets, so that neither a bucket nor the list of bounds grows as fast as the rows; each bucket also
    gets the first document of the bucket below it. Rows of one id follow each other by their text. Null ids
    come last, dealt by their texts. ids: the column __id alone, of which quantiles are taken."""
    buckets = max(1, math.isqrt(ids.count()) // 2)
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(ids.agg(F.percentile_approx("__id", shares, max(10000, 4 * buckets)).alias("q")).head()["q"] or [])) if shares else []
    none = F.col("__id").isNull()
    bucket = F.when(none, -1 - F.pmod(F.xxhash64("__text"), F.lit(buckets))).otherwise(place_among(bounds, F.col("__id")) if bounds else F.lit(0)).cast("long")
    rows = rows.withColumn("__bucket", bucket)
    order = F.struct(F.coalesce(F.col("__id").cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")), F.coalesce("__text", F.lit("")))
    heads = rows.groupBy("__bucket").agg(F.max_by(F.coalesce("__text", F.lit("")), order).alias("head"))
    # a row for each bucket: the head of the one below goes to the end of the one above, that of the first to the last
    down = Window.orderBy(F.col("__bucket").desc())
    above = heads.withColumn("__to", F.coalesce(F.lag("__bucket").over(down), F.min("__bucket").over(Window.partitionBy())))
    values = {"__text": F.col("head"), "__bucket": F.col("__to")}
    ghosts = above.select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema], F.lit(True).alias("__ghost"))
    everything = rows.withColumn("__ghost", F.lit(False)).unionByName(ghosts)
    everything = more(everything).select(*everything.columns, *columns)
    following = Window.partitionBy("__bucket").orderBy(F.col("__ghost"), F.col("__id").desc_nulls_last(), F.col("__text").desc_nulls_last())
    return everything.withColumns({f"__next_{c}": F.lead(c).over(following) for c in ("__text", *columns)}).where("not __ghost").drop("__ghost", "__bucket")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band: float) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the start of the next
    document's, and their likeness to each other and to the next document's. Ids are numbers."""
    words = slots(docs, text_col, **band)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    rows = with_next(rows, rows.select("__id"), lambda every: with_hashes(every, {"__own": "__text"}, words), "__own")
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - half), F.substring(F.col("__next___text"), F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "__edited": edited})
    done = with_hashes(rows, {"__changed": "__edited"}, words)
    own, changed, following = F.col("__own"), F.col("__changed"), F.col("__next___own")
    return done.select(F.col("__id").alias(id_col), "n_chars", F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"))
