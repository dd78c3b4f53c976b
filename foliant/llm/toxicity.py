"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Fitting. Labels say which documents are toxic, not which words. Words, and beginnings of words, that
significantly many toxic and hardly any clean documents hold mark the tokens of a bounded sample of
labelled documents; the field, two tags with features of each token and its neighbours, is fitted to
those tokens by gradient ascent on its conditional likelihood. Forward-backward marginals give each
document's greatest and summed probability of toxic tokens; a logistic regression on these, fitted to
the labels, makes the score.

Scoring. Whole texts; marginals of all tokens of an Arrow batch are computed at once, by products of
2 x 2 matrices over blocks of tokens.

Nulls: a null text counts as empty, an empty text has the score of no evidence. Labels that are null
are not used; a document with several labels is toxic if one says so. Repeated rows give equal rows.
Texts may be of any length. With no labelled row of one kind all scores are 0."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import PORTION, hold, map_batches, texts_of

WORD = re.compile(r"[^\W_]+")
PLAINER = str.maketrans("013457", "oieast")  # digits that stand for letters
BLOCK = 64


def plain(word: str) -> str:
    if word.isdigit():
        return "0"
    return word.lower() if word.isalpha() else word.lower().translate(PLAINER)


SIZES, CASES = [f"n{k}" for k in range(10)], ["u0", "u1", "u2"]


def features(word: str) -> list[str]:
    w = plain(word)
    n = len(w)
    out = ["w" + w, "z" + w[-3:], SIZES[n] if n < 9 else "n9", CASES[word[:1].isupper() + word.isupper()]]
    for k in range(3, n if n < 10 else 10):
        out.append("p" + w[:k])
    return out


def marks(word: str) -> list[str]:
    """What may mark a toxic token: the word, or a beginning of at least four letters."""
    w = word.lower().translate(PLAINER)
    return ["w" + w, *("p" + w[:k] for k in range(4, 10) if len(w) > k)]


@dataclass
class Model:
    unary: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    arc: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # log weights of clean-clean, clean-toxic, toxic-clean, toxic-toxic
    bias: tuple[float, ...] = (-9.0, 0.0, 0.0)


def chain(products: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) M_0 ... M_i, each scaled to sum 1, for matrices M: (n, 2, 2) of positive entries."""
    n = len(products)
    rows = -(-n // BLOCK)
    entries = []
    for i in (0, 1):
        for j in (0, 1):
            x = np.full(rows * BLOCK, float(i == j))
            x[:n] = products[:, i, j]
            entries.append(np.ascontiguousarray(x.reshape(rows, BLOCK).T))  # a row for each place in the blocks
    a, b, c, d = entries
    for k in range(1, BLOCK):  # running products, in place
        p, q, r, s = a[k - 1], b[k - 1], c[k - 1], d[k - 1]
        w, x, y, z = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        scale = 1 / (w + x + y + z)
        a[k], b[k], c[k], d[k] = w * scale, x * scale, y * scale, z * scale
    u, v, starts = 0.5, 0.5, []
    for w, x, y, z in zip(a[-1].tolist(), b[-1].tolist(), c[-1].tolist(), d[-1].tolist(), strict=True):
        starts.append(u)
        u, v = u * w + v * y, u * x + v * z
        s = u + v
        u, v = u / s, v / s
    left = np.array(starts)
    right = 1 - left
    one, two = left * a + right * c, left * b + right * d
    total = one + two
    return np.stack([(one / total).T.reshape(-1)[:n], (two / total).T.reshape(-1)[:n]], axis=1)


def marginals(score: np.ndarray, first: np.ndarray, arc: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token; P(tags of token i - 1 and i), unless i is first; and the matrices.

    score: log odds of toxic by the features; first: whether a document begins there."""
    n = len(score)
    e = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], axis=1)
    t = np.exp(np.array(arc).reshape(2, 2) - max(arc))
    m = t[None] * e[:, None, :]
    m[first] = np.broadcast_to(e[first][:, None, :], (int(first.sum()), 2, 2))
    alpha = chain(m)
    back = np.empty((n, 2))
    back[-1] = 0.5
    if n > 1:
        back[:-1] = chain(np.ascontiguousarray(m[:0:-1].transpose(0, 2, 1)))[::-1]
    p = alpha * back
    p = p[:, 1] / p.sum(axis=1)
    pairs = np.zeros((n, 2, 2))
    if n > 1:
        pairs[1:] = alpha[:-1, :, None] * m[1:] * back[1:, None, :]
        pairs[1:] /= pairs[1:].sum(axis=(1, 2), keepdims=True)
        pairs[first] = 0
    return p, pairs, m


BESIDE = 30  # tokens


def fit_field(docs: list[list[str]], tags: list[np.ndarray], rounds: int = 30, rate: float = 0.25, decay: float = 1e-4) -> Model:
    """Gradient ascent with per-weight step sizes on the mean conditional log likelihood of the tags."""
    kinds: dict[str, int] = {}
    names: dict[str, int] = {}
    of_kind: list[tuple[int, int]] = []
    ids, first, y = [], [], []
    for words, tag in zip(docs, tags, strict=True):
        if not words:
            continue
        first.append(len(ids))
        for w in words:
            k = kinds.get(w)
            if k is None:
                k = kinds[w] = len(kinds)
                of_kind += [(k, names.setdefault(f, len(names))) for f in features(w)]
            ids.append(k)
        y.append(tag)
    n = len(ids)
    token = np.array(ids)
    start = np.zeros(n, bool)
    start[first] = True
    stop = np.roll(start, -1)
    truth = np.concatenate(y).astype(float)
    pair_kind, pair_feature = np.array(of_kind).T
    w = np.zeros((3, len(names)))
    arc, arc_g = np.zeros(4), np.full(4, 1e-6)
    seen = np.full(w.shape, 1e-8)
    inner = ~start
    gold = np.zeros(4)
    np.add.at(gold, (2 * truth[:-1] + truth[1:]).astype(int)[inner[1:]], 1)
    # words that stand beside few tokens say nothing of those
    common = np.bincount(pair_feature, np.bincount(token, minlength=len(kinds))[pair_kind], len(names))
    told = np.array([np.ones(len(names), bool), common >= BESIDE, common >= BESIDE])
    weight = np.where(truth > 0, max(1.0, min(20.0, (n - truth.sum()) / max(truth.sum(), 1) / 10)), 1.0)  # toxic tokens are few
    for _ in range(rounds):
        by_kind = [np.bincount(pair_kind, w[k][pair_feature], len(kinds)) for k in range(3)]
        before = np.concatenate([[0], by_kind[1][token[:-1]]]) * inner
        after = np.concatenate([by_kind[2][token[1:]], [0]]) * ~stop
        p, pairs, _ = marginals(by_kind[0][token] + before + after, start, tuple(arc))
        r = (truth - p) * weight
        for k, (shifted, at) in enumerate(((r, token), (r[1:] * inner[1:], token[:-1]), (r[:-1] * ~stop[:-1], token[1:]))):
            g = np.bincount(pair_feature, np.bincount(at, shifted, len(kinds))[pair_kind], len(names)) - decay * n * w[k] / max(len(names), 1)
            g *= told[k]
            seen[k] += g * g
            w[k] += rate * g / np.sqrt(seen[k])
        g = gold - pairs.sum(axis=0).reshape(4)
        arc_g += g * g
        arc += rate * g / np.sqrt(arc_g)
    keep = [{f: float(w[k][i]) for f, i in names.items() if abs(w[k][i]) > 0.02} for k in range(3)]
    return Model(*keep, arc=tuple(float(x) for x in arc))


class Scorer:
    """A model with the scores of words it has met, about 300,000 at most."""

    def __init__(self, model: Model):
        self.model, self.known, self.values, self.n = model, {}, np.zeros((3, 1 << 12)), 0
        parts = (model.unary, model.before, model.after)
        self.weights = {f: tuple(p.get(f, 0.0) for p in parts) for f in set().union(*parts)}

    def _index(self, word: str) -> int:
        if self.n == self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)], axis=1)
        u = b = a = 0.0
        get = self.weights.get
        for f in features(word):
            w = get(f)
            if w is not None:
                u, b, a = u + w[0], b + w[1], a + w[2]
        self.values[:, self.n] = u, b, a
        if len(word) <= 64:
            self.known[word] = self.n
        self.n += 1
        return self.n - 1

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of the tokens of all texts, one after the other; how many tokens each text has."""
        if self.n > 300_000:
            self.known, self.n = {}, 0
        get, ids, counts = self.known.get, [], []
        for text in texts:
            found = WORD.findall(text)
            counts.append(len(found))
            here = list(map(get, found))
            if None in here:
                here = [self._index(w) if (i := get(w)) is None else i for w in found]
            ids += here
        sizes = np.array(counts, dtype=np.int64)
        if not ids:
            return np.zeros(0), sizes
        token = np.array(ids)
        first = np.zeros(len(token), bool)
        ends = np.cumsum(sizes)
        first[np.concatenate([[0], ends[:-1]])[sizes > 0]] = True
        u, b, a = self.values[:, token]
        score = u
        score[1:] += b[:-1] * ~first[1:]
        score[:-1] += a[1:] * ~first[1:]
        return marginals(score, first, self.model.arc)[0], sizes

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; P(toxic) of all tokens; tokens of each text."""
        p, sizes = self.tokens(texts)
        x = evidence(p, sizes)
        z = self.model.bias[0] + x @ np.array(self.model.bias[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p, sizes


def evidence(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The greatest marginal and the logarithm of the expected number of toxic tokens (from 0.05 each)."""
    out = np.zeros((len(sizes), 2))
    there = sizes > 0
    if len(p):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[there]
        out[there, 0] = np.maximum.reduceat(p, starts)
        out[there, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), starts))
    return out


def copies(texts: list[str]) -> list[int]:
    """A number for each text, the same for texts that share the least hash of their five-word runs under
    one of three hash functions: copies of one text are one piece of evidence, not many."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    owner: dict[tuple[int, int], int] = {}
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        runs = [zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(len(words) - 4, 1))]
        for salt in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35):
            least = min(r * salt % 4294967291 for r in runs)
            parent[root(i)] = root(owner.setdefault((salt, least), i))
    return [root(i) for i in range(len(texts))]


def seeds(texts: list[str], toxic: list[bool]) -> set[str]:
    """Marks that toxic documents hold far more often than chance would have it, and clean ones hardly."""
    inside: dict[str, set[int]] = defaultdict(set)
    outside: dict[str, set[int]] = defaultdict(set)
    groups = copies(texts)
    for text, bad, g in zip(texts, toxic, groups, strict=True):
        for m in {m for w in set(WORD.findall(text)) for m in marks(w)}:
            (inside if bad else outside)[m].add(g)
    n1, n0 = (len({g for g, bad in zip(groups, toxic, strict=True) if bad == k}) for k in (True, False))
    base = n1 / max(n1 + n0, 1)
    out = set()
    for m, held in inside.items():
        a, b = len(held), len(outside.get(m, ()))
        if a >= 4 and a / n1 >= 20 * b / max(n0, 1):
            share = a / (a + b)
            surprise = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)
            if surprise > 12:
                out.add(m)
    return out


def fit(texts: list[str], toxic: list[bool], field_rows: int = 300) -> Model:
    """A model from whole texts and their labels. field_rows: of either kind, documents whose tokens train the field."""
    if not any(toxic) or all(toxic):
        return Model(bias=(-30.0, 0.0, 0.0))
    marked, groups = seeds(texts, toxic), copies(texts)
    docs, tags, texts_at, left = [], [], [], {True: field_rows, False: field_rows}
    for at, (text, bad) in enumerate(zip(texts, toxic, strict=True)):
        if left[bad] > 0:
            words = WORD.findall(text)
            tag = np.array([bad and not marked.isdisjoint(marks(w)) for w in words], dtype=bool)
            if bad and not tag.any():
                continue
            left[bad] -= 1
            docs.append(words)
            tags.append(tag)
            texts_at.append(at)
    model = fit_field(docs, tags)
    # how sure a document's marginals make one is learnt from documents the field hasn't seen: half of the copies'
    # groups at a time
    x = np.zeros((len(texts), 2))
    fold = np.array([random.Random(g).random() < 0.5 for g in groups])
    for k in (False, True):
        own = [i for i in range(len(docs)) if fold[texts_at[i]] != k]
        part = fit_field([docs[i] for i in own], [tags[i] for i in own]) if any(tags[i].any() for i in own) else model
        scorer, rest = Scorer(part), np.flatnonzero(fold == k)
        for i in range(0, len(rest), 200):
            x[rest[i : i + 200]] = evidence(*scorer.tokens([texts[j] for j in rest[i : i + 200]]))
    y = np.array(toxic, float)
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(3)
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-a @ b))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.1, 0.1])
        b += np.linalg.solve(h, a.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * b)
    model.bias = tuple(float(v) for v in b)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column, rows_toxic: int = 1000, rows_clean: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample: at most rows_toxic and rows_clean labelled documents for which
    usable holds, chosen by a hash of their id. Only those texts come to the driver; of several rows under one id
    the least text counts. Without labels of both kinds nothing can be
    learnt, and every score is near 0."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
    known = known.withColumnRenamed("__id", id_col).where(usable).groupBy(F.col(id_col).alias("__id")).agg(F.max("__y").alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = [r for bad, n in ((1, rows_toxic), (0, rows_clean)) for r in known.where((F.col("__y") > 0) == bool(bad)).orderBy(*order).limit(n).collect()]
    if not chosen:
        return fit([], [])
    spark = docs.sparkSession
    few = spark.createDataFrame([(r["__id"], bool(r["__y"] > 0)) for r in chosen], f"__id {docs.schema[id_col].dataType.simpleString()}, __bad boolean")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(few), "__id")
    rows = texts.groupBy("__id").agg(F.first("__bad").alias("__bad"), F.min("__text").alias("__text")).collect()  # at most rows_toxic + rows_clean
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["__id"]).encode()), r["__text"] or ""))
    return fit([r["__text"] or "" for r in rows], [r["__bad"] for r in rows])


_scorers: dict[str, Scorer] = {}


def scorer_of(shared) -> Scorer:
    """The scorer of a broadcast model, one at a time in a worker; its words stay known between batches."""
    hold("toxicity", _scorers.clear)
    key = str(shared.value.bias) + str(shared.value.arc)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def filtered(docs: DataFrame, model: Model, below: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs, all columns, whose score is under `below`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, texts = scorer_of(shared), texts_of(batch.column(text_col))
        values = np.concatenate([scorer.documents(texts[i : i + 500])[0] for i in range(0, len(texts), 500)])
        return batch.filter(pa.array(values < below))

    return map_batches(docs, kernel, docs.schema, PORTION)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans_from: float = 0.5) -> DataFrame:
    """(id, score, spans): spans are the character offsets of runs of tokens with P(toxic) >= spans_from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample of fit_on allows

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, texts = scorer_of(shared), texts_of(batch.column(1))
        values, spans = [], []
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            s, p, sizes = scorer.documents(part)
            values += s.tolist()
            at = 0
            for text, n in zip(part, sizes.tolist(), strict=True):
                own: list[dict[str, int]] = []
                hot = np.flatnonzero(p[at : at + n] >= spans_from)
                if len(hot):
                    where = [m.span() for m in WORD.finditer(text)]
                    for k in hot.tolist():
                        if own and last == k - 1:
                            own[-1]["end"] = where[k][1]
                        else:
                            own.append({"start": where[k][0], "end": where[k][1]})
                        last = k
                spans.append(own)
                at += n
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [id_col, "score", "spans"])

    source = docs.select(id_col, text_col)
    return map_batches(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, score double, spans array<struct<start int, end int>>")
