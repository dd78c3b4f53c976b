"""Chat windows, ranked search and hard negatives against brute force, and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import balltree, chat, lexical

# ---- chat ------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "im_end", ">", "\n", "<|im_end|>", "<|im_start|>", "<|nl|>", "é", "user"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_windows_parse_to_their_turns(turns):
    made = [chat.formatted(r, t) for r, t in turns]
    assert chat.parsed("".join(m[0] for m in made)) == turns
    for (_, t), (whole, a, b) in zip(turns, made, strict=True):
        assert chat.unescaped(whole[a:b]) == t
        assert "<|" not in whole[a:b]


def words():
    return lambda texts: [len(t.split()) for t in texts]


def expected_windows(turns, budget, history, stretch):
    """turns: (role, text). (texts of again, texts of new) of each window, by plain reading of the rules."""
    tokens = [len(chat.formatted(r, t)[0].split()) for r, t in turns]
    before = [sum(tokens[:i]) for i in range(len(turns))]
    sys_ok = bool(turns) and turns[0][0] == "system" and 2 * tokens[0] <= budget
    out, i = [], 0
    while i < len(turns):
        home = before[i] // (stretch * budget)
        again = [0] if sys_ok and i > 0 else []
        room = min(history, budget - tokens[i] - sum(tokens[k] for k in again))
        h = i
        while h - 1 > (0 if sys_ok else -1) and tokens[h - 1] <= room:
            h -= 1
            room -= tokens[h]
        again += list(range(h, i))
        used, j = sum(tokens[k] for k in again) + tokens[i], i + 1
        while j < len(turns) and used + tokens[j] <= budget and before[j] // (stretch * budget) == home:
            used += tokens[j]
            j += 1
        out.append((again, list(range(i, j)), used))
        i = j
    return out


def test_windows_follow_their_rules(spark):
    rng = random.Random(3)
    convs = {}
    for c in range(30):
        n = rng.choice([1, 2, 5, 40, 400 if c == 7 else 12])
        turns = [("system", "be kind")] if rng.random() < 0.5 else []
        convs[c] = turns + [(rng.choice(["user", "assistant"]), " ".join(["w"] * rng.choice([0, 1, 5, 9, 30, 70]))) for _ in range(n)]
    convs[99] = [("system", "x " * 40), ("user", "hi"), ("assistant", "yes")]  # too long to be repeated
    rows = [(c, k, r, t, "x", 1) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rn string, tokens long").repartition(5)
    got = defaultdict(list)
    for stretch in (2, 64):
        got.clear()
        for r in chat.windows(df, words(), budget=60, history=20, stretch=stretch).collect():
            got[r["conv"]].append(r)
        for c, ts in convs.items():
            want = expected_windows(ts, 60, 20, stretch)
            mine = sorted(got[c], key=lambda r: r["window"])
            assert [(r["repeated"], r["turns"], r["tokens"]) for r in mine] == [(len(a), len(a) + len(b), u) for a, b, u in want], (c, stretch)
            for r, (a, b, _) in zip(mine, want, strict=True):
                assert chat.parsed(r["text"]) == [ts[k] for k in a + b]
                masked = [chat.unescaped(r["text"][x["begin"] : x["end"]]) for x in r["loss"]]
                assert masked == [ts[k][1] for k in b if ts[k][0] == "assistant" and ts[k][1]]
                assert r["tokens"] <= 60 or r["turns"] - r["repeated"] == 1


def test_awkward_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "of none"), (1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", ""), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (2, 5, "a\nb<|nl|>", "<|im_end|>\n<|im_start|>user\nhi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w")).withColumn("stretch", F.lit(1))
    got = {r["conv"]: r for r in chat.read_back(chat.windows(df, words(), budget=50, history=10)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {None: 2, 1: 4, 2: 1}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"yy").hexdigest() and got[1]["loss_chars"] == 2
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nof none\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"a\nb<|nl|>\n<|im_end|>\n<|im_start|>user\nhi\n").hexdigest()
    empty = chat.windows(df.where("false"), words())
    assert empty.count() == 0 and chat.read_back(empty).count() == 0


# ---- ranked search ---------------------------------------------------------------------------------


def ranked(docs, queries, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(find(t))) for i, t in docs]
    n = {p: c.total() for p, (_, c) in enumerate(held)}
    many, length = sum(x > 0 for x in n.values()), sum(n.values())
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, t in queries:
        scores = []
        for p, (i, c) in enumerate(held):
            s = 0
            for term in find(t):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[term] + 1)))
                    s += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * (75 + 25 * n[p] * many // length)))
            if s > 0:
                scores.append((-s, i is not None, i or 0, p))
        for rank, (s, some, i, _) in enumerate(sorted(scores)[:k], 1):
            out.append((q, rank, i if some else None, -s))
    return out


def rows_of(df):
    return Counter((r[0], r[1], r[2], r[3]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 20])
def test_search_equals_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(lexical, "PLACES", 64)  # many ranges of places
    rng = random.Random(k)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 300])))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(200)]  # copies of one text
    queries = [(q, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30])))) for q in range(12)] + [(50, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    want = Counter(ranked(docs, queries, k))
    assert rows_of(lexical.search(d, q, k=k)) == want
    assert rows_of(lexical.search(d, q, k=k, most_terms=40)) == want  # many blocks of queries


def test_the_uniform_threshold_passes_over_documents(spark):
    """Documents that hold only what weighs little are never summed."""
    docs = [(i, "common " * 3 + (f"rare{i % 4} " * 2 if i < 40 else "") + f"own{i}") for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lexical.forward(d, {b"common": 0, b"rare1": 1}, "doc_id", "text").cache()
    n, length = rows.agg(F.count(F.lit(1)), F.sum("n")).head()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = dict(zip(held, lexical._weights(list(held.values()), n), strict=True))
    asked = [(2, [(0, max(weights[0], 1)), (1, weights[1])])]
    lists = lexical.postings(rows, n, length).cache()
    of = spark.createDataFrame([(t, 0, w) for t, w in asked[0][1]], "term int, q int, weight long")
    bounds = [dict(lexical.heads(lists, of, 5).collect())[0]]
    depth = lexical.thresholds(asked, bounds)
    met = lexical.candidates(lexical.fetched(lists, asked, depth), asked, bounds, depth, 5)
    assert depth[0] > 0 and met.count() <= 10


def test_candidates_do_not_grow_with_the_ranges(spark, monkeypatch):
    """Documents are held against the k-th best of all ranges where they are met, not against that of their range."""
    monkeypatch.setattr(lexical, "PLACES", 32)
    rng = random.Random(3)
    docs = [(i, "a " * rng.randint(1, 40) + "b " * rng.randint(1, 40) + "c " * rng.randint(0, 40)) for i in range(2000)]
    rows = lexical.forward(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), {b"a": 0, b"b": 1}, "doc_id", "text").cache()
    n, length = rows.agg(F.count(F.lit(1)), F.sum("n")).head()
    asked, lists = [(2, [(0, 5), (1, 7)])], lexical.postings(rows, n, length)
    assert rows.select("range").distinct().count() > 60
    exact = sorted((r.score for r in lexical.looked_up(rows, rows.selectExpr("0 as q", "range", "place"), asked, n, length).collect()), reverse=True)
    met = lexical.candidates(lexical.fetched(lists, asked, [0]), asked, [0], [0], 5)
    assert met.count() == sum(s >= exact[4] for s in exact)


def test_awkward_searches(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "Alpha, ALPHA! é"), (3, "Alpha, ALPHA! é"), (4, "beta"), (5, "x " * 700_000 + "alpha"), (6, "été É"), (7, "beta gamma"), (8, "delta"), (9, "eta")]
    queries = [(0, "alpha"), (0, "alpha"), (1, None), (2, ""), (None, "É été beta beta"), (3, "no such")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("t")).withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("range", F.lit("r"))
    assert rows_of(lexical.search(d, q)) == Counter(ranked(docs, queries, 20))
    assert lexical.search(d.where("false"), q).count() == 0 and lexical.search(d, q.where("false")).count() == 0
    assert lexical.search(d.where("doc_id in (1, 2)"), q).count() == 0


def test_terms_of_long_texts_are_split_alike(monkeypatch):
    text = ("Ab-cd é" * 50 + "z" * 100 + " end").encode()
    whole = lexical.terms_of(text)
    monkeypatch.setattr(lexical, "BIT", 7)
    assert lexical.terms_of(text) == whole


# ---- hard negatives --------------------------------------------------------------------------------


def mined(rows, every=100, positives=5, negatives=5):
    """rows: (id, label, vector), all good."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for p, (a, label, v) in enumerate(whole):
        if a is None or a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0, other) for k, (i, other, w) in enumerate(whole) if k != p and len(w) == len(v)]
        scores.sort()
        for ps, none, pid, _ in [s for s in scores if s[3] == label][:positives]:
            window = [s for s in scores if s[3] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
            out += [(a, None if none else pid, r, None if s[1] else s[2], -ps, -s[0]) for r, s in enumerate(window[:negatives], 1)]
    return Counter(out)


def clouds(rng, n, labels, width=6):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.7) for c in rng.choice(centres)]) for i in range(n)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label int")


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balltree, "PART", 100)
    monkeypatch.setattr(balltree, "LEAF", 8)
    monkeypatch.setattr(balltree, "BLOCK_BYTES", 500)
    rng = random.Random(5)
    rows = clouds(rng, 900, 3) + [(2000 + i, 1, [0.5] * 6) for i in range(300)] + [(3000 + i, i % 2, [0.25] * 3) for i in range(40)]  # copies, another width
    got = balltree.hard_negatives(vectors(spark, rows), lambda i: i % 100 == 0)
    assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_nodes_are_passed_over(monkeypatch):
    """Bounds leave most of a clustered tree alone, from both sides."""
    monkeypatch.setattr(balltree, "LEAF", 16)
    rng = np.random.default_rng(0)
    points = np.floor(256 * (rng.normal(size=(40, 8)).repeat(50, 0) + rng.normal(size=(2000, 8)) * 0.02))
    order, nodes, centres, radii = balltree.grow(points, np.arange(2000))
    tree = {"rows": order, "ids": order, "points": points[order], "nodes": nodes, "centres": centres, "radii": radii}
    read = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop - at.start)
            return np.asarray(super().__getitem__(at))

    tree["points"] = tree["points"].view(Counting)
    q = points[:1]
    s = np.sort(points @ q[0])
    one = balltree.Block(q, np.array([-1]), np.array([0]), np.array([0]), np.array([s[900]]), np.array([s[1000]]), True)
    _, score, _, _ = balltree.best_of(tree, one, np.array([0]), 5)
    assert sorted(score) == sorted(s[(s <= s[1000])][-5:]) and sum(read) < 1000


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.95, 0.5]), (2, 2, [0.95, 0.5]), (None, 2, [0.9, 0.5]), (None, 1, [0.8, 0.5]), (3, 3, [-1.0, 0.0]), (100, 5, [1.0]), (200, 6, []), (201, 6, []), (202, 7, [])]
    bad = [(300, None, [1.0, 1.0]), (400, 1, None), (500, 1, [nan, 1.0]), (600, 1, [inf, 1.0]), (700, 2, [None, 1.0])]
    df = vectors(spark, good + bad).withColumn("cell", F.lit("c")).withColumn("row", F.lit(0))
    assert Counter(tuple(r) for r in balltree.hard_negatives(df, lambda i: i % 100 == 0).collect()) == mined(good)
    assert balltree.hard_negatives(df.where("false"), lambda i: i % 100 == 0).count() == 0
    assert balltree.hard_negatives(df, lambda i: i < 0).count() == 0
