"""Corpus operators on Spark: brute force on small tables, and awkward rows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from foliant.llm import bpe, html_text, imatch, licenses, minhash, packing, paragraphs, suffixes, toxicity, vectors
from foliant.llm._shared import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
AWKWARD = "doc_id long, text string, h string, component string, n_shingles string, __spans string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "h", "c", "n", "s") for i, t in texts], AWKWARD)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), prose(rng, 80), "", None, "two words", "two words", prose(rng, 9) + " " + base[:400], prose(rng, 3000)]
    return [*enumerate(texts), (3, texts[3]), (None, base), (None, None)]


def test_awkward_rows_pass_every_operator(spark, rows):
    ranks, vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    for df in (table(spark, rows), table(spark, [])):
        n = df.count()
        assert bpe.round_trip_digests(df, ranks, public_tokenizers.PATTERN).count() == n
        assert minhash.near_copies(df).count() == n
        assert suffixes.dedup_digests(df).count() == n
        assert suffixes.dedup_texts(df).columns == df.columns and suffixes.dedup_texts(df).count() == n
        assert imatch.edited_likeness(df).count() == n
        packed = packing.pack_documents(df, vocab, capacity=64)
        assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
        assert toxicity.score(df, toxicity.Model()).count() == n
        assert toxicity.filtered(df, toxicity.Model()).columns == df.columns
        assert licenses.scan(df).count() == 0
        assert html_text.extract(df, "doc_id", "text", ("h",)).count() == n
        paragraphs.repeated_passages(df).count()


def test_bpe_ids_decode_to_the_text(spark, rows):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, rows), ranks, public_tokenizers.PATTERN)
    back = bpe.decode(ids, ranks, public_tokenizers.PATTERN, portion=3)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in rows)


def shingle_set(text, size):
    w = (text or "").split()
    return {tuple(w[k : k + min(size, len(w))]) for k in range(len(w) - min(size, len(w)) + 1)} if w else set()


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for f in range(12):
        base = prose(rng, rng.randint(4, 90)).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w))
    sets = [shingle_set(t, 4) for t in docs]
    component = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and component[j] > component[i]:
                    component[j], changed = component[i], True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_copies(table(spark, enumerate(docs)), size=4).collect()}
    assert got == {i: (len(sets[i]), component[i], component[i] == i) for i in range(len(docs))}


def test_near_copies_split_large_families(spark, monkeypatch):
    """Families over several blocks: 600 texts that differ in one word each form one component."""
    rng = random.Random(3)
    base = prose(rng, 100).split()
    docs = [" ".join([*base[:60], f"own{i}", *base[61:]]) for i in range(600)]
    got = minhash.near_copies(table(spark, enumerate(docs))).where("component_id <> 0").count()
    assert got == 0


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    common = prose(rng, 60)
    docs = [prose(rng, 20) + common[: rng.randint(150, 400)] + prose(rng, 20) for _ in range(30)] + [common, common, "é" * 300, "", "ab" * 400]
    raw = [d.encode() for d in docs]
    every = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    got = {r.doc_id: r for r in suffixes.dedup_digests(table(spark, enumerate(docs)), shard_bytes=4000, room=2000).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if every[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_windows_that_repeat_within_a_piece_cost_few_rows(spark):
    pieces = spark.createDataFrame([(1, 1, 7, 8, 100, b"a " * 3000 + b"b" * 50)], "m long, copies long, a long, b long, start int, content binary")
    got = suffixes.runs_within(pieces, 200, 200).collect()
    assert len(got) < 100
    known = [(r.start, r.n) for r in got if r.known]
    assert known == [(100, 5801)]  # all windows of the line itself, and none of those over its end
    assert sum(r.copies for r in got if not r.known) == 5851  # one for each window
    rng = random.Random(5)
    docs = [prose(rng, 12) + "a " * rng.randint(200, 900) + prose(rng, 12) for _ in range(6)] + ["xyz" * 500, prose(rng, 90)]
    raw = [d.encode() for d in docs]
    every = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    for r in suffixes.dedup_digests(table(spark, enumerate(docs)), shard_bytes=4000, room=2000).collect():
        gone = {k for s in range(len(raw[r.doc_id]) - 199) if every[raw[r.doc_id][s : s + 200]] > 1 for k in range(s, s + 200)}
        assert r.kept_sha256 == hashlib.sha256(bytes(x for k, x in enumerate(raw[r.doc_id]) if k not in gone)).hexdigest()


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * 0.05 for i in range(160)] + [base[0]] * 5
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    m = np.array(rows)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    component = np.arange(len(m))
    for _ in range(len(m)):
        component = np.array([component[n].min() for n in near])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert all(got[i] == (0, i) for i, _ in odd)
    assert [got[i] for i in range(len(m))] == [(int(near[i].sum()) - 1, int(component[i])) for i in range(len(m))]


def test_vectors_equal_brute_force_in_small_windows(spark, monkeypatch):
    """1,500 vectors in windows of 12 over several partitions and in small blocks: the passes find every link; dense
    clouds, whose links the balls don't settle, and copies that weigh more."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SLICE", 16)
    rng = np.random.default_rng(17)
    centers = rng.normal(size=(150, 24))
    rows = [centers[i % 150] + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.3]) for i in range(1500)] + [centers[0]] * 40
    m = np.array(rows)
    df = spark.createDataFrame([(i, [float(x) for x in v], "a", "b") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, leader string, total string")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    component = np.arange(len(m))
    for _ in range(20):
        component = np.array([component[n].min() for n in near])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, window=12, per_partition=300).collect()}
    links = near.sum(axis=1) - 1
    found = np.array([got[i][0] for i in range(len(m))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert np.mean([got[i][1] == component[i] for i in range(len(m))]) > 0.98
    assert vectors.near_vectors(df.where("vec_id < 0")).count() == 0


def test_packing_is_whole_and_certified(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(3000)], "id long, length long")
    out = packing.pack(items, 100, per_partition=400).collect()
    assert sorted(r.id for r in out) == list(range(3000))
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 100
    assert len(used) <= packing.lower_bound(np.array([r.length for r in out]), 100) * 1.01 + 2


def test_imatch_next_document_and_equality(spark, rows):
    docs = [(i, t) for i, t in rows if i is not None and i != 3]
    got = {r.doc_id: r for r in imatch.edited_likeness(table(spark, docs)).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[6].fingerprint == got[7].fingerprint


def test_paragraphs(spark):
    rng = random.Random(7)
    sentence = lambda: prose(rng, 9) + ". "
    passage = "".join(sentence() for _ in range(7))
    near = passage.replace("alpha", "alphax", 1)
    docs = [prose(rng, 40) + "\n" + passage, passage + "\n" + prose(rng, 30), sentence() + sentence() + passage + sentence(), prose(rng, 60), near, "short line\n" * 3, ""]
    got = paragraphs.repeated_passages(table(spark, enumerate(docs))).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 4}
    assert {(r.cluster_doc, r.cluster_paragraph) for r in got} == {(0, 1)}
    inside = next(r for r in got if r.doc_id == 2)
    assert passage.strip()[20:-20] in docs[2][inside.start : inside.end]


def test_passages_over_lines_of_short_sentences(spark):
    """Runs of 60 words in short lines, in lists, and cut into inside sentences."""
    rng = random.Random(8)
    words = prose(rng, 60).split()
    lines = "\n".join(" ".join(words[k : k + 5]) + "." for k in range(0, 60, 5))
    docs = [prose(rng, 7) + "\n" + lines + "\n" + prose(rng, 4), prose(rng, 30) + " " + lines.replace("\n", " ") + " " + prose(rng, 30), prose(rng, 90)]
    got = {r.doc_id: r for r in paragraphs.repeated_passages(table(spark, enumerate(docs))).collect()}
    assert set(got) == {0, 1}
    assert all(docs[i][r.start : r.end].split() == lines.split() and r.n_words == 60 and r.kept == (i == 0) for i, r in got.items())
    assert {(r.cluster_doc, r.cluster_paragraph) for r in got.values()} == {(0, 1)}


def test_passages_deal_texts_out_once(spark, monkeypatch):
    """Where the ends of runs are read, texts go to other tasks once; rows with null ids and repeated rows are read too."""
    seen = []
    monkeypatch.setattr(paragraphs, "map_batches", lambda df, *a, f=paragraphs.map_batches: (seen.append(df) if "places" in df.columns else None) or f(df, *a))
    rng = random.Random(9)
    passage = prose(rng, 60).replace(" ", "\n")
    docs = [(1, f"x {passage} y"), (None, f"u {passage} v"), (None, f"u {passage} v"), (2, prose(rng, 60)), (1, f"w {passage}")]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = paragraphs.repeated_passages(table(spark, docs))
        assert Counter(r.doc_id for r in got.collect()) == Counter([1, 1, None])
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortAggregate" in (above := plan[: plan.index("SortMergeJoin")]) and "Exchange" not in above


def test_shuffles_of_stored_steps_leave_the_disk(spark):
    import glob
    import time

    from foliant.llm import _shared

    _shared.release(spark)
    time.sleep(2)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = manager.localDirsString()
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    with _shared.Tables(spark) as keep:
        for _ in range(3):
            before = held()
            assert keep(spark.range(20_000).repartition(3, "id").distinct()).count() == 20_000
            for _ in range(20):
                left = [f for f in held() - before if os.path.getsize(f) > 10_000]
                if not left:
                    break
                time.sleep(0.1)
            assert not left


def test_unlike_passages_do_not_chain(spark):
    """Only what repeats is reported, each run alone; unlike texts with common lines are no cluster."""
    rng = random.Random(9)
    a, b, one = prose(rng, 55), prose(rng, 60), prose(rng, 8) + "."
    own = [prose(rng, 40) for _ in range(6)]
    docs = [f"{own[0]} {one} {a} {own[1]}", f"{own[2]} {a} {own[3]} {b} {one}", f"{own[4]} {one} {b} {own[5]}"]
    got = sorted(paragraphs.repeated_passages(table(spark, enumerate(docs))).collect(), key=lambda r: (r.doc_id, r.start))
    assert [(r.doc_id, docs[r.doc_id][r.start : r.end], r.cluster_doc, r.kept) for r in got] == [(0, a, 0, True), (1, a, 0, False), (1, b, 1, True), (2, b, 1, False)]


def test_whole_texts_are_not_carried_to_paragraphs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(paragraphs, "with_sets", lambda rows, f=paragraphs.with_sets: seen.append(rows) or f(rows))
    line = prose(random.Random(9), 30)
    docs = [line + "\n" + line.rsplit(" ", 1)[0] + " changed", "é " * 3 + "\n" + line]
    assert paragraphs.repeated_passages(table(spark, enumerate(docs))).count() == 3
    assert "paragraph" in seen[0].columns and "text" not in seen[0].columns
    text = " é  b\tc\n" + " ".join(f"w{k}" for k in range(100)) + "\n\n z \n"
    words = text.split()
    before, behind, start, line, end, last = (x[0] for x in paragraphs.reach(text, np.array([5]), np.array([60])))
    assert before.decode().split() == words[:5] and behind.decode().split() == words[72:][:39]
    assert text[start:end].split() == words[5:72] and (line, last) == (1, 1)
    got = paragraphs.stretched(before, behind + text[end + len(behind.decode()) :].encode(), start, line, end, last, 4, 32)
    assert text[got[0] : got[1]].split() == words[1:] and got[2:] == (0, 3)


def test_words_of_many_texts_are_read_at_once(monkeypatch):
    """A batch is cut into words and hashed in few steps, whatever the number of its texts, and each text is read
    as it would be alone."""
    rng = random.Random(11)
    texts = [None, "", "\n", " a", "b \n\n", "É é " * 40, "Q" * 65 + " " + "q" * 65 + "\n" + "word " * 70, *(prose(rng, rng.randrange(1, 150)).replace(" alpha", "\nalpha") for _ in range(300))]
    kernels, mixed = [], []
    monkeypatch.setattr(paragraphs, "map_batches", lambda df, kernel, *a: kernels.append(kernel))
    paragraphs.read(None, "long", 4)
    rows = lambda x: pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array([7] * len(x)), pa.array(x, pa.string())], ["id", "h", "text"])
    alone = [kernels[0](rows([t])).select(["paragraphs", "anchors"]).to_pylist()[0] for t in texts]
    monkeypatch.setattr(paragraphs, "mix", lambda x, f=paragraphs.mix: mixed.append(len(x)) or f(x))
    assert kernels[0](rows(texts)).select(["paragraphs", "anchors"]).to_pylist() == alone
    assert any(x["anchors"] for x in alone) and 0 < len(mixed) < 40
    raw = " ".join(words := ["a", "A", "ab", "ba", "a\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "ABCDEFGHI", "x" * 64, "x" * 65, "X" * 65, "y" + "x" * 64, "é", "É"]).encode()
    hashes = paragraphs.hashes_of(raw, *paragraphs.split_words(raw)).tolist()
    same = [w.encode().lower() for w in words]
    assert all((x == y) == (a == b) for x, a in zip(hashes, same, strict=True) for y, b in zip(hashes, same, strict=True))


def test_ends_of_many_runs_at_once():
    """Words that agree behind and before runs, and where they end, against one run at a time."""
    rng = random.Random(12)
    some = lambda: "".join(rng.choice(["a ", "B", "é ", "\n", " \t", "word ", "x" * 9, "q" * 70 + " "]) for _ in range(rng.randrange(30)))
    one = [some().strip().encode() for _ in range(300)]
    two = [rng.choice([x.replace(b" ", b"\n").upper(), x + b"z", b"c " + x, some().strip().encode()]) for x in one]
    a, b = paragraphs.Parts.of(one), paragraphs.Parts.of(two)
    for backwards in (False, True):
        way = slice(None, None, -1 if backwards else 1)
        want = [len(os.path.commonprefix([x.lower().split()[way], y.lower().split()[way]])) for x, y in zip(one, two, strict=True)]
        assert paragraphs.agreeing(a, b, backwards).tolist() == want and 0 < sum(want)
    n = np.array([rng.randrange(len(x.split()) + 1) for x in one])
    zero, at = np.zeros(len(n), np.int64), np.arange(len(n))
    start, end, line, last = paragraphs.stretched(a, a, zero, zero, zero, zero, n, n, at)
    for text, k, *found in zip(one, n.tolist(), *(x.tolist() for x in (start, end, line, last)), strict=True):
        chars, words = text.decode(), text.split()
        lead, trail = chars[len(chars) + found[0] :], chars[: found[1]]
        assert lead.encode().split() == words[len(words) - k :] and lead == lead.lstrip() and found[2] == -lead.count("\n")
        assert trail.encode().split() == words[:k] and trail == trail.rstrip() and found[3] == trail.count("\n")


def test_paragraphs_are_not_dealt_out_to_find_repeated_rows(spark, monkeypatch):
    """What was read of texts is shuffled only where rows repeat; the table of first places is joined as stored."""
    seen = []
    call = paragraphs.Tables.__call__
    monkeypatch.setattr(paragraphs.Tables, "__call__", lambda self, df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or call(self, df))
    passage = prose(random.Random(13), 60)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = paragraphs.repeated_passages(table(spark, [(1, "a " + passage), (2, passage), (None, "b " + passage)]))
        assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, None])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    dealt = [plan for columns, plan in seen if "anchors" in columns]
    assert dealt and not any("Exchange" in plan for plan in dealt)
    followed = next(plan for columns, plan in seen if {"p", "q", "shift"} <= set(columns))
    assert followed.count("Aggregate") <= 2  # that of the runs alone; no aggregate below the join on anchors
    seen.clear()
    got = paragraphs.repeated_passages(table(spark, [(1, passage), (1, passage), (None, passage), (None, passage)]))
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, None])
    assert sum("anchors" in columns for columns, _ in seen) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    star = [(200, k) for k in range(201, 260)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and all(got[k] == 200 for k in range(200, 260))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_cost_few_jobs_and_give_what_contraction_gives(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 - k, 999 - k) for k in range(90)]
    df = spark.createDataFrame(edges, "a int, b int").localCheckpoint()
    spark.sparkContext.setJobGroup("few", "")
    few = sorted(map(tuple, components(df).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("many", "")
    assert few == sorted(map(tuple, components(df, few=0).collect())) and few[-1] == (1000, 910)
    assert 2 * jobs < len(spark.sparkContext.statusTracker().getJobIdsForGroup("many"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_imatch_is_native(spark, rows):
    plan = imatch.edited_likeness(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_imatch_names_each_subset_once_a_text(spark, rows):
    """What an expression names twice is computed twice."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = imatch.edited_likeness(table(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 2 * sum(imatch.RATES.values()) < plan.count("filter(") < 3 * sum(imatch.RATES.values())


def test_imatch_equals_brute_force(spark):
    """Fingerprints are equal where the sorted lexicon terms of every subset are; likeness is their share."""
    rng = random.Random(12)
    docs = [(k, prose(rng, rng.randint(0, 60))) for k in range(120)] + [(None, prose(rng, 20)), (None, "")]
    df = table(spark, docs)
    got = imatch.edited_likeness(df, least_share=0.01, most_share=0.4).collect()
    known = {r.term for r in imatch.band_terms(df, least_share=0.01, most_share=0.4).collect()}
    texts = {t for _, t in docs}
    term = {w: h for w, h in ((r.w, r.h) for r in spark.createDataFrame([(w,) for t in texts for w in t.split()], "w string").selectExpr("w", "xxhash64(w) as h").collect())}
    dealt = {(r.h, rate): r[f"d{rate}"] for r in spark.createDataFrame([(h,) for h in term.values()], "h long").select("h", *[F.pmod(F.xxhash64("h", F.lit(rate)), F.lit(rate)).alias(f"d{rate}") for rate in imatch.RATES]).collect() for rate in imatch.RATES}

    def subsets(text):
        own = sorted({term[w] for w in text.split()} & known)
        if not own:
            return [frozenset(term[w] for w in text.split())]
        return [frozenset(h for h in own if rate == 1 or dealt[h, rate] == k) for rate, n in imatch.RATES.items() for k in range(n)]

    def likeness(a, b):
        told = [(x, y) for x, y in zip(a, b, strict=True) if x or y or len(a) == 1] if len(a) == len(b) else []
        return sum(x == y for x, y in told) / len(told) if told else 0.0

    order = sorted([d for d in docs if d[0] is not None], reverse=True)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for (i, t), (_, following) in zip(order[:-1], order[1:], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        words = edited.split()
        for r in spark.createDataFrame([(w,) for w in words if w not in term], "w string").selectExpr("w", "xxhash64(w) as h").collect() if any(w not in term for w in words) else []:
            term[r.w] = r.h
            for rate in imatch.RATES:
                dealt[r.h, rate] = None  # of no band
        assert abs(by_id[i].near_next - likeness(subsets(t), subsets(following))) < 1e-12
        assert abs(by_id[i].near_edited - likeness(subsets(t), subsets(edited))) < 1e-12
    prints = {}
    for i, t in docs:
        if i is not None:
            assert prints.setdefault(by_id[i].fingerprint, subsets(t)) == subsets(t)


def test_every_term_of_the_band_counts(spark):
    """3,800 terms lie in the band; short texts keep theirs."""
    large = " ".join(f"w{k}" for k in range(3000))
    docs = [large, large] + [f"a{k // 2} b{k // 2}" for k in range(800)]
    got = imatch.fingerprints(table(spark, enumerate(docs))).collect()
    assert len(got) == len(docs) and all("." in r.fingerprint for r in got)


def test_windows_go_over_borders(spark):
    """Neighbours in order meet though they lie in other partitions."""
    rng = np.random.default_rng(10)
    v = [rng.normal(size=16) for _ in range(300)]
    rows = [(k, x.tobytes()) for k, x in enumerate(y for x in v for y in (x, x + rng.normal(size=16) * 0.01))][1:-1]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 299), "leader long, vector binary")  # a border in each pair
    got = {(r.a, r.b) for r in vectors.met(df, "long", 0.99, 4).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(1, 299)}


def test_passes_grow_with_the_vectors():
    n = [vectors.passes_for(k, 0.9, 128, 16) for k in (100, 2000, 50_000, 1_000_000)]
    assert n[0] == n[1] == 16 < n[2] < n[3] and all(p <= 40 for p in n)


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Repeated rows, other texts under one id, and null ids."""
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    docs = table(spark, [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c), (4, "")])
    got = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (1, b), (None, c), (4, "")])


def test_pipeline_deals_texts_out_once_a_stage(spark):
    """Texts go to other tasks once where one row of each group is kept, as dealing them out is what fills executors."""
    import re

    import corpus_pipeline

    docs = table(spark, [(1, "a b c"), (1, "a b c"), (2, "d")])
    got = corpus_pipeline.one_of_near_copies(spark, docs, "")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan ExistingRDD\[[^\]]*\btext#", plan)) == 1 and len(re.findall("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan)) == 1
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "a b c"), (2, "d")}


def test_kernels_get_large_batches_in_portions(spark):
    from foliant.llm import _shared

    seen = _shared.map_batches(spark.range(0, 1000, 1, 1), lambda b: pa.RecordBatch.from_arrays([b.column("id"), pa.array([b.num_rows] * b.num_rows)], ["id", "n"]), "id long, n long", 2400)
    rows = seen.collect()
    assert [r.id for r in rows] == list(range(1000)) and max(r.n for r in rows) == 300


def test_executors_collect_after_a_block_of_tables(spark, monkeypatch):
    from foliant.llm import _shared

    seen = []
    monkeypatch.setattr(_shared, "shrink", lambda s, f=_shared.shrink: seen.append(f(s)))
    with _shared.Tables(spark) as keep:
        assert keep(spark.range(3)).count() == 3 and not seen
    assert len(seen) == 1


def test_toxicity_without_labels_of_both_kinds(spark, rows):
    df = table(spark, rows)
    for labels in ([], [(0, 0), (1, 0), (3, None), (None, 1)], [(0, 1), (1, 1)]):
        model = toxicity.fit_on(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        got = toxicity.score(df, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score < 0.1 for r in got)


def test_toxicity_learns_from_one_fold_and_finds_the_other(spark):
    """Documents with a word of a made-up vocabulary are toxic; held-out ones are found, clean ones left alone."""
    rng = random.Random(14)
    bad = ["vrakzu", "vrakzen", "vrakzo"]
    docs = []
    for k in range(240):
        words = prose(rng, 60).split()
        if k % 4 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        docs.append((k, " ".join(words)))
    df, labels = table(spark, docs), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit_on(df, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(df, model).collect()}
    held = [k for k, _ in docs if k % 3 == 1]
    assert sum(got[k] for k in held if k % 4 == 0) >= 0.9 * sum(k % 4 == 0 for k in held)
    assert not any(got[k] for k in held if k % 4)
    kept = {r.doc_id for r in toxicity.filtered(df, model).collect()}
    assert kept == {k for k in got if not got[k]}


def families_of(spark, docs, **options):
    got = {r.doc_id: r.component_id for r in minhash.near_copies(table(spark, docs), size=4, **options).collect()}
    return got


def test_near_copies_of_very_large_families(spark):
    """1,200 texts, each edited on its own from one original of no special id, so that hardly two edits are alike
    enough to be linked themselves, form one component through it; another family and single texts stay apart."""
    rng = random.Random(15)
    base, other = prose(rng, 120).split(), prose(rng, 120).split()
    edits = []
    for i in range(1200):
        w = list(base)
        for k in (rng.randrange(60), 60 + rng.randrange(60)):
            w[k] = f"own{i}x{k}"
        edits.append(" ".join(w))
    docs = [(i + 1, t) for i, t in enumerate(edits)] + [(7000, " ".join(base))] + [(8000 + i, " ".join([*other[:50], f"o{i}", *other[51:]])) for i in range(40)] + [(9000 + i, prose(rng, 50)) for i in range(20)]
    got = families_of(spark, docs)
    assert {got[i] for i in range(1, 1201)} | {got[7000]} == {1}
    assert {got[8000 + i] for i in range(40)} == {8000}
    assert all(got[9000 + i] == 9000 + i for i in range(20))


def test_removal_from_very_many_equal_rows(spark):
    """3,000 equal rows, and 300 texts around one common passage, in shards larger than the memory of a sort."""
    rng = random.Random(16)
    same, common = prose(rng, 40), prose(rng, 45)
    texts = [f"{prose(rng, 12)} {common} {prose(rng, 12)}" for _ in range(300)]
    every = Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    docs = [(1, same)] * 3000 + [(10 + k, t) for k, t in enumerate(texts)]
    got = suffixes.dedup_digests(table(spark, docs), shard_bytes=20_000, room=10_000).collect()
    assert sum(r.doc_id == 1 and r.n_removed == len(same) for r in got) == 3000
    by = {r.doc_id: (r.n_removed, r.n_spans) for r in got}
    for k, t in enumerate(texts):
        hit = [s for s in range(len(t) - 199) if every[t[s : s + 200]] > 1]
        assert by[10 + k] == (hit[-1] + 200 - hit[0], 1)
