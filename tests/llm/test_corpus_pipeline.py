"""The pipeline's stages against brute force, one after the other, and run as a whole."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with near copies, a common passage, toxic words, and nulls; labels of some of them."""
    rng = random.Random(21)
    path, texts = tmp_path_factory.mktemp("tables"), []
    passage = prose(rng, 70)
    for k in range(60):
        words = prose(rng, 50).split()
        if k % 4 == 0:
            words[rng.randrange(50)] = rng.choice(["vrakzu", "vrakzen"])
        texts.append(" ".join(words) + (" " + passage + " " + prose(rng, 5) if k % 10 == 1 else ""))
    for k in range(8):
        near = texts[4 * k + 1].split()
        near[20] = f"changed{k}"
        texts.append(" ".join(near))
    texts += ["", None, texts[2]]
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set()


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    (_, clean), (_, near), (_, suffixes), (_, pack) = corpus_pipeline.STAGES

    one = clean(spark, docs, folder).cache()
    assert one.columns == columns
    model = toxicity.fit_on(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == {i for i, s in scores.items() if s < 0.7}
    assert {i for i in range(60) if i not in kept} == {i for i in range(60) if i % 4 == 0}

    two = near(spark, one, folder).cache()
    assert two.columns == columns
    sets, first = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    first[j] = min(first[i], first[j])
        if all(first[first[i]] == first[i] for i in first):
            break
    left = {r.doc_id: r.text for r in two.collect()}
    assert set(left) == {i for i in kept if first[i] == i}

    three = suffixes(spark, two, folder).cache()
    assert three.columns == columns
    every = Counter(t[s : s + 200] for t in map(str, left.values()) for s in range(len(t) - 199))
    cut = {}
    for i, t in left.items():
        gone = set()
        for s in range(len(t or "") - 199):
            if every[t[s : s + 200]] > 1:
                gone.update(range(s, s + 200))
        cut[i] = None if t is None else "".join(c for k, c in enumerate(t) if k not in gone)
    got = {r.doc_id: (r.text, r.n_chars) for r in three.collect()}
    assert {i: t or "" for i, (t, _) in got.items()} == {i: t or "" for i, t in cut.items()} and any(len(t or "") < len(left[i] or "") for i, t in cut.items())
    assert all(n == len(t or "") for t, n in got.values() if t is not None)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    sizes = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, (x, _) in got.items()}
    packed = pack(spark, three, folder).collect()
    assert {r.doc_id: r.length for r in packed} == sizes
    assert {(r.doc_id, r.length) for r in corpus_pipeline.run(spark, folder).collect()} == set(sizes.items())
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_columns_may_have_any_name_and_tables_be_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("__row", F.lit("mine"))
    near = corpus_pipeline.STAGES[1][1](spark, docs, folder)
    assert near.columns == docs.columns and near.where("__row = 'mine'").count() == near.count() > 0
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        made = stage(spark, nothing, folder)
        assert made.columns == docs.columns and made.count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, nothing, folder).count() == 0
