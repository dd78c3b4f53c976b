"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import balltree, bpe, chat, html_text, imatch, lexical, licenses, minhash, packing, paragraphs, suffixes, toxicity, vectors
from foliant.llm._shared import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"), size=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"  # as control strings in a text must come through
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.windows(turns.unionByName(more), chat.token_counts(public_tokenizers.path("word_bpe_49k.json")))
    return chat.read_back(made).withColumnRenamed("conv", "conv_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return balltree.hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), lambda i: i % 100 == 0, label=shifted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_near_dedup, op2_byte_bpe, op3_imatch_fingerprints, op4_best_fit_packing, op5_paragraph_dedup, op6_html_extraction, op7_minhash_near_dedup, op8_toxicity, op9_license_scan, op10_suffix_dedup, op11_chat_formatting, op12_ranked_search, op13_hard_negatives)}

#: Of links (a, b) between ids: every id with all that it reaches, and the smallest of them.
LINKED = """
reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLE: dict[str, str] = {}

ORACLE["op1_embedding_near_dedup"] = (
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
ids AS (SELECT vec_id AS id FROM v),"""
    + LINKED
    + """,
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT c.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.id = component_id AS kept FROM component c LEFT JOIN counts USING (id)"""
)

ORACLE["op7_minhash_near_dedup"] = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS held FROM w),
s AS (SELECT doc_id, unnest(held) AS g FROM sets),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_have JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id WHERE 100 * n >= 80 * (len(x.held) + len(y.held) - n)),
ids AS (SELECT doc_id AS id FROM sets),"""
    + LINKED
    + """
SELECT doc_id, len(held)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component ON doc_id = id"""
)

ORACLE["op10_suffix_dedup"] = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, s, md5(b[s:s + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS s FROM d WHERE octet_length(b) >= 200)),
hit AS (SELECT doc_id, s FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS opens FROM hit),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
spans AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS gone FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, b, gone, a, z, list_transform(range(1, len(a) + 2), lambda k: b[(CASE WHEN k = 1 THEN 1 ELSE z[k - 1] END):(CASE WHEN k > len(a) THEN octet_length(b) ELSE a[k] - 1 END)]) AS parts FROM d LEFT JOIN spans USING (doc_id))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans, sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(parts, lambda x, y: x || y) END) AS kept_sha256 FROM kept"""

ORACLE["op12_ranked_search"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, 75 + (25 * len(ts) * nn) // ll AS m FROM d, s WHERE len(ts) > 0),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

ORACLE["op13_hard_negatives"] = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM pairs WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score) WHERE rank <= 5"""
