"""Documents to packed training sequences: toxicity, near copies, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the
last return the columns of documents. SQL can't express the first stage, so ORACLE_SQL is None; the
stages are tested against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import minhash, packing, suffixes, toxicity
from foliant.llm._shared import Tables, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7. The model is fitted on the table's labelled documents."""
    labelled = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit_on(labelled, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True))
    return toxicity.filtered(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id.

    Rows are told apart by id and text. Repeated rows are one; texts under one id, and those without an id,
    are compared each on its own. A null text counts as empty, and empty texts are like nothing. An empty table gives
    no rows. Columns may have any names."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keyed = docs.withColumn(row, own)
    found = minhash.near_copies(keyed.select(row, "text"), size=5, percent=80, id_col=row)
    kept = found.where("kept").select(row).distinct()
    # repeated rows go before texts are dealt out by row, and the join finds them dealt so
    return keyed.dropDuplicates([row]).join(kept, row, "left_semi").drop(row)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that strings of 200 bytes met elsewhere cover; n_chars follows. Every
    document stays, if with an empty text."""
    changed = suffixes.dedup_texts(docs)
    changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, with the sequence of 4096 tokens and the place they are packed into."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", not_toxic), ("minhash_near_dedup", one_of_near_copies), ("suffix_dedup", without_repeats), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's documents are stored before the next reads them; packing stores
    its own pieces first, so its result needs those tables no more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
