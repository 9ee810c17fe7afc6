"""A training corpus from documents: toxic ones out, near copies out, repeated spans out, mixed, encoded.

Each stage takes all that the one before kept. All but the last return the columns of documents; the last
returns doc_id, source, n_tokens and ids, a row per copy in the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from countylens.llm import common, lexicon, mixing, near_dups, substrings, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: No SQL can state the learned stages; the stages are tested one by one.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the severity model rejects go."""
    common.small_batches(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    common.small_batches(spark)
    return near_dups.dedup(docs, words=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 20 or more that start earlier in the corpus are cut out of the texts."""
    common.small_batches(spark)
    return substrings.dedup(docs, window=20).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    common.small_batches(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    common.small_batches(spark)
    return lexicon.encoded(docs, VOCABULARY, keep=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, name)
    return docs
