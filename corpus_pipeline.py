"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark leaks, tokens.

Each stage works on all that its predecessor kept, written as Parquet and read again; all but the last return the columns
of ``documents``. The first rejects documents that the quality classifier scores below 0.5; the second keeps, of each
class of near duplicates (five-word shingles, Jaccard similarity 0.75 or more), the one with the smallest id; the third
drops documents that hold a benchmark item; the last encodes what is left and decodes it again.

SQL can express neither the network nor the tokenizer, so ORACLE_SQL is None; tests/llm holds brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslens.llm import bpe_replay, decontaminate, ngram_trie, quality_cnn
from newslens.llm.common import read, small_batches, stage
from newslens.llm.queries import BPE_FILE, quality_network


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, quality_network(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_trie.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe_replay.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage but the last is staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
