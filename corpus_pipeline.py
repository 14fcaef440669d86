"""Training-corpus pipeline: quality, near duplicates, decontamination, mixing, token shards.

Each stage works on all its predecessor kept, is written as Parquet under the
cluster's shared checkpoint folder and read again for the next one.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontam, jaccard, mixing, quality, tokens
from murmur.llm.common import release, written
from murmur.llm.queries import END_ID, tokenizer_path
from murmur.sources.tables import Tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity band keep."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.drop_contaminated(docs, Tables(spark, sf_dir).benchmark)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return tokens.token_table(docs, tokenizer_path(), END_ID)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", source_mix), ("token-ID / binary output", token_output)]

#: The language model of the first stage is beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = Tables(spark, sf_dir).documents
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k + 1}")
        release(spark)
    return docs
