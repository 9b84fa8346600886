"""From raw documents to token shards in five stages, each a table of its own."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reachgrid.llm import decontaminate, index, jaccard, mixing, quality
from reachgrid.session import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough words once lines common on their source are out; their texts are without these lines."""
    return quality.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, 0.8 (op8 by itself has values of its own)."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, copy, start, n_tokens and ids_crc32 of each document, read back from the written shards by their index."""
    path = index.write_index(docs, public_tokenizers.path(index.VOCABULARY))
    return index.read_digests(spark, path)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("token_index", token_index)]

#: Several stages have no counterpart in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; every stage's table is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
