"""A training corpus from raw documents: five stages, each a table in and a table out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm import bpe, mixing, passages, quality, simhash
from careerloom.llm.common import bucket
from careerloom.runtime import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside its held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)))
    model = quality.fit(docs, labels)
    return quality.keep(docs.select(*COLUMNS), model, least=0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs.select(*COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    return _counted(passages.without_repeats(docs.select(*COLUMNS)))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as the mix takes them, a row per pass over a document."""
    return _counted(mixing.mixed_documents(docs.select(*COLUMNS)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    tokens = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("source_mixing", mixed_sources),
    ("bpe_encoding", encoded),
]

#: The stages are not expressible in SQL; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
