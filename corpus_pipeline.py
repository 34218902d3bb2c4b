"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality classifier, exact dedup, SimHash near-dedup, mixing to target weights,
byte-level BPE. Every stage works on all that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillweave.llm.bpe import bpe_encode
from rillweave.llm.common import cut, spread
from rillweave.llm.exact_dedup import keep_first_of_equal
from rillweave.llm.mixing import mix_sources
from rillweave.llm.quality_classifier import keep_good
from rillweave.llm.simhash_dedup import keep_one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are judged like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(COLUMNS), labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the smallest doc_id stays, null ids last; of rows that repeat its id one does."""
    return keep_first_of_equal(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingle sets 0.8 or more, confirmed) the row with the smallest doc_id stays."""
    return keep_one_of_each(docs.select(COLUMNS), shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their bytes; a document is there as often as its Poisson count says."""
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the bytes they decode to, and how many there are; null texts have none."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_encode(docs, ranks, pattern, round_trip=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mix), ("bpe_encoding", encode)]

#: The classifier, SimHash and BPE are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
