"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents, with `n_chars` counted anew where the text changed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, secret_scan, simhash, suffix_dedup
from tidemark.session import shared_dir

#: No SQL: fingerprints, refined buckets and token ids cannot be written in it; tests hold the stages against brute force.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"
PASSAGE_BYTES = 240  # a passage of 50 words has more


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or an adaptive fence go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays."""
    return simhash.near_copies(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out; the documents stay."""
    return _counted(suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also behind nested encodings, are masked; the documents stay."""
    return _counted(secret_scan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal),
          ("secret_masking", secret_masking), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written as Parquet and read again by the next stage."""
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
