"""From documents to token files: reject low quality, keep one of each class of near copies, drop documents that hold
benchmark items, mix sources to target weights, encode.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs, whatever their names. Null texts are
judged as empty ones; a null source is a source; rows that repeat a doc_id are judged each by itself, but for the join,
which keeps one of rows alike in doc_id and text; of tied copies the least doc_id stays, and a copy without one only where
no other has one; no documents give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dup, quality, token_output
from tidemark.llm.common import scratch, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, takes for good ones."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of documents linked by similar five-word shingles."""
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, edits within its budget included."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: none, once or more."""
    return mixing.repeated(docs)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    path = scratch_path(spark, "token-store")
    token_output.write_store(docs, path)
    return token_output.read_store(spark, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_id_output),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
