"""A corpus pipeline over documents: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last
return the columns of documents.  Nulls: a null text has no language and goes at the
first stage; null lang, source or n_chars stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm import decontaminate, language_id, line_dedup, minhash, sentencepiece_codec
from echotrace.llm.store import forget, release, written


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars counted again, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if they have no letter, or fit every learned language worse than chance."""
    return language_id.keep_known(docs, language_id.train(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses every line goes with them."""
    return _recounted(line_dedup.dedup(docs, drop_emptied=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the least doc_id."""
    return minhash.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in the benchmark are cut; a document that is mostly such spans goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontaminate.remove(spark, docs, items), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether decoding them gives its text back."""
    return sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), check=True).drop("text")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("sentencepiece", encoded),
]

#: Mixture inference, dart signatures and segmentation are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not source:
            forget(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
