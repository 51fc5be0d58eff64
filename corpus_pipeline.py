"""A corpus pipeline: toxic documents go, recurring lines go, one of each group of near duplicates stays, documents that
hold a benchmark item go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written and read again
before the next. The first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm import decontaminate, line_dedup, ngram_join, pieces, toxicity
from placewright.plans.tables import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, labels, toxicity.learned_from())


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the digest of the encoding."""
    import public_tokenizers

    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return pieces.digest(encoded, "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: Training, sketches and segmentation can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
