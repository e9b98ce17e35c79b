"""The corpus pipeline: documents through five stages to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from ruleweave.llm.common import forget, materialize, scratch
from ruleweave.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language of the model; texts in none, and texts without words, go."""
    return language_id.drop_unidentified(docs, language_id.fit(docs, "doc_id"), F.col("source"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the least doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("decontaminate", remove_leaks),
    ("pack", pack_sequences),
]

#: Language models, sketches and a packing search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read back before the next. What a
    stage wrote besides its rows is deleted then, and so are the rows of the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            kept = materialize(stage(spark, docs, sf_dir), name)
        if n:
            forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
