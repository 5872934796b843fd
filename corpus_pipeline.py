"""A corpus pipeline: language ID, line dedup, n-gram near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that `run` writes as Parquet and reads
again as the docs of the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafact.llm import language, lines, ngram_join, packing, repeats
from terrafact.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose language is not recognised go (no letters, or a calibrated
    probability under one half); `lang` is left as given."""
    return language.accepted_rows(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines similar to an earlier line go, and documents of which nothing is left."""
    return sized(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, five words and a similarity of 0.8: one document of each group stays."""
    return ngram_join.first_of_each(docs, k=5, num=8, den=10)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: byte strings of 100 bytes that also start earlier go."""
    return sized(repeats.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document's length bucket and batch."""
    return packing.pack(docs, packing.n_words("text"))


def sized(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Training and byte indexes have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
