"""Corpus preparation as a chain of stages, each reading what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import materialize, ship, stage
from haze.llm.decontaminate import drop_contaminated
from haze.llm.language_id import UNKNOWN, languages, train
from haze.llm.near_dedup import drop_near_duplicates
from haze.llm.packing import pack
from haze.llm.substring_dedup import remove_repeats


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be recognised."""
    ship(spark)
    with stage(docs):
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
        return languages(rows, train(docs)).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on five-word shingles)."""
    ship(spark)
    with stage(docs):
        return drop_near_duplicates(docs)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has; n_chars follows the text."""
    ship(spark)
    with stage(docs):
        return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    with stage(docs):
        return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    ship(spark)
    with stage(docs):
        return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", _language),
    ("near-duplicates", _near_duplicates),
    ("substring dedup", _repeats),
    ("benchmark decontamination", _benchmark),
    ("packing", _packing),
]

#: The stages' results cannot be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir))
    return docs
