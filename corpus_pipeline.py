"""The corpus pipeline: language ID, near-dedup, substring dedup, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import langid, minhash, packing, pii, substr
from tarn.llm.common import stored
from tarn.runtime import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; those without letters or without a clear language go."""
    ship_package(spark)
    return langid.in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of near copies (five words, 0.8 or more)."""
    ship_package(spark)
    return minhash.one_of_each(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 20 or more words that occur in an earlier place out of the texts; all rows stay."""
    ship_package(spark)
    return substr.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; all rows stay."""
    ship_package(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row for each piece."""
    ship_package(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", personal_data),
    ("packing", pack),
]

#: A trained network and merge rounds are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
