"""A training corpus from raw documents: classify, near-dedup, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text where a stage changes it.

In every stage: null and empty texts are empty documents (the classifier scores them, near-dedup keeps one, the cut drops
them, packing gives them an end id); rows without doc_id are kept apart by their text; of repeated rows near-dedup keeps
one; ties go to the least doc_id; an empty table gives an empty one; texts of any length are taken whole; other columns,
whatever their names, are carried along up to the mixture. Labels are only read by the classifier; without usable labels
every document has one score and either all stay or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, mixing, packing, quality, suffix
from ledgerloom.llm.common import materialise, parquet
from ledgerloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, parquet(ship(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of 0.8 and more of common five-word shingles join: that of least doc_id.

    SimHash's multi-index search finds the closest pairs, a prefix join on the shingles all others (see jaccard.py).
    """
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (or 400 bytes) that occur elsewhere too.

    Documents of which nothing is left go, and so do those without any text before.
    """
    ship(spark)
    cut = suffix.remove_repeats(docs)
    left = cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut
    return left.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same share of the mixture; a row per copy, in random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: Model training, fingerprints, suffixes and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
