"""Corpus pipeline: documents are filtered for quality, near-deduplicated, decontaminated, cleared of PII and mixed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes
as Parquet and rereads as the next one's docs. All but the last return the columns of documents.

Defined results: a null text is judged and compared as the empty text and stays null; null ids are kept, the classifiers score them
like any other; of rows that repeat id and text one stays; without labels no document is rejected, without benchmark items none
leaks; an empty table passes through as an empty table; columns beyond those of documents are carried along by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, mixing, pii, quality, simhash
from spanloom.scratch import discard, settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target shares of their sources, in global random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_pii),
    ("mixing", mix_sources),
]

#: Boosted trees and SimHash have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = settle(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
