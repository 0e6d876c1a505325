"""A corpus from documents to packed sequences: quality, near duplicates, pseudonyms, mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns the
columns of ``docs``, but for the last, which returns the pieces of the packed sequences.  Null texts
fail the quality stage; an empty table goes through all stages as an empty table; further columns
travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm import mixing, neardup, packing, pii, quality
from stratavox.llm.common import mark, read_table, release, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line chain keep."""
    return quality.filter_quality(docs, quality.fit_chain(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near duplicates (5 words, similarity 0.8)."""
    return neardup.keep_first(docs)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal values replaced."""
    return pii.pseudonymise_column(docs, pii.key_of(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fitted chain, the Feistel rounds or the search for packings; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=1)  # what the stage stored on its way; its own output stays
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
