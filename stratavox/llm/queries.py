"""The corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, media, mixing, neardup, packing, pii, quality, substrings, toxicity, warc
from .common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as stored NPY tiles, with what is read back from them."""
    return media.store_media(read_table(spark, sf_dir, "documents"), keep_bytes=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, family first."""
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.sample_and_fit(docs))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 20-word windows that occur earlier."""
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the chain's verdict for every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_chain(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into sequences of 2048."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with format-preserving pseudonyms for its personal values."""
    return pii.pseudonymise_texts(read_table(spark, sf_dir, "documents"), pii.key_of(spark))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record to seekable bundles and read back from them."""
    return warc.read_bundles(warc.archive(read_table(spark, sf_dir, "pages")))


def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 4-word shingles."""
    return neardup.near_groups(read_table(spark, sf_dir, "documents"), width=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_media_columns": op2_media_columns,
        "op3_language_id": op3_language_id,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_mix_sources": op5_mix_sources,
        "op6_quality_rules": op6_quality_rules,
        "op7_pack_sequences": op7_pack_sequences,
        "op8_pseudonyms": op8_pseudonyms,
        "op9_warc_bundles": op9_warc_bundles,
        "op10_minhash_groups": op10_minhash_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": substrings.repeats_sql(),
        "op5_mix_sources": mixing.mix_sql(),
        "op9_warc_bundles": warc.warc_sql(),
        "op10_minhash_groups": neardup.groups_sql(),
    }
