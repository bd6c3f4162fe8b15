"""Corpus pipeline: one operator after another over `documents`, each on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoplake.llm import bpe, decontaminate, quality, secrets, simhash
from shoplake.llm.queries import LEAST_QUALITY, training_labels
from shoplake.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go, by a classifier fitted on the labelled ones.

    A null text scores as an empty one; without labels every text scores one half and goes.
    """
    return quality.keep_good(docs, quality.fit(docs, training_labels(spark, sf_dir)), LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the smallest doc_id stays; rows without doc_id stay.

    Null and empty texts are copies of each other.
    """
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of the benchmark go; null and empty texts stay, and all without a benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays, a null text as null."""
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each text, and digests of them and of what they decode to; a null text counts as empty."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_poor), ("near_dedup", drop_copies), ("decontaminate", drop_leaks),
    ("secret_scan", scan_secrets), ("bpe_encode", encode)]

# Tokenizing and fitted scores are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored before the next one reads it.

    An empty table passes through all of them; further columns of documents pass all but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
