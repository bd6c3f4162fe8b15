"""One registered query for each text operator, with its production parameters, and the check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.llm import (
    bpe, decontaminate, filter_audit, kd_shards, main_text, pivots, prefix_trie, quality, secrets, simhash, suffix_repeats,
    token_counts, url_trust)
from shoplake.llm.shared import table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LEAST_COSINE = 0.98
TOKEN_LIMIT = 4096
LEAST_QUALITY = 0.7
SHARDS = 8


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), LEAST_COSINE)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return url_trust.judge_pages(table(spark, sf_dir, "pages"), RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn from: a quarter of the ids is held out."""
    return table(spark, sf_dir, "labels").where(~held_out())


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, training_labels(spark, sf_dir))
    return quality.score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = kd_shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                         F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that a smaller document has too."""
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, at most four differing bits."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract_pages(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in all orders of the filters."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shared prefixes of the rebuilt conversations."""
    turns, convs = prefix_trie.spliced(prefix_trie.turn_ids(table(spark, sf_dir, "conversations")), every=5, choices=9)
    return prefix_trie.trie_nodes(turns, convs).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_vectors, op2_bpe_codec, op3_url_filter, op4_token_counts, op5_decontaminate, op6_quality,
                                   op7_kd_shards, op8_suffix_repeats, op9_simhash, op10_secrets, op11_main_text, op12_filter_audit,
                                   op13_prefix_trie)}


def checks() -> dict[str, str]:
    return {"op12_filter_audit": filter_audit.AUDIT_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
