"""Registered queries: each operator over its whole table, with production parameters.

A query is a thin layer that turns its operator's output into the agreed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfall.llm import (centroids, fill_middle, language_id, license_scan, minhash, mixing, neighbours, packing,
                          pitman_yor, quality_hosts, secret_scan, simhash, suffix_dedup)
from landfall.llm.oracle import SQL  # noqa: F401
from landfall.llm.text import documents, id_crc, table

PACK_TOKENS = 1024


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and notices in every document."""
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op2_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts, hosts' verdicts included, of every document."""
    return quality_hosts.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fails", "host_condemned")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that stand elsewhere."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, a digest of the base spans, all spans."""
    return secret_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base_text").cast("binary"), 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of nine tenths of them."""
    d = documents(spark, sf_dir)
    held = id_crc(F.col("doc_id")) % 10 == 0
    return pitman_yor.score(d, held, *pitman_yor.fit(d.where(~held)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from three quarters of them."""
    d = documents(spark, sf_dir)
    held = id_crc(F.col("doc_id")) % 4 == 2
    model = language_id.learn(d.where(~held))
    return language_id.predict(d, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document's tokens, one sequence each, by bucket of length."""
    return packing.bucketed(packing.decompose(documents(spark, sf_dir), tokenizer_path(), PACK_TOKENS, with_ids=False)).drop("ids")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row of embeddings whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=10)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by word pairs: component of every document."""
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every row of embeddings after three rounds, with the inertia."""
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, with digests of its output and of the text rebuilt from that."""
    t = fill_middle.transform(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                    digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_hosts, op3_suffix_dedup, op4_secret_scan, op5_mixing, op6_pitman_yor, op7_simhash, op8_language_id, op9_packing,
    op10_neighbours, op11_minhash, op12_centroids, op13_fill_middle)}
