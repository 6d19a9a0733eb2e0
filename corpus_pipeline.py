"""Pipeline over ``documents``: language ID, SimHash near-dedup, secret scan, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame that is written and read again as the next one's documents. All but
the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landfall.llm import language_id, mixing, packing, secret_scan, simhash  # noqa: E402
from landfall.llm.queries import PACK_TOKENS, tokenizer_path  # noqa: E402
from landfall.llm.text import documents, id_crc, store  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the labelled rows; documents without a letter, or
    whose n-grams belong to no learnt language, go."""
    model = language_id.learn(docs.where(id_crc(F.col("doc_id")) % 4 != 2))
    return language_id.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    return secret_scan.drop_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.apply_mix(docs, store(mixing.mix(docs), "mixed"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences with their ids, by bucket of length."""
    return packing.bucketed(packing.decompose(docs, tokenizer_path(), PACK_TOKENS))


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]

# A tokenizer and a learnt model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{name}")
    return docs
