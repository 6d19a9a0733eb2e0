"""Column expressions and storage helpers shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfall.session import checkpoint_dir, materialize

__all__ = ["WORD", "GAPS", "documents", "lower_ascii", "words", "id_crc", "store", "table",
           "row_keys", "distinct_rows", "repeated"]

WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lower_ascii(c: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay. Text of ASCII alone has no other
    letters and takes the faster function."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), GAPS, -1), "")


def id_crc(c: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there."""
    return materialize(df, f"llm-{name}")


def row_keys(docs: DataFrame) -> DataFrame:
    """Rows with a 96-bit key of all their columns; equal rows have equal keys. Hashes pass
    over nulls, so whether a column is null is hashed, too; nested columns as JSON."""
    parts = []
    for f in docs.schema.fields:
        c = docs[f"`{f.name}`"]
        nested = f.dataType.typeName() in ("array", "map", "struct", "variant")
        parts += [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c, c.isNull()]
    return docs.withColumns({"_llm_k1": F.xxhash64(*parts), "_llm_k2": F.hash(F.lit(7), *parts)})


def distinct_rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key: the columns as a struct ``row`` and how often the row stands."""
    return keyed.groupBy("_llm_k1", "_llm_k2").agg(
        F.first(F.struct(*[f"`{c}`" for c in columns])).alias("row"), F.count(F.lit(1)).alias("copies"))


def repeated(df: DataFrame, chunk: int = 8192) -> DataFrame:
    """Each row as often as its column ``copies`` says, without that column. A row that stands
    more than ``chunk`` times is cut into chunks that go to different tasks first."""
    few = F.col("copies") <= chunk
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk)))
    many = df.where(~few).withColumn("_llm_part", part).repartition(tasks, "_llm_part").withColumn(
        "copies", F.least(F.lit(chunk).cast("long"), F.col("copies") - F.col("_llm_part") * chunk)).drop("_llm_part")
    every = df.where(few).unionByName(many)
    return every.withColumn("_llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_llm_copy", "copies")
