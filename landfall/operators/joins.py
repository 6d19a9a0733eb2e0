"""Equi-join building blocks: lookup, keep-with (semi), drop-with (anti), catch
attachment and landing dates.

No broadcast hints are given for tables whose size grows with the data: Spark
converts a join to a broadcast only after checking the side's size against
``spark.sql.autoBroadcastJoinThreshold`` (statically from file sizes, and again
at run time under adaptive execution from the measured shuffle output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.functions.columns import kg_sum


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, out: str | None = None,
           keep_key: bool = False) -> DataFrame:
    """Left lookup of ``value`` by ``on`` (first match per key; keys of a dimension
    are unique, so the smallest value is taken to stay deterministic). No match
    gives NULL. The key column is replaced by the value unless ``keep_key``."""
    out = out or value
    d = dim.groupBy(on).agg(F.min(value).alias(out))
    j = df.join(d, on, "left")
    return j if keep_key else j.drop(on)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one with the largest ``by`` (NULL smallest), ties to the
    largest row. Partial aggregation keeps one row per key and task before the shuffle,
    and the shuffle is by ``key``, as the joins on it need anyway. Rows with a NULL key
    are no versions of each other and leave here: see :func:`without_key`."""
    rest = [c for c in df.columns if c not in (key, by)]
    order = F.struct(F.col(by).alias("_by"), *rest)
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_l"))
    picked = {by: F.col("_l._by"), **{c: F.col(f"_l.{c}") for c in rest}, key: F.col(key)}
    return one.select(*[picked[c].alias(c) for c in df.columns])


def without_key(df: DataFrame, key: str) -> DataFrame:
    """The rows with a NULL key, all of them. The filter reaches the scan, whose null counts
    skip row groups without such rows."""
    return df.where(F.col(key).isNull())


def keep_with(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None
              ) -> DataFrame:
    """Child rows whose key is among the parent keys (left semi join)."""
    pk = parent_key or key
    p = parent.select(F.col(pk).alias(key)) if pk != key else parent.select(key)
    return child.join(p, key, "left_semi")


def drop_with(child: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is not in ``bad`` (left anti join; a NULL in ``bad``
    never empties the result, unlike ``NOT IN``)."""
    return child.join(bad.select(key), key, "left_anti")


def trip_catch(landings: DataFrame, weight: str = "weight_g") -> DataFrame:
    """Catch weight per trip in KG (partial sums before the shuffle)."""
    return landings.groupBy("trip_id").agg(kg_sum(weight).alias("KG"))


def attach_catch(trips: DataFrame, landings: DataFrame) -> DataFrame:
    """Trip KG on every trip; 0 for a trip without landings."""
    return (trips.join(trip_catch(landings), "trip_id", "left")
            .withColumn("KG", F.coalesce(F.col("KG"), F.lit(0.0))))


def landing_dates(landings: DataFrame, trips: DataFrame, date: str = "date") -> DataFrame:
    """Each landing with the date of its trip (joined on the trip key)."""
    return landings.join(trips.select("trip_id", date), "trip_id", "inner")
