"""Trip-level quality rules. Every rule discards whole trips together with their
children, so the rules commute and are evaluated in one pass where possible."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfall.functions.columns import kg_sum
from landfall.operators.joins import keep_with


def landing_trip_flags(landings: DataFrame, required, ok_flags) -> DataFrame:
    """One row per trip in ``landings``: ``incomplete`` (a landing misses a
    required value), ``bad_flag`` (a landing's flag is outside ``ok_flags``; a
    NULL flag counts as outside) and the trip's ``KG``. One aggregation with
    partial aggregation map-side, so a trip with very many landings collapses
    before the shuffle."""
    miss = None
    for c in required:
        miss = F.col(c).isNull() if miss is None else (miss | F.col(c).isNull())
    bad = ~F.coalesce(F.col("flag_code").isin(list(ok_flags)), F.lit(False))
    return landings.groupBy("trip_id").agg(
        F.bool_or(miss).alias("incomplete"), F.bool_or(bad).alias("bad_flag"),
        kg_sum("weight_g").alias("KG"))


def valid_date(col: str, min_date: dt.date, as_of: dt.date) -> Column:
    """Date not before ``min_date`` and before ``as_of``; a NULL date passes."""
    d = F.col(col)
    return F.coalesce(~((d < F.lit(min_date)) | (d >= F.lit(as_of))), F.lit(True))


def cpue_ok(cap: float, kg: str = "KG", effort: str = "trip_effort") -> Column:
    """KG / effort at most ``cap`` (an undefined ratio passes)."""
    return ~F.coalesce(F.try_divide(F.col(kg), F.col(effort)) > F.lit(cap), F.lit(False))


def cutoff(trips: DataFrame, landings: DataFrame, before: dt.date, col: str = "date"
           ) -> tuple[DataFrame, DataFrame]:
    """Study cut-off: trips dated before ``before`` and the landings of those trips."""
    t = trips.filter(F.col(col) < F.lit(before))
    return t, keep_with(landings, t, "trip_id")
