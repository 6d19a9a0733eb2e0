"""Slices and guards: date window, place, habitat, gear and boat type, the
empty-selection and minimum-sample guards, and the sparse-series rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_dates(df: DataFrame, start: dt.date, end: dt.date, col: str = "date") -> DataFrame:
    """Rows strictly between ``start`` and ``end`` (both ends excluded)."""
    d = F.col(col)
    return df.filter((d > F.lit(start)) & (d < F.lit(end)))


def slice_codes(df: DataFrame, col: str, codes) -> DataFrame:
    """Rows whose code is among ``codes``; NULL and codes outside the list drop.
    A literal list, so the predicate reaches the Parquet scan."""
    return df.filter(F.col(col).isin(list(codes)))


def stations_of(stations: DataFrame, municipality_codes) -> DataFrame:
    """Station codes that belong to the selected municipalities."""
    return stations.filter(F.col("municipality_code").isin(list(municipality_codes))
                           ).select("station_code")


def empty_like(df: DataFrame) -> DataFrame:
    """Same schema, no rows (the optimiser prunes the scan)."""
    return df.filter(F.lit(False))


def enough_rows(df: DataFrame, n: int) -> Column:
    """Lazy guard: a scalar subquery that is true when ``df`` has at least ``n``
    rows. Evaluated inside the job that uses it, never on the driver first.
    The question is only "are there ``n`` rows?", so the subquery stops after
    ``n`` rows per task instead of counting the whole slice; the answer is exact
    and no result row is ever dropped by it. Day states stand for at least a trip each,
    so ``n`` of them are enough, too."""
    one = F.col("n_trips") if "n_trips" in df.columns else F.lit(1)
    return df.limit(n).agg((F.coalesce(F.sum(one), F.lit(0)) >= F.lit(n)).alias("ok")).scalar()


def min_rows(df: DataFrame, n: int = 30) -> DataFrame:
    """``df`` when it has at least ``n`` rows, else empty with the same schema."""
    return df.filter(enough_rows(df, n))


def min_points(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Series (rows per ``key``) with fewer than ``n`` rows removed. Used on daily
    aggregates: a series has at most one row per day, so a window partition is
    bounded by the number of days in the window."""
    w = Window.partitionBy(key)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= n).drop("_n")
