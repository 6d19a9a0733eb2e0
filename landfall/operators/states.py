"""Day states: cleaned trips summed by day, place, habitat, gear and boat type.

A state stands for its trips in every result that sums them (months, daily series, the
30-trip guard): sums of sums in decimals are the trips' sums, and a month's fishing days
are the distinct days of its states. A selection's date limits fall inside months, so states are
by day and not by month. They are kept by month: after a refresh only the months that it
rewrote are summed again, from their trips, and the others' states stay; a trip that
changed or left its month is then right without being subtracted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.functions.dates import month_floor

BY = ("date", "municipality_code", "habitat_code", "gear_code", "boat_code")


def day_states(trips: DataFrame) -> DataFrame:
    """One row per day and combination of codes: KG, trip_effort, n_trips and the month."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).alias(c)
    d = trips.groupBy(*BY).agg(exact("KG"), exact("trip_effort"), F.count(F.lit(1)).alias("n_trips"))
    return d.withColumn("month", month_floor("date"))


def refresh_states(old: DataFrame, trips: DataFrame, months: Iterable) -> DataFrame:
    """The states after a refresh that rewrote ``months`` (dates; None for trips without a
    date), whose cleaned trips are ``trips``."""
    months = list(months)
    dated = [m for m in months if m is not None]
    again = F.col("month").isin(dated) if dated else F.lit(False)
    again = F.coalesce(again, F.lit(None in months))
    return old.where(~again).unionByName(day_states(trips))
