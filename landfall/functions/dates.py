"""Month floors, the default report window and the month spine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_floor(col) -> Column:
    """First day of the month of a date."""
    return F.trunc(F.col(col) if isinstance(col, str) else col, "month")


def _floor_month(d: dt.date) -> dt.date:
    return d.replace(day=1)


def default_window(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Default start and end for a report made on ``as_of``.

    Start: first day of the month one year before (on 29 February the day before
    is used, which lies in the same month). End: the day before the first day of
    the current month.
    """
    try:
        back = as_of.replace(year=as_of.year - 1)
    except ValueError:
        back = (as_of - dt.timedelta(days=1)).replace(year=as_of.year - 1)
    return _floor_month(back), _floor_month(as_of) - dt.timedelta(days=1)


def default_window_cols(as_of) -> tuple[Column, Column]:
    """:func:`default_window` as column expressions (``add_months`` clamps 29 Feb
    to 28 Feb, which is in the same month, so the floor is the same)."""
    c = F.col(as_of) if isinstance(as_of, str) else as_of
    return (F.trunc(F.add_months(c, -12), "month"),
            F.date_sub(F.trunc(c, "month"), 1))


def month_spine(spark: SparkSession, start: dt.date, end: dt.date,
                col: str = "month") -> DataFrame:
    """Every month from the month of ``start`` to the month of ``end``, even empty
    ones. Size is the number of months in the window."""
    if end < start:
        raise ValueError(f"end {end} is before start {start}")
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(_floor_month(start)), F.lit(_floor_month(end)),
        F.expr("INTERVAL 1 MONTH"))).alias(col))
