"""Smoothed daily series: one weighted smoothing spline per series.

One of the two steps that run Python on the data path (the other is the donor
block search). Each group handed to the function is one series of the daily
aggregate, which has at most one row per day of the report window, so a group
is bounded regardless of data size; Spark partitions the series and Arrow
moves them in batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.functions import spline
from landfall.functions.spline import smooth_fit

# The spline is shipped with the task (pure numpy), so executors need no copy
# of this package installed.
cloudpickle.register_pickle_by_value(spline)


def smooth_series(df: DataFrame, key: str, x: str, y: str, w: str, spar: float,
                  out: str = "fit") -> DataFrame:
    """``out`` = smoothing-spline fit of ``y`` on the day number of ``x``,
    weighted by ``w``, per ``key``."""
    cols = df.columns if out in df.columns else df.columns + [out]
    base = df if out in df.columns else df.withColumn(out, F.lit(None).cast("double"))
    base = base.withColumn("_x", F.unix_date(F.col(x)).cast("double"))
    schema = base.schema

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        pdf[out] = smooth_fit(pdf["_x"].to_numpy(), pdf[y].to_numpy(dtype=float),
                              pdf[w].to_numpy(dtype=float), spar)
        return pdf

    return base.groupBy(key).applyInPandas(fit_group, schema=schema).select(*cols)
