"""Position density grid of tracked trips, its map rectangles and colour classes,
and the marking of the selected places' polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfall.config import SELECTED_COLOUR
from landfall.functions.columns import split_latlng


def heat(points: DataFrame, col: str = "latlng") -> DataFrame:
    """Points per position cell, split into Lat and Lng. NULL cells are ignored.
    On deduplicated points this counts distinct trips per cell. A very busy cell
    is pre-counted map-side before the shuffle."""
    g = points.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("counts"))
    lat, lng = split_latlng(col)
    return g.select(lat.alias("Lat"), lng.alias("Lng"), "counts")


def cell_boxes(h: DataFrame, half: float = 0.002) -> DataFrame:
    """Rectangle corners of each cell: Lat/Lng plus and minus ``half`` degrees."""
    return h.select("Lat", "Lng", "counts",
                    (F.col("Lng") - half).alias("lng1"), (F.col("Lat") - half).alias("lat1"),
                    (F.col("Lng") + half).alias("lng2"), (F.col("Lat") + half).alias("lat2"))


def intensity(counts="counts") -> Column:
    """round(ln(count) + 1), rounding half to even."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return F.bround(F.log(c) + F.lit(1.0), 0)


def pretty_unit(top: Column, bins: int) -> Column:
    """Step of R's ``pretty`` breaks for the range 0..top in about ``bins`` classes
    (high bias 1.5, five bias 2.75)."""
    c = top / F.lit(float(bins))
    base = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    h1 = (2 * base - c) < 1.5 * (c - base)
    h2 = h1 & ((5 * base - c) < 2.75 * (c - 2 * base))
    h3 = h2 & ((10 * base - c) < 1.5 * (c - 5 * base))
    return F.when(h3, 10 * base).when(h2, 5 * base).when(h1, 2 * base).otherwise(base)


def heat_classes(h: DataFrame, bins: int = 7) -> DataFrame:
    """Intensity of each cell and its colour class (1-based) on the pretty
    breaks of 0..max intensity; classes are closed on the left, and the top
    break belongs to the last class.

    The breaks come from one global aggregate attached as a single scalar
    subquery column (no window that would move the grid into one partition,
    and the subquery is planned once rather than per reference)."""
    v = h.withColumn("intensity", intensity())
    top = F.max("intensity")
    unit = pretty_unit(top, bins)
    brk = v.agg(F.struct(unit.alias("step"),
                         F.ceil(top / unit - F.lit(1e-10)).cast("int").alias("n"))).scalar()
    v = v.withColumn("_b", brk)
    return v.select(
        "Lat", "Lng", "counts", "intensity",
        F.least(F.floor(F.col("intensity") / F.col("_b.step")) + 1, F.col("_b.n"))
        .cast("int").alias("class"),
        F.col("_b.n").alias("n_classes"), F.col("_b.step").alias("step"))


def mark_selected(shape: DataFrame, sites, value: str = SELECTED_COLOUR) -> DataFrame:
    """Colour of the polygons of the selected places set to ``value``."""
    return shape.withColumn("colr", F.when(F.col("id").isin(list(sites)), F.lit(value))
                            .otherwise(F.col("colr")))
