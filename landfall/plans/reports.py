"""Reports: monthly summary with raised national catch, the summary table with
its Total row, chart tables, daily series, top species and the heat grid, and
the dashboard bundle of all of them (lazy frames: only the asked one runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.config import Params, Selection
from landfall.functions.columns import log_axis, to_tonnes
from landfall.operators.aggregates import (daily_cpue, daily_series, daily_sums, fleet_size,
                                           monthly_cpue, national_catch, species_catch,
                                           species_share, top_species, with_total)
from landfall.operators.spatial import cell_boxes, heat, heat_classes
from landfall.tables import Tables

SUMMARY = ("month", "fishing_days", "trips", "trip_effort", "KG", "CPUE", "natcatch")


def monthly_summary(sliced: Tables, spine: DataFrame, sel: Selection, params: Params
                    ) -> DataFrame:
    """Per month: fishing days, trips, effort, KG, CPUE and national catch (t)."""
    m = monthly_cpue(sliced.trips, spine)
    codes = sel.codes(params.labels)
    fleet = fleet_size(sliced.municipalities, codes["boats"])
    m = national_catch(m, fleet, params, sel.raising_enabled(params.labels))
    return m.select(*SUMMARY).orderBy("month")  # one row per month: a tiny sort


def summary_table(summary: DataFrame, sel: Selection, params: Params) -> DataFrame:
    """Display table: months as ``Mar-2019`` plus a Total row; days, trips,
    effort, KG and national catch truncated to integers, CPUE rounded to 2
    places (half to even). National catch only when every gear and habitat is
    selected."""
    t = with_total(summary)
    show_nat = sel.raising_enabled(params.labels)
    cols = [
        F.when(F.col("is_total"), F.lit("Total"))
        .otherwise(F.date_format("month", "MMM-yyyy")).alias("Month"),
        F.col("fishing_days").cast("bigint").alias("fishing_days"),
        F.col("trips").cast("bigint").alias("trips"),
        F.col("trip_effort").cast("bigint").alias("trip_effort"),
        F.col("KG").cast("bigint").alias("KG"),
        F.bround("CPUE", 2).alias("CPUE"),
    ]
    if show_nat:
        cols.append(F.col("natcatch").cast("bigint").alias("natcatch"))
    return t.orderBy("is_total", "month").select(*cols)


def with_headings(table: DataFrame) -> DataFrame:
    """Display headings of the summary table (six or seven columns)."""
    from landfall.sources.snapshot import HEADINGS
    names = dict(zip(("Month",) + SUMMARY[1:], HEADINGS))
    return table.withColumnsRenamed({c: names[c] for c in table.columns if c in names})


def monthly_chart(summary: DataFrame) -> DataFrame:
    """Bar-chart table: tonnes, effort and CPUE per month, the tick date
    (month + 3 days), its label and the CPUE axis limit 1.5 x max CPUE."""
    top = summary.agg(F.max("CPUE")).scalar()
    return summary.select(
        "month", to_tonnes("KG").alias("Tonnes"), "trip_effort", "CPUE",
        F.date_add("month", 3).alias("tick"),
        F.date_format("month", "MMM-yyyy").alias("tick_label"),
        (top * 1.5).alias("ylim"))


DIMENSIONS = {"site": ("municipality_code", "sites"), "habitat": ("habitat_code", "habitats"),
              "gear": ("gear_code", "gears")}


def daily(sliced: Tables, dim: str, sel: Selection, params: Params,
          min_days: int | None = None) -> DataFrame:
    """Daily CPUE series by place, habitat or gear, fitted with the selection's
    smoothing strength."""
    col, lab = DIMENSIONS[dim]
    return daily_cpue(sliced.trips, col, getattr(params.labels, lab),
                      params.min_days if min_days is None else min_days, sel.spar)


def daily_all(sliced: Tables, sel: Selection, params: Params, hold=lambda df: df) -> dict[str, DataFrame]:
    """The three daily series from one pass over the trips. ``hold`` may keep the sums
    (at most one row per day and code of each dimension) for the three."""
    sums = hold(daily_sums(sliced.trips, [col for col, _ in DIMENSIONS.values()]))
    return {name: daily_series(sums.where(F.col("dim") == col), getattr(params.labels, lab), params.min_days, sel.spar)
            for name, (col, lab) in DIMENSIONS.items()}


def daily_chart(series: DataFrame) -> DataFrame:
    """Log-scaled chart position of each fitted value."""
    return series.withColumn("y", log_axis("fit"))


def top(sliced: Tables, params: Params) -> DataFrame:
    return top_species(species_catch(sliced.landings), sliced.species, params.top_n,
                       params.other_code)


def dashboard(sliced: Tables, spine: DataFrame, sel: Selection, params: Params,
              held: list | None = None) -> dict[str, DataFrame]:
    """Every result of one selection, as lazy frames. With a list ``held``, the sliced
    trips and the small results that several others read (months, top species, grid
    cells) are kept in executor memory and added to it, for the caller to unpersist; a
    lost block is recomputed from its lineage, which over stored tables is a scan."""
    def hold(df: DataFrame) -> DataFrame:
        if held is None:
            return df
        held.append(df.persist())
        return held[-1]

    sliced = sliced.replace(trips=hold(sliced.trips))
    summary = hold(monthly_summary(sliced, spine, sel, params))
    sp = hold(top(sliced, params))
    h = hold(heat(sliced.pds_points)) if sliced.pds_points is not None else None
    out = {
        "monthly": summary,
        "table": with_headings(summary_table(summary, sel, params)),
        "chart": monthly_chart(summary),
        **daily_all(sliced, sel, params, hold),
        "species": sp,
        "share": species_share(sp),
    }
    if sliced.shape is not None:
        out["shape"] = sliced.shape
    if h is not None:
        out["heat"] = h
        out["heat_boxes"] = cell_boxes(h, params.cell_half)
        out["heat_classes"] = heat_classes(h, params.heat_bins)
    return out
