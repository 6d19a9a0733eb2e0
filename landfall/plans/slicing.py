"""Slice of cleaned tables by a user selection, with both guards attached."""

from __future__ import annotations

from pyspark.sql import functions as F

from landfall.config import Params, Selection
from landfall.functions.dates import month_spine
from landfall.operators.filters import (empty_like, enough_rows, slice_codes, slice_dates,
                                        stations_of)
from landfall.operators.joins import keep_with
from landfall.operators.spatial import mark_selected
from landfall.tables import Tables


def slice_tables(clean: Tables, sel: Selection, params: Params) -> tuple[Tables, object]:
    """Tables restricted to the selection, and the month spine of its window.

    Reported trips: date strictly inside the window, municipality, habitat,
    gear and boat type selected. Tracked trips: the same, by the stations of the
    selected municipalities. Landings and points follow their trips: stored
    children carry their trip's attributes and take the same filters (no join,
    no shuffle); otherwise a semi join on the trip key. Municipalities: the selected ones, fleet counts of an unselected
    boat type set to 0. Shape: selected polygons recoloured.

    Guards: a dimension with nothing selected gives empty tables; fewer than
    ``min_trips`` sliced trips blank every table. The second is a scalar
    subquery evaluated inside each job, never a driver-side count first.
    """
    lab = params.labels
    codes = sel.codes(lab)
    spark = clean.trips.sparkSession
    spine = month_spine(spark, sel.start, sel.end)
    lo, hi = sel.start.replace(day=1), sel.end.replace(day=1)

    def months(df):
        """Prune month folders when the table is stored partitioned by month."""
        if df is None or "month" not in df.columns:
            return df
        return df.filter(F.col("month").between(F.lit(lo), F.lit(hi)))

    def rows(df, date, place, habitat, gear, boat, by_station=False):
        """The selection's row filters on ``df`` (pushed to the scan)."""
        df = slice_dates(months(df), sel.start, sel.end, date)
        if by_station:
            df = df.join(stations_of(clean.stations, codes["sites"])
                         .withColumnRenamed("station_code", place), place, "left_semi")
        else:
            df = slice_codes(df, place, codes["sites"])
        df = slice_codes(df, habitat, codes["habitats"])
        df = slice_codes(df, gear, codes["gears"])
        return slice_codes(df, boat, codes["boats"])

    def children(child, parent, key, by_station=False):
        """Children of the sliced parents: a plain filter when the stored child
        carries its parent's attributes, else a semi join on the key."""
        if "trip_date" in child.columns:
            place = "trip_station" if by_station else "trip_municipality"
            return rows(child, "trip_date", place, "trip_habitat", "trip_gear", "trip_boat",
                        by_station).filter(guard)
        return keep_with(months(child), parent, key)

    t = rows(clean.trips, "date", "municipality_code", "habitat_code", "gear_code", "boat_code")
    out = clean
    if sel.is_empty(lab):
        blank = {k: empty_like(v) for k, v in clean.items()}
        return clean.replace(**blank), empty_like(spine)
    guard = enough_rows(t, params.min_trips)
    t = t.filter(guard)
    out = out.replace(trips=t)
    if clean.landings is not None:                   # day states come without
        out = out.replace(landings=children(clean.landings, t, "trip_id"))
    if clean.pds_trips is not None:
        p = rows(clean.pds_trips, "date", "station_code", "habitat_code", "gear_code",
                 "boat_code", by_station=True).filter(guard)
        out = out.replace(pds_trips=p,
                          pds_points=children(clean.pds_points, p, "PDS_trip", by_station=True))
    if clean.municipalities is not None:
        m = slice_codes(clean.municipalities, "municipality_code", codes["sites"])
        if 1 not in codes["boats"]:
            m = m.withColumn("canoes", F.lit(0))
        if 2 not in codes["boats"]:
            m = m.withColumn("motors", F.lit(0))
        out = out.replace(municipalities=m.filter(guard))
    if clean.shape is not None:
        out = out.replace(shape=mark_selected(clean.shape, sel.sites).filter(guard))
    return out, spine.filter(guard)
