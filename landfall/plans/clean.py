"""Cleaning of refreshed tables by the trip-level quality rules.

One lazy plan. The landing rules (incomplete landing, flag outside the allowed
set) and the trip catch come from a single aggregation of landings by trip, so
landings are shuffled once for it; the trip rules are row filters on trips
joined to that aggregate. Because every rule removes whole trips, the rules
commute and the catch of a surviving trip does not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.config import Params
from landfall.functions.columns import clamp, nan_to_null, parse_date, patch, recode
from landfall.functions.dates import month_floor
from landfall.operators.discards import cpue_ok, landing_trip_flags, valid_date
from landfall.operators.joins import latest, lookup, without_key
from landfall.session import materialize
from landfall.tables import Tables

LANDING_REQUIRED = ("species_code", "length", "nfish", "weight_g", "flag_code")
# Trip attributes copied onto stored children, so that a slice filters landings
# and points directly (pushed down, month-pruned) instead of joining them.
TRIP_ATTRS = {"trip_date": "date", "trip_municipality": "municipality_code",
              "trip_habitat": "habitat_code", "trip_gear": "gear_code", "trip_boat": "boat_code"}
PDS_ATTRS = {"trip_date": "date", "trip_station": "station_code",
             "trip_habitat": "habitat_code", "trip_gear": "gear_code", "trip_boat": "boat_code"}
TRIP_REQUIRED = ("municipality_code", "habitat_code", "gear_code", "trip_effort")


def prepare_trips(trips: DataFrame, stations: DataFrame, params: Params) -> DataFrame:
    """Row-level steps on trips: parse the date, station -> municipality,
    clamp hours and effort, recode habitats, patch the IMEI."""
    t = parse_date(nan_to_null(trips))
    t = lookup(t, stations, "station_code", "municipality_code")
    t = clamp(t, "trip_hours", params.hours_zero_to, params.hours_max)
    t = clamp(t, "trip_effort", params.effort_zero_to, params.effort_max)
    t = recode(t, "habitat_code", dict(params.habitat_recode))
    cond = ((F.col("IMEI") == F.lit(params.patch_imei_from))
            & (F.col("date_numeric") > F.lit(params.patch_after)))
    return patch(t, "IMEI", cond, params.patch_imei_to)


def judge_trips(trips: DataFrame, flags: DataFrame, stations: DataFrame, params: Params
                ) -> tuple[DataFrame, DataFrame]:
    """Kept trips (with ``KG`` and ``month``) and the landing decision: one row
    per trip id whose landings stay, with the trip's month and slice attributes
    (NULL for a trip id that is not among the trips). Of a trip id that stands in
    several versions the newest counts, so landings are never multiplied; trips without
    an id are all judged, as trips without landings."""
    p = prepare_trips(trips, stations, params)
    t = latest(p, "trip_id", "date_numeric")
    j = t.join(flags, "trip_id", "left").withColumns({
        "incomplete": F.coalesce("incomplete", F.lit(False)),
        "bad_flag": F.coalesce("bad_flag", F.lit(False)),
        "KG": F.coalesce("KG", F.lit(0.0)),
    })
    j = j.unionByName(without_key(p, "trip_id").withColumns(
        {"incomplete": F.lit(False), "bad_flag": F.lit(False), "KG": F.lit(0.0)}))
    complete = None
    for c in TRIP_REQUIRED:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    keep = (~F.col("incomplete") & ~F.col("bad_flag") & complete
            & valid_date("date", params.min_date, params.as_of) & cpue_ok(params.cpue_cap))
    j = j.withColumns({"_keep": keep, "month": month_floor("date")})
    kept = j.filter("_keep").drop("_keep", "incomplete", "bad_flag")
    attrs = [F.col(c).alias(a) for a, c in TRIP_ATTRS.items()]
    decision = flags.select("trip_id", (F.col("incomplete") | F.col("bad_flag")).alias("_bad")).join(
        j.where(F.col("trip_id").isNotNull()).select("trip_id", "_keep", "month", *attrs), "trip_id", "left")
    decision = (decision.filter(F.coalesce(F.col("_keep"), ~F.col("_bad")))
                .select("trip_id", "month", *TRIP_ATTRS))
    return kept, decision


def clean_trips(trips: DataFrame, landings: DataFrame, stations: DataFrame, params: Params,
                with_month: bool = False, flags: DataFrame | None = None,
                decision: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean reported trips and their landings.

    Removed with all their landings: trips with an incomplete landing or a
    landing flag outside ``ok_flags``; trips without municipality, habitat,
    gear or effort; trips dated before ``min_date`` or on/after ``as_of`` (a
    NULL date stays, the date slice removes it); trips whose KG / effort exceeds
    ``cpue_cap``. Surviving trips carry their catch ``KG`` (0 without landings).

    Landings are decided per trip id: one row per trip id of the landings (the
    flag aggregate) meets the trip decision, and landings join that, so a
    landing whose trip is unknown survives unless its own trip id is flagged,
    as in the original. ``with_month`` adds the trip's month to both outputs
    (for storage partitioned by month). ``flags`` and ``decision`` may hold
    stored results of :func:`trip_flags` and :func:`judge_trips` so that
    landings are aggregated once and their final join reads two plain shuffles
    (which adaptive execution can split when one trip holds most landings).
    """
    flags = flags if flags is not None else trip_flags(landings, params)
    kept, lazy_decision = judge_trips(trips, flags, stations, params)
    decision = decision if decision is not None else lazy_decision
    lnd = landings.join(decision, "trip_id", "inner")
    if not with_month:
        kept, lnd = kept.drop("month"), lnd.drop("month", *TRIP_ATTRS)
    return kept, lnd


def trip_flags(landings: DataFrame, params: Params) -> DataFrame:
    """Per trip id of the landings: incomplete, bad_flag and KG."""
    return landing_trip_flags(nan_to_null(landings), LANDING_REQUIRED, params.ok_flags)


def band_flags(pds_points: DataFrame, params: Params) -> DataFrame:
    """Per tracked trip id of the points: whether a point lies in the excluded band."""
    return pds_points.groupBy("PDS_trip").agg(F.bool_or(F.coalesce(
        F.col("latlng").rlike(params.point_pattern), F.lit(False))).alias("_band"))


def judge_pds(pds_trips: DataFrame, band: DataFrame, params: Params
              ) -> tuple[DataFrame, DataFrame]:
    """Kept tracked trips (with ``month``) and the point decision: one row per
    tracked trip id whose points stay, with the trip's month and slice
    attributes (NULL for an unknown tracked trip)."""
    p = recode(parse_date(nan_to_null(pds_trips)), "habitat_code", dict(params.habitat_recode))
    newest = latest(p, "PDS_trip", "date_numeric" if "date_numeric" in p.columns else "date")
    p = newest.join(band, "PDS_trip", "left").unionByName(
        without_key(p, "PDS_trip").withColumn("_band", F.lit(False)).select(*newest.columns, "_band")).withColumns({
        "_keep": F.col("boat_code").isNotNull() & ~F.coalesce(F.col("_band"), F.lit(False)),
        "month": month_floor("date")})
    kept = p.filter("_keep").drop("_keep", "_band")
    attrs = [F.col(c).alias(a) for a, c in PDS_ATTRS.items()]
    decision = band.join(p.where(F.col("PDS_trip").isNotNull()).select(
        "PDS_trip", F.col("_keep").alias("_tk"), "month", *attrs), "PDS_trip", "left")
    decision = (decision.filter(F.coalesce(F.col("_tk"), ~F.col("_band")))
                .select("PDS_trip", "month", *PDS_ATTRS))
    return kept, decision


def clean_pds(pds_trips: DataFrame, pds_points: DataFrame, params: Params,
              with_month: bool = False, band: DataFrame | None = None,
              decision: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean tracked trips: parse dates, recode habitats, drop trips without a
    boat type and every trip with a point in the excluded band, each with its
    points. Points of unknown trips stay (the slice removes them) unless one of
    them lies in the band. One aggregation of points by trip finds the band."""
    band = band if band is not None else band_flags(pds_points, params)
    kept, lazy_decision = judge_pds(pds_trips, band, params)
    decision = decision if decision is not None else lazy_decision
    pts = pds_points.join(decision, "PDS_trip", "inner")
    if not with_month:
        kept, pts = kept.drop("month"), pts.drop("month", *PDS_ATTRS)
    return kept, pts


def clean(tables: Tables, params: Params, with_month: bool = False, stored: dict | None = None
          ) -> Tables:
    """Clean every table of a refreshed bundle (dimension tables pass through).
    ``stored`` may hold written flags/decisions (see :func:`persist_clean`)."""
    st = stored or {}
    out = tables
    if tables.trips is not None:
        t, lnd = clean_trips(tables.trips, tables.landings, tables.stations, params, with_month,
                             st.get("flags"), st.get("decision"))
        out = out.replace(trips=t, landings=lnd)
    if tables.pds_trips is not None:
        p, pts = clean_pds(tables.pds_trips, tables.pds_points, params, with_month,
                           st.get("band"), st.get("pds_decision"))
        out = out.replace(pds_trips=p, pds_points=pts)
    return out


def persist_clean(tables: Tables, params: Params, name: str = "clean") -> Tables:
    """Clean and write the four fact tables under the checkpoint folder,
    partitioned by month (landings and points carry their trip's month), and
    read them back. Later slices prune month folders on every table, and the
    written tables cut the lineage so a lost executor never re-runs cleaning.
    The per-trip landing flags and band flags are written first (one row per
    trip, far smaller than landings or points), so each large table is read
    once to aggregate and once to filter, however many outputs use them. The
    per-trip decisions are written too, so the final join of landings (and of
    points) reads two plain shuffles: if one trip holds a third of all landings,
    adaptive execution splits that partition instead of giving it to one task."""
    st: dict = {}
    if tables.trips is not None:
        st["flags"] = materialize(trip_flags(tables.landings, params), f"{name}-flags")
        st["decision"] = materialize(
            judge_trips(tables.trips, st["flags"], tables.stations, params)[1], f"{name}-decision")
    if tables.pds_trips is not None:
        st["band"] = materialize(band_flags(tables.pds_points, params), f"{name}-band")
        st["pds_decision"] = materialize(
            judge_pds(tables.pds_trips, st["band"], params)[1], f"{name}-pds-decision")
    c = clean(tables, params, with_month=True, stored=st)
    out = {}
    for k in ("trips", "landings", "pds_trips", "pds_points"):
        df = getattr(c, k)
        if df is not None:
            out[k] = materialize(df, f"{name}-{k}", partition_by=["month"])
    return c.replace(**out)
