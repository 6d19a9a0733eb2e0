"""Registered queries: one per operator of the inventory, each over the
stand-in tables derived from the supplied test tables (see FIXTURES.md).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names match the SQL of :mod:`landfall.oracle`.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landfall import fixtures
from landfall.config import Labels, Params, Selection
from landfall.functions.columns import clip_low, log_axis, nan_to_null
from landfall.functions.dates import default_window_cols, month_floor
from landfall.operators.aggregates import (boat_cpue, fleet_size, monthly_cpue, national_catch,
                                           species_catch, species_share)
from landfall.operators.discards import cutoff
from landfall.operators.donor import (donate_attributes, donor_accuracy, nearest_donor,
                                      train_split, validate_donor)
from landfall.operators.joins import attach_catch, landing_dates
from landfall.operators.quality import (cascade_delete, check_fk, check_fk_new, check_fks, check_pk,
                                        check_pk_new, check_pks)
from landfall.operators.smooth import smooth_series
from landfall.operators.spatial import cell_boxes, heat, heat_classes
from landfall.plans.clean import clean, persist_clean, prepare_trips
from landfall.plans.reports import (daily, daily_chart, dashboard, monthly_chart, monthly_summary,
                                    summary_table, top, with_headings)
from landfall.plans.slicing import slice_tables
from landfall.refresh import (Facts, create_store, dedupe, high_water, read_delta, read_delta_child,
                              read_version, refresh_store, refresh_tables)
from landfall.operators.states import day_states, refresh_states
from landfall.refresh.versions import NO_MONTH, read_months, read_manifest
from landfall.session import checkpoint_dir, materialize
from landfall.sources.snapshot import (backup_tables, export_summary_csv, read_snapshot, read_table,
                                       write_snapshot)
from landfall.tables import Tables

# Test parameters (FIXTURES.md): labels follow the test tables' place names.
TEST_LABELS = Labels(
    sites=tuple(f"NATION_{i}" for i in range(12)),
    habitats=tuple(f"H{i}" for i in range(1, 7)),
    gears=tuple(f"G{i}" for i in range(1, 10)),
    boats=("Canoe", "Motor"),
)
PARAMS = Params(min_date=dt.date(1996, 1, 1), as_of=dt.date(2001, 7, 1), patch_after=10500.0,
                donor_cap=0.5, labels=TEST_LABELS)
MAIN = Selection(start=dt.date(1996, 12, 31), end=dt.date(1999, 7, 1),
                 sites=TEST_LABELS.sites[:9], habitats=TEST_LABELS.habitats,
                 gears=TEST_LABELS.gears, boats=TEST_LABELS.boats)
PARTIAL = Selection(start=MAIN.start, end=MAIN.end, sites=MAIN.sites, habitats=MAIN.habitats,
                    gears=TEST_LABELS.gears[:4], boats=MAIN.boats)
NO_BOATS = Selection(start=MAIN.start, end=MAIN.end, sites=MAIN.sites, habitats=MAIN.habitats,
                     gears=MAIN.gears, boats=())
FEW_DAYS = Selection(start=dt.date(1998, 3, 1), end=dt.date(1998, 3, 5), sites=MAIN.sites,
                     habitats=MAIN.habitats, gears=MAIN.gears, boats=MAIN.boats)
SMOOTH = Selection(start=MAIN.start, end=MAIN.end, sites=MAIN.sites, habitats=MAIN.habitats,
                   gears=MAIN.gears, boats=MAIN.boats, spar=0.5)
SHORT = Selection(start=dt.date(1998, 3, 1), end=dt.date(1998, 4, 10), sites=MAIN.sites, habitats=MAIN.habitats,
                  gears=MAIN.gears, boats=MAIN.boats, spar=0.5)
SNAPSHOT_MARK = 10800.0   # snapshot = trips with date_numeric <= this
LOOKBACK_DAYS = 30.0      # refresh re-reads this margin below the high-water mark
CUTOFF = dt.date(1998, 1, 1)
CANOES = Selection(start=MAIN.start, end=MAIN.end, sites=MAIN.sites, habitats=MAIN.habitats,
                   gears=MAIN.gears, boats=("Canoe",))
MOTORS = Selection(start=MAIN.start, end=MAIN.end, sites=MAIN.sites, habitats=MAIN.habitats,
                   gears=MAIN.gears, boats=("Motor",))
# Thresholds that keep some series and drop others at sf0.01 (175..272 days).
SPARSE_SITE_DAYS = 215
SPARSE_GEAR_DAYS = 220
DONOR_REPS = 100

LINEITEM_COLS = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_extendedprice", T.DoubleType())])


def refreshed(spark: SparkSession, sf: str) -> Tables:
    """Stand-in tables after the refresh step (union already done; full-row dedupe)."""
    t = fixtures.load(spark, sf)
    return t.replace(trips=dedupe(t.trips), landings=dedupe(t.landings),
                     pds_trips=dedupe(t.pds_trips), pds_points=dedupe(t.pds_points))


def cleaned(spark, sf) -> Tables:
    return clean(refreshed(spark, sf), PARAMS)


def sliced(spark, sf, sel: Selection = MAIN):
    return slice_tables(cleaned(spark, sf), sel, PARAMS)


def summary_of(spark, sf, sel: Selection = MAIN) -> DataFrame:
    s, spine = sliced(spark, sf, sel)
    return monthly_summary(s, spine, sel, PARAMS)


# --- sources and refresh -------------------------------------------------------------
def q_scan_snapshot(spark, sf):
    li = read_snapshot(spark, f"{sf}/lineitem.parquet", "lineitem", schema=LINEITEM_COLS)
    return nan_to_null(fixtures.twice(fixtures.landings_from_lineitem(li)))


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/landfall/{name}-{uuid.uuid4().hex}"


def q_write_snapshot(spark, sf):
    base = _scratch(spark, "snapshot")
    df = fixtures.landings(spark, sf)
    write_snapshot(df, base, "landings", "v1")
    return read_snapshot(spark, f"{base}/v1", "landings", df.schema)


def q_backup(spark, sf):
    t = fixtures.load(spark, sf)
    at = backup_tables({"stations": t.stations, "trips": t.trips}, _scratch(spark, "backup"), CUTOFF)
    return read_table(spark, {"format": "parquet", "path": at["trips"]}).join(
        read_table(spark, {"format": "parquet", "path": at["stations"]}), "station_code").select(
        "trip_id", "station_name")


def q_export_csv(spark, sf):
    path = export_summary_csv(summary_of(spark, sf), _scratch(spark, "csv"), True)
    return spark.read.option("header", True).csv(path).select(
        "Month", *[F.col(f"`{c}`").cast("double").alias(a) for c, a in (
            ("Reported trips", "trips"), ("Reported catch (KG)", "KG"),
            ("Estimated national catch (T)", "natcatch"))])


def q_scan_dimension(spark, sf):
    n = read_table(spark, {"format": "parquet", "path": f"{sf}/nation.parquet"})
    return fixtures.municipalities_from_nation(n)


def _snapshot_source(spark, sf):
    t = fixtures.trips(spark, sf)
    return t.filter(F.col("date_numeric") <= SNAPSHOT_MARK), t


def q_delta_parent(spark, sf):
    snap, src = _snapshot_source(spark, sf)
    return read_delta(src, high_water(snap))


def q_delta_child(spark, sf):
    snap, src = _snapshot_source(spark, sf)
    return read_delta_child(fixtures.landings(spark, sf), read_delta(src, high_water(snap)),
                            "trip_id")


def q_refresh_union(spark, sf):
    snap, src = _snapshot_source(spark, sf)
    lnd = fixtures.landings(spark, sf)
    snap_l = dedupe(lnd.join(snap.select("trip_id"), "trip_id", "left_semi"))
    _, landings = refresh_tables(dedupe(snap), snap_l, src, lnd, "trip_id", lookback=LOOKBACK_DAYS)
    return landings


def _changed(spark, sf):
    """Refresh in which one trip in seven of the margin comes in a second version."""
    snap, src = _snapshot_source(spark, sf)
    lnd = fixtures.landings(spark, sf)
    snap_l = dedupe(lnd.join(snap.select("trip_id"), "trip_id", "left_semi"))
    src = src.withColumn("trip_effort", F.when(F.col("trip_id") % 7 == 0, F.col("trip_effort") + 1)
                         .otherwise(F.col("trip_effort")))
    return refresh_tables(dedupe(snap), snap_l, src, lnd, "trip_id", lookback=LOOKBACK_DAYS)


def q_refresh_changed_trip(spark, sf):
    return _changed(spark, sf)[0]


def q_clean_changed_landings(spark, sf):
    """Landings after cleaning a refresh with changed trips: none is lost or multiplied."""
    trips, lnd = _changed(spark, sf)
    t = Tables(trips=trips, landings=lnd, stations=fixtures.stations(spark, sf))
    return clean(t, PARAMS).landings


def _store(spark, sf):
    """The changed refresh as a versioned store by month: schemas, folder and version."""
    # The trips of the source are joined once; four steps below read them.
    src = materialize(fixtures.trips(spark, sf), "source-trips")
    snap = src.filter(F.col("date_numeric") <= SNAPSHOT_MARK)
    lnd = fixtures.landings(spark, sf)
    facts = [Facts("trips", "landings", "trip_id")]
    base = _scratch(spark, "store")
    create_store(spark, base, {"trips": snap, "landings": lnd.join(snap.select("trip_id"), "trip_id", "left_semi")}, facts)
    newer = {"landings": lnd, "trips": src.withColumn("trip_effort", F.when(
        F.col("trip_id") % 7 == 0, F.col("trip_effort") + 1).otherwise(F.col("trip_effort")))}
    schemas = {n: df.schema for n, df in newer.items()}
    return schemas, base, refresh_store(spark, base, newer.get, facts, LOOKBACK_DAYS, schemas)


def q_refresh_stored(spark, sf):
    """Trips of a store whose refresh rewrote only the months that the delta touches."""
    schemas, base, version = _store(spark, sf)
    return read_version(spark, base, "trips", version, schemas["trips"])


def q_monthly_summary_states(spark, sf):
    """Monthly summary from stored day states, of which a refresh summed only the months again
    that it rewrote."""
    schemas, base, new = _store(spark, sf)
    old = read_manifest(spark, base, 1)
    stations = fixtures.stations(spark, sf)

    def trips(version, months=None):
        t, lnd = (read_months(spark, base, n, version, schemas[n], months).drop("month") for n in ("trips", "landings"))
        return clean(Tables(trips=t, landings=lnd, stations=stations), PARAMS).trips

    states = materialize(day_states(trips(old)), "day-states", partition_by=["month"])
    changed = [m for m, v in new.months["trips"].items() if v == new.number]
    left = set(old.months["trips"]) - set(new.months["trips"])       # months that lost their last trip
    states = refresh_states(states, trips(new, changed), [
        None if m == NO_MONTH else dt.date.fromisoformat(f"{m}-01") for m in {*changed, *left}])
    s, spine = slice_tables(Tables(trips=states, municipalities=fixtures.municipalities(spark, sf), stations=stations), MAIN, PARAMS)
    return monthly_summary(s, spine, MAIN, PARAMS)


def q_refresh_stored_landings(spark, sf):
    schemas, base, version = _store(spark, sf)
    return read_version(spark, base, "landings", version, schemas["landings"])


# --- row-level steps -------------------------------------------------------------------
def _prepared(spark, sf):
    r = refreshed(spark, sf)
    return prepare_trips(r.trips, r.stations, PARAMS)


def q_parse_date(spark, sf):
    return _prepared(spark, sf).select("trip_id", "date")


def q_recode_habitat(spark, sf):
    return _prepared(spark, sf).select("trip_id", "habitat_code")


def q_clamp_effort(spark, sf):
    return _prepared(spark, sf).select("trip_id", "trip_hours", "trip_effort")


def q_patch_imei(spark, sf):
    return _prepared(spark, sf).select("trip_id", "IMEI")


def q_station_lookup(spark, sf):
    return _prepared(spark, sf).select("trip_id", "municipality_code")


def q_trip_catch(spark, sf):
    r = refreshed(spark, sf)
    return attach_catch(r.trips.select("trip_id"), r.landings)


def q_landing_dates(spark, sf):
    r = refreshed(spark, sf)
    return landing_dates(r.landings, _prepared(spark, sf))


def q_month_floor(spark, sf):
    return _prepared(spark, sf).select("trip_id", month_floor("date").alias("month"))


def q_clip_low(spark, sf):
    c = read_table(spark, {"format": "parquet", "path": f"{sf}/customer.parquet"})
    return clip_low(c.select("c_custkey", F.col("c_acctbal").alias("fit")), "fit")


def q_default_window(spark, sf):
    d = _prepared(spark, sf).select(F.col("date").alias("as_of")).filter(
        F.col("as_of").isNotNull()).distinct()
    start, end = default_window_cols("as_of")
    return d.select("as_of", start.alias("start"), end.alias("end"))


# --- cleaning, slicing, guards --------------------------------------------------------
def q_clean_trips(spark, sf):
    return cleaned(spark, sf).trips


def _stored(spark, sf) -> Tables:
    return persist_clean(refreshed(spark, sf), PARAMS, "query-clean")


def q_clean_stored(spark, sf):
    return _stored(spark, sf).landings.select("trip_id", "species_code", "weight_g", "food_sale", "note",
                                              "trip_municipality")


def q_monthly_summary_stored(spark, sf):
    s, spine = slice_tables(_stored(spark, sf), MAIN, PARAMS)
    return monthly_summary(s, spine, MAIN, PARAMS)


def q_pds_clean(spark, sf):
    return cleaned(spark, sf).pds_trips


def q_slice_trips(spark, sf):
    return sliced(spark, sf)[0].trips


def q_slice_landings(spark, sf):
    return sliced(spark, sf)[0].landings


def q_slice_pds(spark, sf):
    return sliced(spark, sf)[0].pds_trips


def q_guard_empty(spark, sf):
    return sliced(spark, sf, NO_BOATS)[0].trips


def q_guard_min_rows(spark, sf):
    s, spine = sliced(spark, sf, FEW_DAYS)
    return monthly_cpue(s.trips, spine).select("month", "KG", "trip_effort", "CPUE", "trips",
                                               "fishing_days")


def q_cutoff(spark, sf):
    c = cleaned(spark, sf)
    return cutoff(c.trips, c.landings, CUTOFF)[1]


# --- species ---------------------------------------------------------------------------
def q_species_catch(spark, sf):
    return species_catch(sliced(spark, sf)[0].landings)


def q_top_species(spark, sf):
    return top(sliced(spark, sf)[0], PARAMS)


def q_species_share(spark, sf):
    return species_share(top(sliced(spark, sf)[0], PARAMS))


# --- monthly ---------------------------------------------------------------------------
MONTHLY_COLS = ("month", "KG", "trip_effort", "CPUE", "trips", "fishing_days")


def q_monthly_cpue(spark, sf):
    s, spine = sliced(spark, sf)
    return monthly_cpue(s.trips, spine).select(*MONTHLY_COLS)


def q_boat_cpue(spark, sf):
    s, spine = sliced(spark, sf)
    return boat_cpue(monthly_cpue(s.trips, spine))


def q_fleet_size(spark, sf):
    s, _ = sliced(spark, sf)
    return fleet_size(s.municipalities, MAIN.codes(TEST_LABELS)["boats"])


def q_national_catch(spark, sf):
    s, spine = sliced(spark, sf)
    fleet = fleet_size(s.municipalities, MAIN.codes(TEST_LABELS)["boats"])
    m = national_catch(monthly_cpue(s.trips, spine), fleet, PARAMS,
                       MAIN.raising_enabled(TEST_LABELS))
    return m.select("month", "natcatch")


def q_monthly_summary(spark, sf):
    return summary_of(spark, sf)


def q_monthly_summary_partial(spark, sf):
    return summary_of(spark, sf, PARTIAL)


def q_summary_table(spark, sf):
    return summary_table(summary_of(spark, sf), MAIN, PARAMS)


def q_summary_table_partial(spark, sf):
    return summary_table(summary_of(spark, sf, PARTIAL), PARTIAL, PARAMS)


def q_summary_table_headed(spark, sf):
    return with_headings(summary_table(summary_of(spark, sf), MAIN, PARAMS))


def q_summary_one_boat(spark, sf):
    """Both selections of a single boat type; the other type's fleet counts 0."""
    a, b = (summary_of(spark, sf, sel).select("month", "trips", "KG", "natcatch", F.lit(name).alias("boat"))
            for sel, name in ((CANOES, "canoe"), (MOTORS, "motor")))
    return a.unionByName(b)


def q_fleet_one_boat(spark, sf):
    s, _ = sliced(spark, sf, CANOES)
    return fleet_size(s.municipalities, CANOES.codes(TEST_LABELS)["boats"])


def q_dashboard_bundle(spark, sf):
    """Rows of each dashboard result of one stored selection, by name."""
    results = dashboard(*slice_tables(_stored(spark, sf), MAIN, PARAMS), MAIN, PARAMS)
    out = None
    for name in ("monthly", "table", "chart", "site", "habitat", "gear", "species", "heat"):
        one = results[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("result"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def q_monthly_chart(spark, sf):
    return monthly_chart(summary_of(spark, sf))


# --- daily series ----------------------------------------------------------------------
def _daily(dim, min_days=PARAMS.min_days, sel=MAIN):
    def run(spark, sf):
        return daily(sliced(spark, sf, sel)[0], dim, sel, PARAMS, min_days)
    return run


def q_log_axis(spark, sf):
    return daily_chart(daily(sliced(spark, sf)[0], "site", MAIN, PARAMS, PARAMS.min_days))


def _smooth(dim, sel=SMOOTH):
    def run(spark, sf):
        return daily(sliced(spark, sf, sel)[0], dim, sel, PARAMS, PARAMS.min_days)
    return run


q_smooth_site = _smooth("site")


def q_smooth_moments(spark, sf):
    """Weighted means of each site's fitted series and of fit x day, before clipping: a
    smoothing spline leaves both as they are in the data."""
    d = daily(sliced(spark, sf)[0], "site", MAIN, PARAMS).where("CPUE is not null and trip_effort > 0")
    f = smooth_series(d.drop("fit"), "code", "date", "CPUE", "trip_effort", SMOOTH.spar)
    w, x = F.col("trip_effort"), F.datediff("date", F.lit(MAIN.start)).cast("double")
    return f.groupBy("code").agg(F.count(F.lit(1)).alias("days"), (F.sum(w * F.col("fit")) / F.sum(w)).alias("mean_fit"),
                                 (F.sum(w * x * F.col("fit")) / F.sum(w * x)).alias("slope_fit"))


# --- map -------------------------------------------------------------------------------
def q_mark_selected(spark, sf):
    return sliced(spark, sf)[0].shape


def q_heat_cells(spark, sf):
    return heat(sliced(spark, sf)[0].pds_points)


def q_heat_boxes(spark, sf):
    return cell_boxes(heat(sliced(spark, sf)[0].pds_points), PARAMS.cell_half)


def q_heat_classes(spark, sf):
    return heat_classes(heat(sliced(spark, sf)[0].pds_points), PARAMS.heat_bins)


# --- donor matching --------------------------------------------------------------------
def q_nearest_donor(spark, sf):
    sig = fixtures.signatures(spark, sf).withColumn("rep", F.lit(0))
    train = train_split("trip_id", "rep")
    return nearest_donor(sig.filter(~train).drop("rep"), sig.filter(train).drop("rep"),
                         cap=PARAMS.donor_cap)


def q_donor_fill(spark, sf):
    out = donate_attributes(fixtures.tracks(spark, sf), cap=PARAMS.donor_cap)
    return out.select("PDS_trip", "trip_id", "gear_code", "habitat_code", "donor_tripid",
                      "donor_distance")


def q_validate_donor_reps(spark, sf):
    return validate_donor(fixtures.signatures(spark, sf), DONOR_REPS, PARAMS.donor_cap)


def q_validate_donor(spark, sf):
    return donor_accuracy(q_validate_donor_reps(spark, sf))


# --- key checks ------------------------------------------------------------------------
def q_check_pk(spark, sf):
    snap, src = _snapshot_source(spark, sf)
    delta = read_delta(src, high_water(snap), lookback=LOOKBACK_DAYS)
    return check_pk(snap.unionByName(delta), "trip_id")


def q_check_fk(spark, sf):
    r = refreshed(spark, sf)
    return check_fk(r.trips, "station_code", r.stations)


def q_cascade_delete(spark, sf):
    r = refreshed(spark, sf)
    ids = r.trips.filter(F.col("trip_effort").isNull()).select("trip_id")
    out = cascade_delete({"trips": r.trips, "landings": r.landings}, "trips", ids)
    return out["landings"]


def _all_tables(spark, sf) -> dict[str, DataFrame]:
    t = dict(refreshed(spark, sf).items())
    return {**fixtures.dimensions(spark, sf), **t, "trips": fixtures.keyed_trips(t["trips"]),
            "pds_trips": fixtures.keyed_tracks(t["pds_trips"])}


def q_cascade_delete_tracks(spark, sf):
    """Points left when trips without effort go, with the tracked trips that report them
    or take their values from them."""
    t = _all_tables(spark, sf)
    ids = t["trips"].filter(F.col("trip_effort").isNull()).select("trip_id")
    return cascade_delete(t, "trips", ids)["pds_points"]


def q_check_pk_all(spark, sf):
    t = _all_tables(spark, sf)
    return check_pks({**t, "trips": t["trips"].unionByName(t["trips"].filter(F.col("trip_id") % 1000 == 0))})


def q_check_fk_all(spark, sf):
    return check_fks(_all_tables(spark, sf))


def _new_rows(spark, sf):
    """The snapshot's trips and the rows that a refresh would add, some of them again."""
    snap, src = _snapshot_source(spark, sf)
    return snap, read_delta(src, high_water(snap), lookback=LOOKBACK_DAYS)


def q_check_pk_delta(spark, sf):
    snap, delta = _new_rows(spark, sf)
    again = delta.filter(F.col("trip_id") % 100 == 0)
    return check_pk_new(delta.unionByName(again), snap, "trip_id")


def q_check_fk_delta(spark, sf):
    """Landings of newer trips whose species is unknown, and landings of no trip among the newer ones."""
    _, delta = _new_rows(spark, sf)
    lnd = fixtures.landings(spark, sf).filter(F.col("trip_id") % 3 == 0)
    few = fixtures.species(spark, sf).filter(F.col("species_code") % 17 != 0)
    bad = check_fk_new(read_delta_child(lnd, delta, "trip_id"), "species_code", few).select("trip_id", "species_code", F.lit("species").alias("parent"))
    return bad.unionByName(check_fk_new(lnd, "trip_id", delta).select("trip_id", "species_code", F.lit("trips").alias("parent")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_snapshot": q_scan_snapshot,
    "scan_dimension": q_scan_dimension,
    "delta_parent": q_delta_parent,
    "delta_child": q_delta_child,
    "refresh_union": q_refresh_union,
    "refresh_changed_trip": q_refresh_changed_trip,
    "clean_changed_landings": q_clean_changed_landings,
    "refresh_stored": q_refresh_stored,
    "refresh_stored_landings": q_refresh_stored_landings,
    "monthly_summary_states": q_monthly_summary_states,
    "write_snapshot": q_write_snapshot,
    "backup": q_backup,
    "export_csv": q_export_csv,
    "clip_low": q_clip_low,
    "clean_stored": q_clean_stored,
    "monthly_summary_stored": q_monthly_summary_stored,
    "summary_table_headed": q_summary_table_headed,
    "summary_one_boat": q_summary_one_boat,
    "fleet_one_boat": q_fleet_one_boat,
    "dashboard_bundle": q_dashboard_bundle,
    "smooth_moments": q_smooth_moments,
    "cascade_delete_tracks": q_cascade_delete_tracks,
    "check_pk_all": q_check_pk_all,
    "check_fk_all": q_check_fk_all,
    "check_pk_delta": q_check_pk_delta,
    "check_fk_delta": q_check_fk_delta,
    "parse_date": q_parse_date,
    "recode_habitat": q_recode_habitat,
    "clamp_effort": q_clamp_effort,
    "patch_imei": q_patch_imei,
    "station_lookup": q_station_lookup,
    "trip_catch": q_trip_catch,
    "landing_dates": q_landing_dates,
    "clean_trips": q_clean_trips,
    "pds_clean": q_pds_clean,
    "slice_trips": q_slice_trips,
    "slice_landings": q_slice_landings,
    "slice_pds": q_slice_pds,
    "guard_empty": q_guard_empty,
    "guard_min_rows": q_guard_min_rows,
    "cutoff": q_cutoff,
    "species_catch": q_species_catch,
    "top_species": q_top_species,
    "species_share": q_species_share,
    "monthly_cpue": q_monthly_cpue,
    "boat_cpue": q_boat_cpue,
    "fleet_size": q_fleet_size,
    "national_catch": q_national_catch,
    "monthly_summary": q_monthly_summary,
    "monthly_summary_partial": q_monthly_summary_partial,
    "summary_table": q_summary_table,
    "summary_table_partial": q_summary_table_partial,
    "monthly_chart": q_monthly_chart,
    "daily_cpue_site": _daily("site"),
    "daily_cpue_habitat": _daily("habitat"),
    "daily_cpue_gear": _daily("gear"),
    "daily_cpue_site_sparse": _daily("site", SPARSE_SITE_DAYS),
    "daily_cpue_gear_sparse": _daily("gear", SPARSE_GEAR_DAYS),
    "log_axis": q_log_axis,
    "mark_selected": q_mark_selected,
    "heat_cells": q_heat_cells,
    "heat_boxes": q_heat_boxes,
    "heat_classes": q_heat_classes,
    "month_floor": q_month_floor,
    "default_window": q_default_window,
    "nearest_donor": q_nearest_donor,
    "donor_fill": q_donor_fill,
    "validate_donor": q_validate_donor,
    "validate_donor_reps": q_validate_donor_reps,
    "smooth_site": q_smooth_site,
    "smooth_habitat": _smooth("habitat"),
    "smooth_gear": _smooth("gear"),
    "smooth_short": _smooth("site", SHORT),
    "check_pk": q_check_pk,
    "check_fk": q_check_fk,
    "cascade_delete": q_cascade_delete,
}
