"""Sources, sinks and the snapshot refresh."""

import csv
import datetime as dt
import glob
import os


import pytest
from pyspark.sql import functions as F

from landfall import schema
from landfall.sources.snapshot import (backup_tables, bounds_query, export_summary_csv, jdbc_source,
                                       read_snapshot, split_options, write_snapshot)
from landfall.refresh import (Facts, create_store, dedupe, high_water, latest_version, read_delta,
                              read_version, refresh, refresh_store, refresh_tables)
from tests.helpers import landing, landings_df, trip, trips_df


def test_write_and_read_snapshot(spark, scratch):
    t = trips_df(spark, [trip(1), trip(2)])
    path = write_snapshot(t, scratch, "trips", version="v1")
    assert path.endswith("v1/trips")
    back = read_snapshot(spark, os.path.join(scratch, "v1"), "trips")
    assert back.schema == schema.TRIPS and back.count() == 2


def test_backup_tables(spark, scratch):
    t = trips_df(spark, [trip(1)])
    out = backup_tables({"trips": t}, scratch, dt.date(2020, 5, 1))
    assert out["trips"].endswith("2020-05-01/trips")
    assert spark.read.parquet(out["trips"]).count() == 1


def test_refresh_is_strict_and_idempotent(spark):
    snap = trips_df(spark, [trip(1, dnum=10.0), trip(2, dnum=20.0)])
    src = trips_df(spark, [trip(1, dnum=10.0), trip(2, dnum=20.0), trip(3, dnum=20.0),
                           trip(4, dnum=21.0)])
    mark = high_water(snap)
    assert mark == 20.0
    delta = read_delta(src, mark)
    assert [r.trip_id for r in delta.collect()] == [4]   # a late row at the mark is missed
    once = refresh(snap, delta, "trip_id")
    twice = refresh(once, read_delta(src, high_water(once)), "trip_id")
    assert sorted(r.trip_id for r in twice.collect()) == [1, 2, 4]
    look = refresh(snap, read_delta(src, mark, lookback=1.0), "trip_id")
    assert sorted(r.trip_id for r in look.collect()) == [1, 2, 3, 4]


def test_refresh_children_and_empty_snapshot(spark):
    snap = trips_df(spark, [trip(1, dnum=10.0)])
    src = trips_df(spark, [trip(1, dnum=10.0), trip(2, dnum=11.0)])
    snap_l = landings_df(spark, [landing(1), landing(1)])
    src_l = landings_df(spark, [landing(1), landing(2), landing(2)])
    t, lnd = refresh_tables(snap, dedupe(snap_l), src, src_l, "trip_id")
    assert sorted(r.trip_id for r in t.collect()) == [1, 2]
    assert sorted(r.trip_id for r in lnd.collect()) == [1, 2]   # full-row dedupe
    assert high_water(snap.limit(0)) is None


def test_export_csv(spark, scratch):
    s = spark.createDataFrame(
        [(dt.date(2019, 3, 1), 2, 3, 10.0, 5.5, 0.55, 1.25)],
        "month date, fishing_days bigint, trips bigint, trip_effort double, KG double, CPUE double, natcatch double")
    p = export_summary_csv(s, os.path.join(scratch, "full"), True)
    rows = list(csv.reader(open(glob.glob(os.path.join(p, "part-*.csv"))[0])))
    assert rows[0][0] == "Month" and len(rows[0]) == 7 and rows[1][0] == "Mar-2019"
    p = export_summary_csv(s, os.path.join(scratch, "part"), False)
    rows = list(csv.reader(open(glob.glob(os.path.join(p, "part-*.csv"))[0])))
    assert len(rows[0]) == 6 and len(rows[1]) == 6


def test_landings_that_differ_in_a_note_stay(spark, scratch):
    a, b = dict(landing(1), food_sale="food"), dict(landing(1), food_sale="sale")
    write_snapshot(landings_df(spark, [a, b, a]), scratch, "landings", version="v")
    back = dedupe(read_snapshot(spark, os.path.join(scratch, "v"), "landings"))
    assert sorted(r.food_sale for r in back.collect()) == ["food", "sale"]


def test_nan_is_missing_in_every_double_column(spark, scratch):
    nan = float("nan")
    t = trips_df(spark, [dict(trip(1, effort=nan, dnum=nan), mesh=nan, catch_value=nan), trip(2, dnum=5.0)])
    write_snapshot(t, scratch, "trips", version="v")
    back = read_snapshot(spark, os.path.join(scratch, "v"), "trips")
    first = back.filter("trip_id = 1").first()
    assert all(first[c] is None for c in ("trip_effort", "date_numeric", "mesh", "catch_value"))
    assert high_water(back) == 5.0


def test_changed_parent_replaces_the_older_version_and_its_children(spark):
    snap = trips_df(spark, [trip(1, effort=5.0, dnum=10.0), trip(2, dnum=11.0)])
    src = trips_df(spark, [trip(1, effort=9.0, dnum=10.5), trip(2, dnum=11.0)])
    old, new = landings_df(spark, [landing(1, weight=1.0), landing(2)]), landings_df(spark, [landing(1, weight=2.0), landing(2)])
    t, lnd = refresh_tables(snap, old, src, new, "trip_id", lookback=2.0)
    assert {r.trip_id: r.trip_effort for r in t.collect()} == {1: 9.0, 2: 10.0}
    assert sorted((r.trip_id, r.weight_g) for r in lnd.collect()) == [(1, 2.0), (2, 1000.0)]


def test_database_source_options():
    s = jdbc_source("jdbc:x://h/db", "trips", {"user": "u"})
    assert s == {"format": "jdbc", "url": "jdbc:x://h/db", "dbtable": "trips", "pushDownPredicate": "true", "user": "u"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_mark_reaches_the_files(spark, scratch):
    rows = [trip(1, dnum=10.0), trip(2, dnum=20.0), trip(3, dnum=float("nan")), trip(4, dnum=None), trip(5, dnum=30.0)]
    trips_df(spark, rows).write.parquet(f"{scratch}/trips")
    delta = read_delta(read_snapshot(spark, scratch, "trips", raw=True), 15.0)
    assert "GreaterThan(date_numeric,15.0)" in plan(delta)
    assert sorted(r.trip_id for r in delta.collect()) == [2, 5]      # NaN is missing, not large
    whole = read_delta(read_snapshot(spark, scratch, "trips", raw=True), None)
    assert [r.date_numeric for r in whole.orderBy("trip_id").collect()] == [10.0, 20.0, None, None, 30.0]


def test_database_tables_are_read_by_ranges():
    src = jdbc_source("jdbc:mysql://h/db", "trips", {"user": "u", "split_rows": "1000"}, split="trip_id")
    q = bounds_query(src)
    assert q["dbtable"] == "(SELECT MIN(trip_id) AS lo, MAX(trip_id) AS hi, COUNT(*) AS n FROM trips) bounds"
    assert q["user"] == "u" and "split" not in q and "split_rows" not in q
    o = split_options(src, 3, 90_001, 4_500)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("trip_id", "3", "90001", "5")
    assert o["dbtable"] == "trips" and o["pushDownPredicate"] == "true" and "split" not in o
    assert "partitionColumn" not in split_options(src, None, None, 0)            # empty table: one task
    assert "partitionColumn" not in split_options(src, 1, 9, 1_000)
    day = split_options({**src, "split": "date"}, dt.date(2019, 1, 1), dt.date(2020, 1, 1), 10_000)
    assert (day["lowerBound"], day["upperBound"]) == ("2019-01-01", "2020-01-01")
    assert split_options({**src, "split": "date_numeric"}, 1.5, 9.2, 10_000)["upperBound"] == "10"


PAIR = [Facts("trips", "landings", "trip_id")]


def size_of(path):
    return sum(os.path.getsize(p) for p in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_a_refresh_writes_only_changed_months(spark, scratch):
    day = lambda i: f"2018-{1 + i % 12:02d}-{1 + i // 12 % 28:02d}"
    old = [trip(i, date=day(i), dnum=float(i)) for i in range(2400)]
    lnd = [landing(i, species=k, weight=float(i)) for i in range(2400) for k in range(3)]
    create_store(spark, scratch, {"trips": trips_df(spark, old), "landings": landings_df(spark, lnd + [landing(9000)])}, PAIR)
    first = latest_version(spark, scratch)
    assert first.marks == {"trips": 2399.0} and len(first.months["trips"]) == 12
    assert first.months["landings"]["none"] == 1                     # a landing whose trip is not there yet
    # one new trip (of the stray landing), one that moves from month 4 to 5, one with a NaN mark
    new = [trip(9000, date="2018-02-03", dnum=3000.0), trip(3, date="2018-05-01", dnum=3001.0),
           trip(9001, date="2018-09-01", dnum=float("nan"))]
    got = refresh_store(spark, scratch, {"trips": trips_df(spark, old + new),
                                         "landings": landings_df(spark, lnd + [landing(9000, species=5)])}.get, PAIR)
    assert got.number == 2 and got.marks == {"trips": 3001.0} and latest_version(spark, scratch) == got
    rewritten = {t: {m for m, v in got.months[t].items() if v == 2} for t in got.months}
    assert rewritten == {"trips": {"2018-02", "2018-04", "2018-05"}, "landings": {"2018-02", "2018-04", "2018-05"}}
    assert "none" not in got.months["landings"]                      # the stray landing was replaced by its trip's
    for t in ("trips", "landings"):
        assert size_of(f"{scratch}/{t}/version=2") < 0.5 * size_of(f"{scratch}/{t}/version=1")
    trips = read_version(spark, scratch, "trips", got)
    assert trips.count() == 2401 and trips.where("trip_id = 3").first().date == "2018-05-01"
    landings = read_version(spark, scratch, "landings", got)
    assert landings.count() == 7201 and [r.species_code for r in landings.where("trip_id = 9000").collect()] == [5]
    assert read_version(spark, scratch, "trips", first).count() == 2400          # the old version still reads
    same = refresh_store(spark, scratch, {"trips": trips_df(spark, old + new), "landings": landings_df(spark, lnd)}.get, PAIR)
    assert same == got                                               # nothing newer: nothing written


def test_a_store_gives_what_a_plain_refresh_gives(spark, scratch):
    old = [trip(i, date="2018-03-05" if i % 3 else None, dnum=float(i)) for i in range(40)] + [trip(None, dnum=3.0)]
    new = old + [trip(i, date="2018-04-05", dnum=100.0 + i) for i in range(30, 60)] + [trip(None, dnum=200.0)]
    lnd = [landing(i, species=k) for i in [*range(60), 999, None] for k in range(2)]
    tables = {"trips": trips_df(spark, old), "landings": landings_df(spark, lnd[:80])}
    source = {"trips": trips_df(spark, new), "landings": landings_df(spark, lnd)}
    create_store(spark, scratch, tables, PAIR)
    v = refresh_store(spark, scratch, source.get, PAIR)
    want = refresh_tables(dedupe(tables["trips"]), dedupe(tables["landings"]), source["trips"], source["landings"], "trip_id")
    for name, df in zip(("trips", "landings"), want):
        rows = lambda x: sorted(map(repr, (tuple(r) for r in x.collect())))
        assert rows(read_version(spark, scratch, name, v).select(df.columns)) == rows(df)


def test_two_refreshes_at_once_do_not_both_count(spark, scratch):
    from landfall.refresh.versions import write_manifest
    tables = {"trips": trips_df(spark, [trip(1, dnum=1.0)]), "landings": landings_df(spark, [landing(1)])}
    v = create_store(spark, scratch, tables, PAIR)
    assert latest_version(spark, f"{scratch}/nothing") is None
    with pytest.raises(Exception, match="exists"):
        write_manifest(spark, scratch, v)


def test_the_stored_refresh_reads_its_landings_once(spark):
    """Rows reported twice come from one scan, and the trips of the source are joined once."""
    from landfall import catalog, fixtures
    sf = "/root/testdata/sf0.001"
    plan = fixtures.landings(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    _, base, version = catalog._store(spark, sf)
    assert version.number == 2


def test_the_first_month_of_a_repeated_parent_counts(spark):
    from landfall.refresh.versions import with_parent_month
    parent = spark.createDataFrame([(1, "2001-02"), (1, "1999-12"), (1, "none"), (2, "none"), (3, "0987-01")], "k int, month string")
    got = with_parent_month(spark.createDataFrame([(i,) for i in range(1, 5)], "k int"), parent, "k")
    assert {r.k: r.month for r in got.collect()} == {1: "1999-12", 2: "none", 3: "0987-01", 4: "none"}
