"""Hand-made edge rows for each rule (FIXTURES.md part D)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landfall.config import Labels, Params, Selection
from landfall.functions.columns import clamp, kg_sum, parse_date, recode
from landfall.functions.dates import default_window, month_spine
from landfall.operators.aggregates import fleet_size, monthly_cpue, national_catch, top_species
from landfall.operators.filters import min_points, min_rows, slice_dates
from landfall.plans.clean import clean_pds, clean_trips
from landfall.plans.reports import summary_table
from landfall.plans.slicing import slice_tables
from landfall.tables import Tables
from tests.helpers import d, landing, landings_df, trip, trips_df

P = Params(min_date=dt.date(2016, 9, 1), as_of=dt.date(2021, 1, 1))


def stations(spark):
    return spark.createDataFrame([(i, f"S{i}", i) for i in range(1, 13)],
                                 "station_code int, station_name string, municipality_code int")


def test_null_in_discard_list_removes_only_its_trip(spark):
    t = trips_df(spark, [trip(1), trip(2), trip(3)])
    lnd = landings_df(spark, [landing(1, flag=None), landing(2), landing(3)])
    kept, kl = clean_trips(t, lnd, stations(spark), P)
    assert sorted(r.trip_id for r in kept.collect()) == [2, 3]
    assert sorted(r.trip_id for r in kl.collect()) == [2, 3]


def test_bad_flag_and_incomplete_landing(spark):
    t = trips_df(spark, [trip(1), trip(2), trip(3), trip(4)])
    lnd = landings_df(spark, [landing(1, flag=1), landing(2, length=None), landing(3, flag=4),
                              landing(3, flag=5), landing(4)])
    kept, _ = clean_trips(t, lnd, stations(spark), P)
    assert sorted(r.trip_id for r in kept.collect()) == [3, 4]


def test_trip_without_landings_has_zero_catch(spark):
    t = trips_df(spark, [trip(1), trip(2)])
    lnd = landings_df(spark, [landing(1, weight=2500.0), landing(1, weight=500.0)])
    kept, _ = clean_trips(t, lnd, stations(spark), P)
    assert {r.trip_id: r.KG for r in kept.collect()} == {1: 3.0, 2: 0.0}


def test_cpue_outlier_is_strict(spark):
    t = trips_df(spark, [trip(1, effort=10.0), trip(2, effort=10.0)])
    lnd = landings_df(spark, [landing(1, weight=1_000_000.0), landing(2, weight=1_000_001.0)])
    kept, _ = clean_trips(t, lnd, stations(spark), P)
    assert [r.trip_id for r in kept.collect()] == [1]


def test_regex_wildcard_and_orphans(spark):
    pds = spark.createDataFrame(
        [(1, "2019-01-05", 1, 1, 1, 1), (2, "2019-01-05", 1, 1, 1, 1),
         (3, "2019-01-05", 1, 1, 1, 1), (4, "2019-01-05", 1, 1, 1, 1),
         (5, "2019-01-05", None, 1, 1, 1)],
        "PDS_trip long, date string, boat_code int, station_code int, gear_code int, habitat_code int")
    pts = spark.createDataFrame([(1, "-8.11,125"), (2, "-8011,125"), (3, "-8.12,125"),
                                 (4, None), (5, "-8.5,125"), (99, "-8.5,125")],
                                "PDS_trip long, latlng string")
    p, pp = clean_pds(pds, pts, P)
    assert sorted(r.PDS_trip for r in p.collect()) == [3, 4]
    # the orphan point (trip 99) survives cleaning; trip 5 (no boat type) loses its points
    assert sorted(r.PDS_trip for r in pp.collect()) == [3, 4, 99]


def test_date_parse(spark):
    t = trips_df(spark, [trip(1, date="2019-01-02"), trip(2, date="2019-01-02 10:00:00"),
                         trip(3, date="junk"), trip(4, date=None)])
    got = {r.trip_id: r.date for r in parse_date(t).collect()}
    assert got == {1: dt.date(2019, 1, 2), 2: dt.date(2019, 1, 2), 3: None, 4: None}


def test_null_date_survives_clean_and_leaves_at_slice(spark):
    t = trips_df(spark, [trip(1, date=None), trip(2, date="2010-01-01"), trip(3)])
    lnd = landings_df(spark, [landing(1), landing(2), landing(3)])
    kept, _ = clean_trips(t, lnd, stations(spark), P)
    assert sorted(r.trip_id for r in kept.collect()) == [1, 3]
    sliced = slice_dates(kept, d("2019-01-01"), d("2019-12-31"))
    assert [r.trip_id for r in sliced.collect()] == [3]


def test_date_slice_excludes_both_ends(spark):
    df = spark.createDataFrame([(d("2019-01-01"),), (d("2019-01-02"),), (d("2019-01-30"),),
                                (d("2019-01-31"),)], "date date")
    got = sorted(r.date for r in slice_dates(df, d("2019-01-01"), d("2019-01-31")).collect())
    assert got == [d("2019-01-02"), d("2019-01-30")]


def test_effort_clamp(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (144.0,), (145.0,), (None,)],
                               "trip_effort double")
    got = [r.trip_effort for r in clamp(df, "trip_effort", 3.0, 144.0).collect()]
    assert got == [-1.0, 3.0, 3.0, 144.0, 144.0, None]


def test_habitat_recode_is_one_map(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)] + [(None,)], "habitat_code int")
    got = [r.habitat_code for r in recode(df, "habitat_code", {5: 2, 6: 5, 7: 6}).collect()]
    assert got == [1, 2, 3, 4, 2, 5, 6, None]


def _species(spark):
    return spark.createDataFrame([(c, f"cat{c}", f"tet{c}") for c in list(range(1, 20)) + [300]],
                                 "species_code int, category string, category_tetun string")


def _top(spark, kg: dict):
    catch = spark.createDataFrame(list(kg.items()), "species_code int, KG double")
    return [(r["rank"], r.species_code, r.Tonnes)
            for r in top_species(catch, _species(spark)).orderBy("rank").collect()]


def test_top_species_cases(spark):
    nine = {c: float(100 - c) for c in range(1, 10)}
    assert len(_top(spark, nine)) == 9
    ten = {c: float(100 - c) for c in range(1, 11)}
    got = _top(spark, ten)
    assert len(got) == 10 and got[-1] == (10, 300, 90.0 / 1000)
    head300 = {**{c: float(100 - c) for c in range(1, 11)}, 300: 95.0}
    got = _top(spark, head300)
    assert len(got) == 9
    assert [g for g in got if g[1] == 300][0] == (6, 300, (95.0 + 91.0 + 90.0) / 1000)
    tail300 = {**{c: float(100 - c) for c in range(1, 11)}, 300: 1.0}
    got = _top(spark, tail300)
    assert len(got) == 10 and got[-1] == (10, 300, (90.0 + 1.0) / 1000)
    ties = {c: 5.0 for c in range(1, 11)}
    got = _top(spark, ties)
    assert [g[1] for g in got] == list(range(1, 10)) + [300]


def test_min_rows_guard(spark):
    df29 = spark.range(29)
    df30 = spark.range(30)
    assert min_rows(df29, 30).count() == 0
    assert min_rows(df30, 30).count() == 30
    assert min_rows(df29, 30).schema == df29.schema


def test_min_points(spark):
    rows = [(1, i) for i in range(4)] + [(2, i) for i in range(5)]
    df = spark.createDataFrame(rows, "code int, day int")
    assert sorted({r.code for r in min_points(df, "code", 5).collect()}) == [2]


def _clean_bundle(spark, n_trips, boat=1):
    rows = [trip(i, date="2019-03-10", station=1, boat=boat) for i in range(n_trips)]
    t = trips_df(spark, rows)
    lnd = landings_df(spark, [landing(i) for i in range(n_trips)])
    kept, kl = clean_trips(t, lnd, stations(spark), P)
    munis = spark.createDataFrame([(1, "M1", 10, 5)],
                                  "municipality_code int, municipality_name string, canoes int, motors int")
    return Tables(trips=kept, landings=kl, municipalities=munis, stations=stations(spark))


SEL = Selection(start=d("2019-01-01"), end=d("2019-06-30"))


def test_slice_guard_29_and_30(spark):
    s29, spine29 = slice_tables(_clean_bundle(spark, 29), SEL, P)
    s30, spine30 = slice_tables(_clean_bundle(spark, 30), SEL, P)
    assert s29.trips.count() == 0 and spine29.count() == 0 and s29.landings.count() == 0
    assert s30.trips.count() == 30 and spine30.count() == 6


def test_empty_selection_gives_empty_frames_with_schema(spark):
    b = _clean_bundle(spark, 40)
    sel = Selection(start=SEL.start, end=SEL.end, gears=())
    s, spine = slice_tables(b, sel, P)
    assert s.trips.count() == 0 and s.trips.schema == b.trips.schema
    assert spine.count() == 0


def test_month_without_canoe_trips_and_null_fleet(spark):
    b = _clean_bundle(spark, 40, boat=2)
    s, spine = slice_tables(b, SEL, P)
    m = monthly_cpue(s.trips, spine)
    fleet = fleet_size(s.municipalities, [1, 2])
    nat = {r.month: r.natcatch for r in national_catch(m, fleet, P, True).collect()}
    # motor trips only, all in March: CPUE 1 kg / 10 h
    assert nat[d("2019-03-01")] == pytest.approx(0.1 * 10 * 15.3 * 5 * 0.001)
    assert nat[d("2019-04-01")] == 0.0
    munis_null = spark.createDataFrame([(1, "M1", None, 5)],
                                       "municipality_code int, municipality_name string, canoes int, motors int")
    bc = _clean_bundle(spark, 40, boat=1)
    s, spine = slice_tables(bc.replace(municipalities=munis_null), SEL, P)
    m = monthly_cpue(s.trips, spine)
    nat = national_catch(m, fleet_size(s.municipalities, [1, 2]), P, True).collect()
    assert all(r.natcatch is None for r in nat)


def test_default_window_leap_day():
    assert default_window(d("2020-02-29")) == (d("2019-02-01"), d("2020-01-31"))
    assert default_window(d("2021-07-15")) == (d("2020-07-01"), d("2021-06-30"))


def test_month_spine_rejects_reversed_window(spark):
    with pytest.raises(ValueError):
        month_spine(spark, d("2020-02-01"), d("2020-01-01"))
    with pytest.raises(ValueError):
        Selection(start=d("2020-02-01"), end=d("2020-01-01"))


def test_summary_truncation_and_rounding(spark):
    schema = T.StructType([T.StructField("month", T.DateType()),
                           T.StructField("fishing_days", T.LongType()),
                           T.StructField("trips", T.LongType()),
                           T.StructField("trip_effort", T.DoubleType()),
                           T.StructField("KG", T.DoubleType()),
                           T.StructField("CPUE", T.DoubleType()),
                           T.StructField("natcatch", T.DoubleType())])
    s = spark.createDataFrame([(d("2019-03-01"), 1, 1, 8.0, 1.0, 0.125, 2.7),
                               (d("2019-04-01"), 1, 1, 8.0, 1.0, 0.125, -5.4)], schema)
    rows = summary_table(s, SEL, P).collect()
    assert [r.Month for r in rows] == ["Mar-2019", "Apr-2019", "Total"]
    assert rows[0].CPUE == 0.12 and rows[0].natcatch == 2 and rows[1].natcatch == -5
    assert rows[2].natcatch == -2  # -2.7 truncates toward zero
    partial = Selection(start=SEL.start, end=SEL.end, habitats=Labels().habitats[:3])
    assert "natcatch" not in summary_table(s, partial, P).columns


def test_landings_of_a_trip_in_two_versions_are_not_multiplied(spark):
    stations = spark.createDataFrame([(1, "S1", 1)], "station_code int, station_name string, municipality_code int")
    trips = trips_df(spark, [trip(1, effort=100.0, dnum=1.0), trip(1, effort=120.0, dnum=2.0), trip(2, effort=100.0)])
    lnd = landings_df(spark, [landing(1), landing(1, species=2), landing(2)])
    t, kept = clean_trips(trips, lnd, stations, Params(as_of=dt.date(2021, 1, 1)))
    assert sorted((r.trip_id, r.trip_effort, r.KG) for r in t.collect()) == [(1, 120.0, 2.0), (2, 100.0, 1.0)]
    assert sorted(r.trip_id for r in kept.collect()) == [1, 1, 2]


def test_sums_have_no_ceiling_of_64_bits(spark):
    lnd = landings_df(spark, [landing(1, weight=4e15), landing(1, weight=7e15)])
    assert lnd.groupBy().agg(kg_sum("weight_g").alias("KG")).first().KG == pytest.approx(1.1e13)


def test_nan_is_missing_in_the_rules(spark):
    stations = spark.createDataFrame([(1, "S1", 1)], "station_code int, station_name string, municipality_code int")
    nan = float("nan")
    trips = trips_df(spark, [trip(1, effort=nan), trip(2, effort=100.0), trip(3, effort=100.0)])
    lnd = landings_df(spark, [landing(1), landing(2, weight=nan), landing(3)])
    t, kept = clean_trips(trips, lnd, stations, Params(as_of=dt.date(2021, 1, 1)))
    assert [r.trip_id for r in t.collect()] == [3] and [r.trip_id for r in kept.collect()] == [3]
    assert [r.trip_effort for r in clamp(trips, "trip_effort", 3.0, 144.0).orderBy("trip_id").collect()] == [None, 100.0, 100.0]


def test_sums_keep_infinite_and_very_large_values(spark):
    from landfall.functions.columns import exact_sum
    nan, inf = float("nan"), float("inf")
    cases = {"inf": ([inf, 1.0], inf), "large": ([1e20, 1.0, 2e19], 1.2e20), "nan": ([nan, 2.5], 2.5), "none": ([None, nan], None),
             "small": ([0.1] * 10, 1.0), "both": ([inf, -inf], nan), "edge": ([1e18, -1e18], 0.0)}
    df = spark.createDataFrame([(k, v) for k, (vs, _) in cases.items() for v in vs], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, (_, v) in cases.items()}


def test_an_infinite_landing_removes_its_trip(spark):
    stations = spark.createDataFrame([(1, 1)], "station_code int, municipality_code int")
    trips = trips_df(spark, [trip(1), trip(2)])
    lnd = landings_df(spark, [landing(1, weight=float("inf")), landing(2)])
    kept, left = clean_trips(trips, lnd, stations, Params(as_of=dt.date(2020, 1, 1)))
    assert [r.trip_id for r in kept.collect()] == [2] and [r.trip_id for r in left.collect()] == [2]


def test_trips_without_an_id_are_not_versions_of_each_other(spark):
    stations = spark.createDataFrame([(1, 1)], "station_code int, municipality_code int")
    trips = trips_df(spark, [trip(None, effort=1.0), trip(None, effort=2.0), trip(None, effort=2.0), trip(7, dnum=1.0),
                             trip(7, dnum=2.0, effort=9.0)])
    kept, _ = clean_trips(trips, landings_df(spark, [landing(7), landing(None)]), stations, Params(as_of=dt.date(2020, 1, 1)))
    assert sorted((r.trip_id or 0, r.trip_effort, r.KG) for r in kept.collect()) == [
        (0, 1.0, 0.0), (0, 2.0, 0.0), (0, 2.0, 0.0), (7, 9.0, 1.0)]


def test_daily_series_come_from_one_pass(spark):
    from landfall.operators.aggregates import daily_cpue, daily_series, daily_sums
    rows = [(dt.date(2019, 1, 1 + i % 9), i % 2 + 1 if i % 7 else None, i // 9 % 3 + 1, 1.0 + i, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, municipality_code int, habitat_code int, KG double, trip_effort double")
    sums = daily_sums(df, ["municipality_code", "habitat_code"])
    assert sums._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    for dim in ("municipality_code", "habitat_code"):
        one, other = daily_series(sums.where(F.col("dim") == dim), "abc"), daily_cpue(df, dim, "abc")
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect())) and other.count() > 0


@pytest.mark.parametrize("species", [5, 9, 10, 400])
@pytest.mark.parametrize("other", [300, 3])
def test_top_species_reads_the_catch_once(spark, species, other):
    from landfall.operators.aggregates import top_species
    kg = {i: float((i * 37) % 50) for i in range(1, species + 1)}
    catch = spark.createDataFrame([(c, v) for c, v in kg.items()], "species_code int, KG double")
    names = spark.createDataFrame([(1, "a", "b")], "species_code int, category string, category_tetun string")
    got = top_species(catch, names, 9, other)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2    # catch and names
    order = sorted(kg, key=lambda c: (-kg[c], c))
    want = {c: [r + 1, kg[c]] for r, c in enumerate(order[:9])}
    if species > 9:
        want.setdefault(other, [10, 0.0])[1] += sum(kg[c] for c in order[9:])
    assert {r.species_code: [r["rank"], r.Tonnes * 1000] for r in got.collect()} == {
        c: [r, pytest.approx(v)] for c, (r, v) in want.items()}


def test_day_states_stand_for_their_trips(spark):
    """Months, daily series and the guard come out alike from trips and from their states, and
    after a refresh of some months."""
    from landfall.operators.aggregates import daily_cpue
    from landfall.operators.filters import enough_rows
    from landfall.operators.states import day_states, refresh_states
    kind = "date date, municipality_code int, habitat_code int, gear_code int, boat_code int, KG double, trip_effort double"

    def rows(shift=0):
        return [(None if i % 50 == 0 else dt.date(2019, 1 + i % 4, 1 + i // 4 % 6), 1 + i % 3, 1, 1 if i % 9 else None, 1 + i % 2,
                 0.1 * i + (shift if i % 4 == 2 or i % 50 == 0 else 0), 1.7) for i in range(400)]
    spine = month_spine(spark, dt.date(2019, 1, 1), dt.date(2019, 5, 31))
    old, new = (spark.createDataFrame(rows(x), kind) for x in (0, 5))
    part = new.where("month(date) = 3 or date is null")
    states = refresh_states(day_states(old), part, [dt.date(2019, 3, 1), None])
    plain = lambda df: sorted(map(repr, df.collect()))
    assert states.count() < new.count() / 2
    assert plain(monthly_cpue(states, spine)) == plain(monthly_cpue(new, spine)) != plain(monthly_cpue(old, spine))
    assert plain(daily_cpue(states, "municipality_code", "abc")) == plain(daily_cpue(new, "municipality_code", "abc"))
    few = spark.createDataFrame([r for r in rows() if r[0] and r[0].month == 1][:29], kind)
    for df, ok in ((few, False), (few.unionByName(few.limit(1)), True)):
        assert [spark.range(1).select(enough_rows(x, 30).alias("ok")).first()["ok"] for x in (df, day_states(df))] == [ok, ok]
