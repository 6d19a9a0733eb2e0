"""Heat classes, polygon marking and the key checks on hand-made rows."""

from pyspark.sql import functions as F

from landfall.operators.quality import cascade_delete, check_fk, check_pk
from landfall.operators.spatial import heat, heat_classes, mark_selected, pretty_unit


def test_pretty_steps_match_known_breaks(spark):
    # pretty(c(0, top), n = 7) steps: 0..1 by 0.2, 0..3 by 0.5, 0..7 by 1, 0..10 by 2
    df = spark.createDataFrame([(1.0,), (3.0,), (7.0,), (10.0,)], "top double")
    got = [r.u for r in df.select(pretty_unit(F.col("top"), 7).alias("u")).collect()]
    assert got == [0.2, 0.5, 1.0, 2.0]


def test_heat_classes(spark):
    pts = spark.createDataFrame(
        [(1, "-8.5,125.1")] + [(i, "-8.6,125.2") for i in range(3)]
        + [(i, "-8.7,125.3") for i in range(8)] + [(9, None)], "PDS_trip long, latlng string")
    h = heat(pts)
    rows = {r.Lat: r for r in heat_classes(h, 7).collect()}
    assert [rows[x].intensity for x in (-8.5, -8.6, -8.7)] == [1.0, 2.0, 3.0]
    assert {r.step for r in rows.values()} == {0.5}
    assert [rows[x]["class"] for x in (-8.5, -8.6, -8.7)] == [3, 5, 6]   # top value in last class
    assert {r.n_classes for r in rows.values()} == {6}


def test_mark_selected(spark):
    shape = spark.createDataFrame([("A", 0.0, 0.0, "A", "grey"), ("B", 1.0, 1.0, "B", "grey")],
                                  "id string, long double, lat double, group string, colr string")
    got = {r.id: r.colr for r in mark_selected(shape, ["B"]).collect()}
    assert got == {"A": "grey", "B": "cornflowerblue"}


def test_check_pk_and_fk(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    assert {(r.k, r.n) for r in check_pk(df, "k").collect()} == {(1, 2), (None, 1)}
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(1,), (3,), (None,)], "k long")
    assert [r.k for r in check_fk(child, "k", parent).collect()] == [3]


def test_cascade_delete_follows_two_levels(spark):
    pds = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "PDS_trip long, station_code int")
    pts = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "PDS_trip long, latlng string")
    stations = spark.createDataFrame([(5, 1), (6, 2)], "station_code int, municipality_code int")
    out = cascade_delete({"stations": stations, "pds_trips": pds, "pds_points": pts}, "stations",
                         spark.createDataFrame([(5,)], "station_code int"))
    assert [r.station_code for r in out["stations"].collect()] == [6]
    assert [r.PDS_trip for r in out["pds_trips"].collect()] == [3]
    assert [r.latlng for r in out["pds_points"].collect()] == ["w"]


def test_cascade_reaches_tracked_trips_by_both_edges(spark):
    trips = spark.createDataFrame([(1,), (2,), (3,)], "trip_id long")
    pds = spark.createDataFrame([(10, 1, None), (11, None, 1), (12, 2, None)], "PDS_trip long, trip_id long, donor_tripid long")
    pts = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "PDS_trip long, latlng string")
    out = cascade_delete({"pds_points": pts, "pds_trips": pds, "trips": trips}, "trips",
                         spark.createDataFrame([(1,)], "trip_id long"))
    assert [r.PDS_trip for r in out["pds_trips"].collect()] == [12]
    assert [r.latlng for r in out["pds_points"].collect()] == ["c"]
