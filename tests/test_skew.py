"""Results stay exact when one trip holds most landings and the joins run as
sort-merge joins whose skewed partitions adaptive execution splits."""

import datetime as dt

from pyspark.sql import functions as F

from landfall.config import Params
from landfall.operators.aggregates import species_catch
from landfall.operators.joins import keep_with
from landfall.plans.clean import clean_trips, persist_clean
from landfall.tables import Tables
from tests.helpers import landing, landings_df, trip, trips_df

P = Params(min_date=dt.date(2016, 9, 1), as_of=dt.date(2021, 1, 1))

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_trip_is_exact_under_skew_splitting(spark):
    stations = spark.createDataFrame([(1, "S1", 1)],
                                     "station_code int, station_name string, municipality_code int")
    trips = trips_df(spark, [trip(i, effort=100.0) for i in range(50)])
    rows = [landing(0, species=1 + i % 7, weight=10.0 + i) for i in range(3000)]
    rows += [landing(i, species=2, weight=500.0) for i in range(1, 50)]
    lnd = landings_df(spark, rows).repartition(8)

    src = Tables(trips=trips, landings=lnd, stations=stations)

    def run():
        c = persist_clean(src, P, "skew-test")   # stored decisions: plain shuffles on both sides
        t, kl = c.trips, c.landings
        kept = keep_with(kl, t.filter(F.col("trip_id") < 10), "trip_id").drop("month")
        return ({r.trip_id: r.KG for r in t.collect()},
                sorted((r.species_code, r.KG) for r in species_catch(kept).collect()))

    skewed = _with_conf(spark, SKEW_CONF, run)
    lazy_t, lazy_l = clean_trips(trips, lnd, stations, P)
    plain = ({r.trip_id: r.KG for r in lazy_t.collect()},
             sorted((r.species_code, r.KG) for r in species_catch(
                 keep_with(lazy_l, lazy_t.filter(F.col("trip_id") < 10), "trip_id")).collect()))
    assert skewed == plain
    kg, species = skewed
    assert kg[0] == sum(10.0 + i for i in range(3000)) / 1000
    assert len(kg) == 50


def test_hot_trip_join_is_split(spark):
    """The join of landings with the stored per-trip decisions runs with skew splitting."""
    hot = [landing(0, species=1 + i % 7, weight=10.0 + i) for i in range(20_000)]
    lnd = landings_df(spark, hot + [landing(i) for i in range(1, 400)]).repartition(16)
    decision = spark.range(400).selectExpr("id AS trip_id", "repeat('x', 50) AS pad").repartition(8)

    def run():
        j = lnd.join(decision, "trip_id", "inner")
        n = len(j.collect())
        return n, j._jdf.queryExecution().executedPlan().toString()

    n, plan = _with_conf(spark, SKEW_CONF, run)
    assert n == 20_399 and "skew=true" in plan
