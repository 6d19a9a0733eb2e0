"""Stand-in fishery tables built from the supplied test tables.

These only give rows in the schemas the jobs expect (FIXTURES.md part B); they
compute nothing the jobs compute. Trips, landings, tracked trips, points, species and
heat cells grow with their sources; municipalities, stations and shape come from the
25 nations at every scale. Some measurements are NaN, as a database export writes
missing numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfall.functions.columns import nan_to_null
from landfall.sources.snapshot import read_table
from landfall.tables import Tables


def _src(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, {"format": "parquet", "path": f"{sf_dir}/{name}.parquet"})


def municipalities(spark, sf_dir) -> DataFrame:
    return municipalities_from_nation(_src(spark, sf_dir, "nation"))


def municipalities_from_nation(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    return nation.select((k + 1).cast("int").alias("municipality_code"),
                    F.col("n_name").alias("municipality_name"),
                    (100 + 37 * k).cast("int").alias("canoes"),
                    (20 + 11 * k).cast("int").alias("motors"))


def stations(spark, sf_dir) -> DataFrame:
    """All nations but the last, so that the last one's trips have no station."""
    n = _src(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 24)
    k = F.col("n_nationkey")
    return n.select((k + 1).cast("int").alias("station_code"),
                    F.col("n_name").alias("station_name"),
                    ((k % 12) + 1).cast("int").alias("municipality_code"))


def species(spark, sf_dir) -> DataFrame:
    """Every part is a species; part 0 is the code for others."""
    p = _src(spark, sf_dir, "part").filter(F.col("p_partkey") != 300)
    return p.select(F.when(F.col("p_partkey") == 0, 300).otherwise(F.col("p_partkey"))
                    .cast("int").alias("species_code"),
                    F.col("p_type").alias("category"),
                    F.col("p_name").alias("category_tetun"))


def _nan_every(key, m, value):
    return F.when(key % m == 0, F.lit(float("nan"))).otherwise(value)


def _null_every(key, m, value):
    return F.when(key % m == 0, F.lit(None)).otherwise(value)


def trips(spark, sf_dir) -> DataFrame:
    o = _src(spark, sf_dir, "orders")
    c = _src(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    d = F.col("o_orderdate").cast("date")
    return nan_to_null(j.select(
        k.alias("trip_id"),
        _null_every(k, 307, d.cast("string")).alias("date"),
        (F.col("c_nationkey") + 1).cast("int").alias("station_code"),
        _null_every(k, 53, 1 + k % 7).cast("int").alias("habitat_code"),
        _null_every(k, 211, 1 + ck % 3).cast("int").alias("boat_code"),
        _null_every(k, 67, 1 + k % 9).cast("int").alias("gear_code"),
        (k % 80).cast("int").alias("trip_hours"),
        _nan_every(k, 109, _null_every(k, 101, (k * 13) % 160).cast("double")).alias("trip_effort"),
        F.when(ck % 10 == 0, F.lit(9376082)).otherwise(ck).cast("string").alias("IMEI"),
        _nan_every(k, 113, F.datediff(d, F.lit("1970-01-01").cast("date")).cast("double")).alias("date_numeric"),
    ))


def landings_once(spark, sf_dir) -> DataFrame:
    return landings_from_lineitem(_src(spark, sf_dir, "lineitem"))


def landings_from_lineitem(li: DataFrame) -> DataFrame:
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        ok.alias("trip_id"),
        F.when(pk == 0, 300).otherwise(pk).cast("int").alias("species_code"),
        _nan_every(ok + 3 * pk, 107, F.when((ok + pk) % 97 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
                   .cast("double")).alias("length"),
        F.col("l_linenumber").alias("nfish"),
        _nan_every(3 * ok + pk, 103, F.col("l_extendedprice")).alias("weight_g"),
        F.when(pk % 2 == 0, F.lit("food")).otherwise(F.lit("sale")).alias("food_sale"),
        F.when((ok * 7 + pk) % 89 == 0, 1).when(pk % 5 == 0, 4).otherwise(0)
        .cast("int").alias("flag_code"),
        F.when(pk % 11 == 0, F.lit("seen")).alias("note"),
    )


def twice(once: DataFrame) -> DataFrame:
    """One trip in twenty is reported twice: every other one word for word (repeats to
    remove), the others with another note (different rows to keep)."""
    again = F.when(F.col("trip_id") % 40 == 0, F.lit("counted again")).otherwise(F.col("note"))
    notes = F.when(F.col("trip_id") % 20 == 0, F.array("note", again)).otherwise(F.array("note"))
    return once.select(*[c for c in once.columns if c != "note"], F.explode(notes).alias("note")).select(*once.columns)


def landings(spark, sf_dir) -> DataFrame:
    return nan_to_null(twice(landings_once(spark, sf_dir)))


def _pds_key():
    return (F.col("user_id") * 31 + F.dayofmonth("ts").cast("bigint")).alias("PDS_trip")


def pds_points(spark, sf_dir) -> DataFrame:
    e = _src(spark, sf_dir, "events")
    ev, u = F.col("event_id"), F.col("user_id")
    return e.select(_pds_key(), F.concat(
        F.lit("-8."), (10 + (u * 7 + ev) % 90).cast("string"), F.lit(",125."),
        (ev % 10).cast("string"), (u % 100).cast("string")).alias("latlng"))


def pds_trips(spark, sf_dir) -> DataFrame:
    """One tracked trip per (user, day) of ``events``; dates moved back 312 months
    so that tracks and reported trips share one calendar (1998-01)."""
    e = _src(spark, sf_dir, "events")
    x = e.groupBy(_pds_key()).agg(F.min(F.col("ts").cast("date")).alias("d"))
    t = F.col("PDS_trip")
    return x.select(
        t,
        F.add_months("d", -312).cast("string").alias("date"),
        _null_every(t, 41, 1 + t % 2).cast("int").alias("boat_code"),
        (1 + t % 24).cast("int").alias("station_code"),
        (1 + t % 9).cast("int").alias("gear_code"),
        (1 + t % 7).cast("int").alias("habitat_code"),
        F.when(t % 3 == 0, t).alias("trip_id"),
        F.when(t % 3 == 1, t + 1).alias("donor_tripid"),
    )


def shape(spark, sf_dir) -> DataFrame:
    n = _src(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("double").alias("long"),
                    F.col("n_regionkey").cast("double").alias("lat"),
                    F.col("n_name").alias("group"), F.lit("grey").alias("colr"))


def signatures(spark, sf_dir) -> DataFrame:
    """Track signatures: id, 20 doubles, the linked trip's gear and habitat."""
    e = _src(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trip_id"),
                    F.slice("embedding", 1, 20).cast("array<double>").alias("features"),
                    F.col("label").alias("gear_code"),
                    (F.col("label") % 3).alias("habitat_code"))


def tracks(spark, sf_dir) -> DataFrame:
    """Tracked trips with 20-number track columns: the first 20 elements of an
    embedding as lat1..lat10, lng1..lng10. One trip in five has no reported
    trip (no trip id, gear or habitat): those are the ones to fill."""
    e = _src(spark, sf_dir, "embeddings")
    linked = F.col("vec_id") % 5 != 0
    pos = [F.element_at("embedding", i + 1).cast("double") for i in range(20)]
    return e.select(
        F.col("vec_id").alias("PDS_trip"),
        F.when(linked, F.col("vec_id")).alias("trip_id"),
        F.when(linked, F.col("label")).alias("gear_code"),
        F.when(linked, F.col("label") % 3).alias("habitat_code"),
        *[p.alias(f"lat{i + 1}") for i, p in enumerate(pos[:10])],
        *[p.alias(f"lng{i + 1}") for i, p in enumerate(pos[10:])])


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        trips=trips(spark, sf_dir), landings=landings(spark, sf_dir),
        pds_trips=pds_trips(spark, sf_dir), pds_points=pds_points(spark, sf_dir),
        municipalities=municipalities(spark, sf_dir), stations=stations(spark, sf_dir),
        species=species(spark, sf_dir), shape=shape(spark, sf_dir),
    )


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Code tables of the key checks, from the same sources; a few codes are left out."""
    part = _src(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    codes = lambda name, n: part.filter((F.col("k") > 0) & (F.col("k") <= n)).select(
        F.col("k").cast("int").alias(name))
    return {"boat_types": codes("boat_code", 2), "gear_types": codes("gear_code", 9),
            "habitat_types": codes("habitat_code", 6),
            "flags": part.filter(F.col("k").isin(0, 4, 5)).select(F.col("k").cast("int").alias("flag_code")),
            "rankings": codes("rank_code", 5), "boats": boats(spark, sf_dir), "vacs": vacs(spark, sf_dir)}


def boats(spark, sf_dir) -> DataFrame:
    """Every customer is a boat; one in 50 comes twice, one in 90 has no known boat type."""
    c = _src(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    c = c.unionByName(c.filter(F.col("k") % 50 == 0))
    return c.select(F.col("k").cast("int").alias("boat_id"),
                    F.when(F.col("k") % 90 == 0, 7).otherwise(1 + F.col("k") % 2).cast("int").alias("boat_code"))


def vacs(spark, sf_dir) -> DataFrame:
    """Every supplier is a vessel activity coefficient; one in 20 has no code."""
    s = F.col("s_suppkey")
    return _src(spark, sf_dir, "supplier").select(
        _null_every(s, 20, s).cast("int").alias("vac_code"), (1 + s % 3).cast("int").alias("boat_code"))


def keyed_trips(trips: DataFrame) -> DataFrame:
    """Trips with the columns that only the key checks look at."""
    k = F.col("trip_id")
    return trips.withColumns({"rank_code": _null_every(k, 59, 1 + k % 6).cast("int"),
                              "flag_code": _null_every(k, 61, F.when(k % 30 == 0, 1).otherwise(4 * (k % 2))).cast("int")})


def keyed_tracks(pds_trips: DataFrame) -> DataFrame:
    """Tracked trips with the boat that only the key checks look at."""
    k = F.col("PDS_trip")
    return pds_trips.withColumn("boat_id", _null_every(k, 43, k % 2000).cast("int"))
