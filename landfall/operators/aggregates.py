"""Aggregations: catch per species, monthly CPUE (with per-boat-type parts in the
same group), fleet size, raised national catch, daily CPUE series, the top
species with an "other" group, catch shares and the Total row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfall.functions.columns import clip_low, exact_sum, fill_zero, kg_sum, species_label
from landfall.functions.dates import month_floor
from landfall.operators.filters import min_points

CANOE, MOTOR = 1, 2
TOP_PARTS = 64


def species_catch(landings: DataFrame) -> DataFrame:
    """KG per species (partial sums map-side; one row per species)."""
    return landings.groupBy("species_code").agg(kg_sum("weight_g").alias("KG"))


def _cond_sum(cond, col):
    return exact_sum(F.when(cond, F.col(col)))


def monthly_cpue(trips: DataFrame, spine: DataFrame) -> DataFrame:
    """Per month of the spine: KG, effort, CPUE as a ratio of sums, trips and
    distinct fishing days, plus the same sums for canoes and motors (conditional
    sums in the one grouping, no second scan). Empty months are 0. ``trips`` may be day
    states, which stand for ``n_trips`` trips each."""
    b = F.col("boat_code")
    one = F.col("n_trips") if "n_trips" in trips.columns else F.lit(1)
    n_of = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0))
    g = (trips.withColumn("month", month_floor("date")).groupBy("month").agg(
        exact_sum("KG").alias("KG"), exact_sum("trip_effort").alias("trip_effort"),
        F.sum(one).alias("trips"), F.count_distinct("date").alias("fishing_days"),
        _cond_sum(b == CANOE, "KG").alias("KG_canoe"),
        _cond_sum(b == CANOE, "trip_effort").alias("effort_canoe"),
        n_of(b == CANOE).alias("trips_canoe"),
        _cond_sum(b == MOTOR, "KG").alias("KG_motor"),
        _cond_sum(b == MOTOR, "trip_effort").alias("effort_motor"),
        n_of(b == MOTOR).alias("trips_motor")))
    m = spine.join(g, "month", "left")
    m = m.withColumns({
        "CPUE": F.try_divide(F.col("KG"), F.col("trip_effort")),
        "CPUE_canoe": F.try_divide(F.col("KG_canoe"), F.col("effort_canoe")),
        "CPUE_motor": F.try_divide(F.col("KG_motor"), F.col("effort_motor")),
    })
    return fill_zero(m, ["KG", "trip_effort", "CPUE", "trips", "fishing_days", "CPUE_canoe",
                         "CPUE_motor", "trips_canoe", "trips_motor"])


def boat_cpue(monthly: DataFrame) -> DataFrame:
    """Monthly CPUE of canoes and of motor boats on the full month spine."""
    return monthly.select("month", "CPUE_canoe", "CPUE_motor", "trips_canoe", "trips_motor")


def fleet_size(munis: DataFrame, boats_selected) -> DataFrame:
    """One row: canoes and motors over the selected municipalities. A NULL count
    makes its sum NULL; a boat type that is not selected counts 0."""
    sel = set(boats_selected)

    def total(c, code):
        if code not in sel:
            return F.lit(0).cast("bigint").alias(c)
        return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)

    return munis.agg(total("canoes", CANOE), total("motors", MOTOR))


def national_catch(monthly: DataFrame, fleet: DataFrame, params, enabled: bool) -> DataFrame:
    """Raised national catch in tonnes per month: for canoes and motor boats,
    CPUE x hours per trip x trips per month x fleet size / 1000. Zero unless
    raising is enabled (every gear and habitat selected) and the slice holds
    trips of that boat type."""
    if not enabled:
        return monthly.withColumn("natcatch", F.lit(0.0))
    canoes = fleet.select(F.col("canoes").cast("double")).scalar()
    motors = fleet.select(F.col("motors").cast("double")).scalar()
    whole = Window.partitionBy()  # the spine: one row per month of the window
    any_canoe = F.sum("trips_canoe").over(whole) > 0
    any_motor = F.sum("trips_motor").over(whole) > 0
    part_c = F.when(any_canoe, F.col("CPUE_canoe") * params.hours_per_trip_canoe
                    * params.trips_per_month_canoe * canoes * 0.001).otherwise(F.lit(0.0))
    part_m = F.when(any_motor, F.col("CPUE_motor") * params.hours_per_trip_motor
                    * params.trips_per_month_motor * motors * 0.001).otherwise(F.lit(0.0))
    return monthly.withColumn("natcatch", part_c + part_m)


def daily_sums(trips: DataFrame, dim_cols) -> DataFrame:
    """KG and effort per (date, code) for every column of ``dim_cols`` in one pass over the
    trips: date, dim (the column's name), code, KG and trip_effort. Each column is one
    grouping set."""
    dims = list(dim_cols)
    sets = [[F.col("date"), F.col(d)] for d in dims]
    g = trips.select("date", *dims, "KG", "trip_effort").groupingSets(sets, "date", *dims).agg(
        exact_sum("KG").alias("KG"), exact_sum("trip_effort").alias("trip_effort"),
        *[F.grouping(d).alias(f"_not_{d}") for d in dims])
    pick = lambda value: F.coalesce(*[F.when(F.col(f"_not_{d}") == 0, value(d)) for d in dims])
    return g.select("date", pick(F.lit).alias("dim"), pick(F.col).alias("code"), "KG", "trip_effort")


def daily_cpue(trips: DataFrame, dim_col: str, labels, min_days: int = 5,
               spar: float = 0.0) -> DataFrame:
    """Daily series per code of ``dim_col``: see :func:`daily_series`."""
    d = trips.groupBy("date", F.col(dim_col).alias("code")).agg(
        exact_sum("KG").alias("KG"), exact_sum("trip_effort").alias("trip_effort"))
    return daily_series(d, labels, min_days, spar)


def daily_series(sums: DataFrame, labels, min_days: int = 5, spar: float = 0.0) -> DataFrame:
    """Daily series from KG and effort per (date, code): series with fewer than
    ``min_days`` days dropped; CPUE; label from the fixed list; ``fit`` = CPUE or its
    weighted smoothing spline; negative fits to 0."""
    d = min_points(sums.select("date", "code", "KG", "trip_effort"), "code", min_days)
    d = d.withColumn("CPUE", F.try_divide(F.col("KG"), F.col("trip_effort")))
    d = d.withColumn("label", F.try_element_at(F.array(*[F.lit(x) for x in labels]),
                                               F.col("code")))
    d = d.withColumn("fit", F.col("CPUE"))
    if spar > 0:
        from landfall.operators.smooth import smooth_series
        d = smooth_series(d, "code", "date", "CPUE", "trip_effort", spar)
    return clip_low(d, "fit").select("date", "code", "label", "KG", "trip_effort", "CPUE", "fit")


def top_species(catch: DataFrame, species: DataFrame, n: int = 9, other: int = 300
                ) -> DataFrame:
    """The ``n`` species with most catch, the rest folded into code ``other``.

    Ranked by KG descending, ties by code. With more than ``n`` species the tail
    is summed: if ``other`` is among the first ``n`` the sum is added to it in
    place (``n`` rows), else a row ``other`` is appended at rank ``n + 1``. ``catch`` is
    read once: each of ``TOP_PARTS`` parts of the codes keeps its first ``n`` species and
    the sum of its others, and one window numbers those few rows, so the number of
    species codes in the landings does not matter.
    """
    order = [F.desc("KG"), F.asc("species_code")]
    part = F.pmod(F.xxhash64("species_code"), F.lit(TOP_PARTS)).alias("_part")
    ranked = catch.select("species_code", "KG", part).withColumn(
        "_first", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) <= n)
    few = ranked.groupBy("_part", "_first", F.when(F.col("_first"), F.col("species_code")).alias("species_code")).agg(
        exact_sum("KG").alias("KG"))
    rank = F.row_number().over(Window.orderBy(F.desc("_first"), *order))
    few = few.withColumn("rank", F.least(rank, F.lit(n + 1)))
    head = F.col("rank") <= F.lit(n)
    g = (few.withColumn("species_code", F.when(F.col("_first") & head, F.col("species_code")).otherwise(F.lit(other)).cast("int"))
         .groupBy("species_code").agg(exact_sum("KG").alias("KG"), F.min("rank").alias("rank")))
    sp = species.groupBy("species_code").agg(
        F.min(species_label()).alias("species"))
    return (g.join(sp, "species_code", "left")
            .select("rank", "species_code", "species", (F.col("KG") / 1000.0).alias("Tonnes")))


def species_share(top: DataFrame) -> DataFrame:
    """Share of each top-species row in the total tonnes (pie slices)."""
    return top.withColumn("share", F.col("Tonnes") / F.sum("Tonnes").over(Window.partitionBy()))


def with_total(summary: DataFrame) -> DataFrame:
    """Monthly summary plus a Total row: sums of days, trips, effort, KG and
    national catch (NULL if a month's is NULL); CPUE of the total is total KG /
    total effort. The input has one row per month, so this is a tiny aggregate."""
    t = summary.agg(
        F.count(F.lit(1)).alias("_months"),
        F.sum("fishing_days").alias("fishing_days"), F.sum("trips").alias("trips"),
        exact_sum("trip_effort").alias("trip_effort"), exact_sum("KG").alias("KG"),
        F.when(F.count("natcatch") == F.count(F.lit(1)), F.sum("natcatch")).alias("natcatch"))
    t = (t.filter(F.col("_months") > 0).drop("_months")   # no months (guarded): no Total
         .withColumn("CPUE", F.try_divide(F.col("KG"), F.col("trip_effort"))))
    body = summary.withColumn("is_total", F.lit(False))
    tail = t.withColumn("month", F.lit(None).cast("date")).withColumn("is_total", F.lit(True))
    return body.unionByName(tail.select(*body.columns))
