"""DuckDB SQL for every registered query (the correctness oracle).

Written from the rules' descriptions, not from the Spark code, over the same
stand-in tables (the FIXTURES.md views, repeated here as CTEs). Parameters are
those of :mod:`landfall.catalog`.
"""

from __future__ import annotations

SITES = ", ".join(f"'NATION_{i}'" for i in range(12))
SEL_SITES = ", ".join(f"'NATION_{i}'" for i in range(9))

FIX = """
f_municipalities AS (
  SELECT CAST(n_nationkey+1 AS INTEGER) AS municipality_code, n_name AS municipality_name,
         CAST(100+37*n_nationkey AS INTEGER) AS canoes, CAST(20+11*n_nationkey AS INTEGER) AS motors
  FROM nation),
f_stations AS (
  SELECT CAST(n_nationkey+1 AS INTEGER) AS station_code, n_name AS station_name,
         CAST((n_nationkey % 12)+1 AS INTEGER) AS municipality_code
  FROM nation WHERE n_nationkey < 24),
f_species AS (
  SELECT CAST(CASE WHEN p_partkey = 0 THEN 300 ELSE p_partkey END AS INTEGER) AS species_code,
         p_type AS category, p_name AS category_tetun
  FROM part WHERE p_partkey <> 300),
f_trips0 AS (
  SELECT o_orderkey AS trip_id,
         CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
         CAST(c_nationkey+1 AS INTEGER) AS station_code,
         CAST(CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 1 + o_orderkey % 7 END AS INTEGER) AS habitat_code,
         CAST(CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE 1 + o_custkey % 3 END AS INTEGER) AS boat_code,
         CAST(CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE 1 + o_orderkey % 9 END AS INTEGER) AS gear_code,
         CAST(o_orderkey % 80 AS INTEGER) AS trip_hours,
         CASE WHEN o_orderkey % 109 = 0 THEN 'NaN'::DOUBLE
              ELSE CAST(CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE (o_orderkey*13) % 160 END AS DOUBLE) END AS trip_effort,
         CAST(CASE WHEN o_custkey % 10 = 0 THEN 9376082 ELSE o_custkey END AS VARCHAR) AS IMEI,
         CASE WHEN o_orderkey % 113 = 0 THEN 'NaN'::DOUBLE
              ELSE CAST(DATEDIFF('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) END AS date_numeric
  FROM orders JOIN customer ON o_custkey = c_custkey),
f_trips AS (
  SELECT * REPLACE (CASE WHEN NOT isnan(trip_effort) THEN trip_effort END AS trip_effort,
                    CASE WHEN NOT isnan(date_numeric) THEN date_numeric END AS date_numeric) FROM f_trips0),
f_landings0 AS (
  SELECT l_orderkey AS trip_id,
         CAST(CASE WHEN l_partkey = 0 THEN 300 ELSE l_partkey END AS INTEGER) AS species_code,
         CASE WHEN (l_orderkey+3*l_partkey) % 107 = 0 THEN 'NaN'::DOUBLE
              WHEN (l_orderkey+l_partkey) % 97 = 0 THEN NULL ELSE l_quantity END AS length,
         l_linenumber AS nfish,
         CASE WHEN (3*l_orderkey+l_partkey) % 103 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS weight_g,
         CASE WHEN l_partkey % 2 = 0 THEN 'food' ELSE 'sale' END AS food_sale,
         CAST(CASE WHEN (l_orderkey*7+l_partkey) % 89 = 0 THEN 1
                   WHEN l_partkey % 5 = 0 THEN 4 ELSE 0 END AS INTEGER) AS flag_code,
         CASE WHEN l_partkey % 11 = 0 THEN 'seen' END AS note
  FROM lineitem),
f_landings_once AS (
  SELECT * REPLACE (CASE WHEN NOT isnan(length) THEN length END AS length,
                    CASE WHEN NOT isnan(weight_g) THEN weight_g END AS weight_g) FROM f_landings0),
f_landings AS (
  SELECT * FROM f_landings_once
  UNION ALL SELECT * REPLACE (CASE WHEN trip_id % 40 = 0 THEN 'counted again' ELSE note END AS note)
  FROM f_landings_once WHERE trip_id % 20 = 0),
f_pds_points AS (
  SELECT user_id*31 + CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS PDS_trip,
         CONCAT('-8.', CAST(10 + (user_id*7+event_id) % 90 AS VARCHAR), ',125.',
                CAST(event_id % 10 AS VARCHAR), CAST(user_id % 100 AS VARCHAR)) AS latlng
  FROM events),
f_pds_trips AS (
  SELECT PDS_trip, CAST(CAST(d - INTERVAL 312 MONTH AS DATE) AS VARCHAR) AS date,
         CAST(CASE WHEN PDS_trip % 41 = 0 THEN NULL ELSE 1 + PDS_trip % 2 END AS INTEGER) AS boat_code,
         CAST(1 + PDS_trip % 24 AS INTEGER) AS station_code,
         CAST(1 + PDS_trip % 9 AS INTEGER) AS gear_code, CAST(1 + PDS_trip % 7 AS INTEGER) AS habitat_code,
         CASE WHEN PDS_trip % 3 = 0 THEN PDS_trip END AS trip_id, CASE WHEN PDS_trip % 3 = 1 THEN PDS_trip + 1 END AS donor_tripid
  FROM (SELECT user_id*31 + CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS PDS_trip, MIN(CAST(ts AS DATE)) AS d
        FROM events GROUP BY 1) x),
f_shape AS (
  SELECT n_name AS id, CAST(n_nationkey AS DOUBLE) AS long, CAST(n_regionkey AS DOUBLE) AS lat,
         n_name AS "group", 'grey' AS colr FROM nation),
f_sig AS (
  SELECT vec_id AS trip_id, CAST(embedding[1:20] AS DOUBLE[]) AS features,
         label AS gear_code, label % 3 AS habitat_code FROM embeddings)
"""

# Refreshed tables (full-row dedupe) and the row-level steps on trips.
REFRESHED = """
r_trips AS (SELECT DISTINCT * FROM f_trips),
r_landings AS (SELECT DISTINCT * FROM f_landings),
r_pds_trips AS (SELECT DISTINCT * FROM f_pds_trips),
r_pds_points AS (SELECT DISTINCT * FROM f_pds_points),
stn AS (SELECT station_code, MIN(municipality_code) AS municipality_code FROM f_stations GROUP BY 1),
prep AS (
  SELECT t.trip_id, TRY_CAST(t.date AS DATE) AS date, stn.municipality_code,
         CAST(CASE t.habitat_code WHEN 5 THEN 2 WHEN 6 THEN 5 WHEN 7 THEN 6 ELSE t.habitat_code END AS INTEGER) AS habitat_code,
         t.boat_code, t.gear_code,
         CAST(CASE WHEN t.trip_hours = 0 THEN 3 WHEN t.trip_hours > 72 THEN 72 ELSE t.trip_hours END AS INTEGER) AS trip_hours,
         CASE WHEN t.trip_effort = 0 THEN 3.0 WHEN t.trip_effort > 144 THEN 144.0 ELSE t.trip_effort END AS trip_effort,
         CASE WHEN t.IMEI = '9376082' AND t.date_numeric > 10500 THEN '6738430' ELSE t.IMEI END AS IMEI,
         t.date_numeric
  FROM r_trips t LEFT JOIN stn ON t.station_code = stn.station_code)
"""

# Cleaning: R1 as described (discards are trip-wide; NULL dates survive).
CLEAN = """
lflags AS (
  SELECT trip_id,
         bool_or(species_code IS NULL OR length IS NULL OR nfish IS NULL OR weight_g IS NULL
                 OR flag_code IS NULL) AS incomplete,
         bool_or(flag_code IS NULL OR flag_code NOT IN (0, 4, 5)) AS bad_flag,
         CAST(SUM(CAST(weight_g AS DECIMAL(28,9))) AS DOUBLE) / 1000.0 AS KG
  FROM r_landings GROUP BY trip_id),
c_trips AS (
  SELECT p.*, COALESCE(f.KG, 0.0) AS KG
  FROM prep p LEFT JOIN lflags f ON p.trip_id = f.trip_id
  WHERE NOT COALESCE(f.incomplete, FALSE) AND NOT COALESCE(f.bad_flag, FALSE)
    AND p.municipality_code IS NOT NULL AND p.habitat_code IS NOT NULL
    AND p.gear_code IS NOT NULL AND p.trip_effort IS NOT NULL
    AND (p.date IS NULL OR (p.date >= DATE '1996-01-01' AND p.date < DATE '2001-07-01'))
    AND NOT COALESCE(COALESCE(f.KG, 0.0) / NULLIF(p.trip_effort, 0) > 100, FALSE)),
c_bad AS (
  (SELECT trip_id FROM prep EXCEPT SELECT trip_id FROM c_trips)
  UNION SELECT trip_id FROM lflags WHERE incomplete OR bad_flag),
c_landings AS (
  SELECT * FROM r_landings l WHERE NOT EXISTS (SELECT 1 FROM c_bad b WHERE b.trip_id = l.trip_id)),
pt AS (
  SELECT PDS_trip, TRY_CAST(date AS DATE) AS date, boat_code, station_code, gear_code,
         CAST(CASE habitat_code WHEN 5 THEN 2 WHEN 6 THEN 5 WHEN 7 THEN 6 ELSE habitat_code END AS INTEGER) AS habitat_code,
         trip_id, donor_tripid
  FROM r_pds_trips),
pp1 AS (
  SELECT * FROM r_pds_points
  WHERE PDS_trip NOT IN (SELECT PDS_trip FROM pt WHERE boat_code IS NULL)),
band AS (SELECT DISTINCT PDS_trip FROM pp1 WHERE regexp_matches(latlng, '^-8.11')),
c_pds AS (SELECT * FROM pt WHERE boat_code IS NOT NULL AND PDS_trip NOT IN (SELECT PDS_trip FROM band)),
c_points AS (SELECT * FROM pp1 WHERE PDS_trip NOT IN (SELECT PDS_trip FROM band))
"""


def slice_sql(start="1996-12-31", end="1999-07-01", sites=range(1, 10), habitats=range(1, 7),
              gears=range(1, 10), boats=(1, 2)) -> str:
    """The slice of a selection, with the 30-trip guard."""
    lst = lambda xs: ", ".join(str(x) for x in xs) if len(list(xs)) else "NULL"
    return f"""
s0 AS (
  SELECT * FROM c_trips
  WHERE date > DATE '{start}' AND date < DATE '{end}'
    AND municipality_code IN ({lst(sites)}) AND habitat_code IN ({lst(habitats)})
    AND gear_code IN ({lst(gears)}) AND boat_code IN ({lst(boats)})),
guard AS (SELECT COUNT(*) >= 30 AS ok FROM s0),
s_trips AS (SELECT * FROM s0 WHERE (SELECT ok FROM guard)),
s_landings AS (SELECT * FROM c_landings WHERE trip_id IN (SELECT trip_id FROM s_trips)),
s_pds AS (
  SELECT * FROM c_pds
  WHERE date > DATE '{start}' AND date < DATE '{end}'
    AND station_code IN (SELECT station_code FROM f_stations WHERE municipality_code IN ({lst(sites)}))
    AND habitat_code IN ({lst(habitats)}) AND gear_code IN ({lst(gears)})
    AND boat_code IN ({lst(boats)}) AND (SELECT ok FROM guard)),
s_points AS (SELECT * FROM c_points WHERE PDS_trip IN (SELECT PDS_trip FROM s_pds)),
s_munis AS (
  SELECT municipality_code, municipality_name,
         {'canoes' if 1 in boats else '0'} AS canoes, {'motors' if 2 in boats else '0'} AS motors
  FROM f_municipalities WHERE municipality_code IN ({lst(sites)}) AND (SELECT ok FROM guard)),
spine AS (
  SELECT CAST(m AS DATE) AS month
  FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{start}'),
                                      date_trunc('month', DATE '{end}'), INTERVAL 1 MONTH)) AS m)
  WHERE (SELECT ok FROM guard))
"""


MAIN = slice_sql()
PARTIAL = slice_sql(gears=range(1, 5))
CANOES, MOTORS = slice_sql(boats=(1,)), slice_sql(boats=(2,))
FEW_DAYS = slice_sql(start="1998-03-01", end="1998-03-05")
NO_BOATS = slice_sql(boats=())

MONTHLY = """
mg AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(SUM(CAST(KG AS DECIMAL(28,9))) AS DOUBLE) AS KG,
         CAST(SUM(CAST(trip_effort AS DECIMAL(28,9))) AS DOUBLE) AS trip_effort, COUNT(*) AS trips, COUNT(DISTINCT date) AS fishing_days,
         CAST(SUM(CAST(CASE WHEN boat_code = 1 THEN KG END AS DECIMAL(28,9))) AS DOUBLE) AS kg_c, CAST(SUM(CAST(CASE WHEN boat_code = 1 THEN trip_effort END AS DECIMAL(28,9))) AS DOUBLE) AS ef_c,
         COUNT(CASE WHEN boat_code = 1 THEN 1 END) AS n_c,
         CAST(SUM(CAST(CASE WHEN boat_code = 2 THEN KG END AS DECIMAL(28,9))) AS DOUBLE) AS kg_m, CAST(SUM(CAST(CASE WHEN boat_code = 2 THEN trip_effort END AS DECIMAL(28,9))) AS DOUBLE) AS ef_m,
         COUNT(CASE WHEN boat_code = 2 THEN 1 END) AS n_m
  FROM s_trips GROUP BY 1),
monthly AS (
  SELECT s.month, COALESCE(mg.KG, 0.0) AS KG, COALESCE(mg.trip_effort, 0.0) AS trip_effort,
         COALESCE(mg.KG / NULLIF(mg.trip_effort, 0), 0.0) AS CPUE,
         CAST(COALESCE(mg.trips, 0) AS BIGINT) AS trips,
         CAST(COALESCE(mg.fishing_days, 0) AS BIGINT) AS fishing_days,
         COALESCE(mg.kg_c / NULLIF(mg.ef_c, 0), 0.0) AS CPUE_canoe,
         COALESCE(mg.kg_m / NULLIF(mg.ef_m, 0), 0.0) AS CPUE_motor,
         CAST(COALESCE(mg.n_c, 0) AS BIGINT) AS trips_canoe,
         CAST(COALESCE(mg.n_m, 0) AS BIGINT) AS trips_motor
  FROM spine s LEFT JOIN mg ON mg.month = s.month),
fleet AS (
  SELECT CAST(CASE WHEN COUNT(canoes) = COUNT(*) THEN SUM(canoes) END AS BIGINT) AS canoes,
         CAST(CASE WHEN COUNT(motors) = COUNT(*) THEN SUM(motors) END AS BIGINT) AS motors
  FROM s_munis)
"""


def nat_sql(enabled: bool) -> str:
    if not enabled:
        return "national AS (SELECT month, CAST(0.0 AS DOUBLE) AS natcatch FROM monthly)"
    return """
national AS (
  SELECT month,
    (CASE WHEN (SELECT SUM(trips_canoe) FROM monthly) > 0
          THEN CPUE_canoe * 4 * 8.2 * (SELECT canoes FROM fleet) * 0.001 ELSE 0.0 END)
  + (CASE WHEN (SELECT SUM(trips_motor) FROM monthly) > 0
          THEN CPUE_motor * 10 * 15.3 * (SELECT motors FROM fleet) * 0.001 ELSE 0.0 END) AS natcatch
  FROM monthly)"""


def summary_sql(enabled: bool) -> str:
    return MONTHLY + "," + nat_sql(enabled) + """,
summary AS (
  SELECT m.month, m.fishing_days, m.trips, m.trip_effort, m.KG, m.CPUE, n.natcatch
  FROM monthly m JOIN national n ON m.month = n.month)
"""


def table_sql(enabled: bool) -> str:
    nat = ", CAST(trunc(natcatch) AS BIGINT) AS natcatch" if enabled else ""
    return f"""
SELECT strftime(month, '%b-%Y') AS Month, CAST(trunc(fishing_days) AS BIGINT) AS fishing_days,
       CAST(trunc(trips) AS BIGINT) AS trips, CAST(trunc(trip_effort) AS BIGINT) AS trip_effort,
       CAST(trunc(KG) AS BIGINT) AS KG, round_even(CPUE, 2) AS CPUE{nat}
FROM summary
UNION ALL
SELECT 'Total', CAST(trunc(SUM(fishing_days)) AS BIGINT), CAST(trunc(SUM(trips)) AS BIGINT),
       CAST(trunc(CAST(SUM(CAST(trip_effort AS DECIMAL(28,9))) AS DOUBLE)) AS BIGINT), CAST(trunc(CAST(SUM(CAST(KG AS DECIMAL(28,9))) AS DOUBLE)) AS BIGINT),
       round_even(CAST(SUM(CAST(KG AS DECIMAL(28,9))) AS DOUBLE) / NULLIF(CAST(SUM(CAST(trip_effort AS DECIMAL(28,9))) AS DOUBLE), 0), 2){', CAST(trunc(SUM(natcatch)) AS BIGINT)' if enabled else ''}
FROM summary
"""


def daily_sql(col: str, labels: str, min_days: int) -> str:
    return f"""
dd AS (SELECT date, {col} AS code, CAST(SUM(CAST(KG AS DECIMAL(28,9))) AS DOUBLE) AS KG, CAST(SUM(CAST(trip_effort AS DECIMAL(28,9))) AS DOUBLE) AS trip_effort
       FROM s_trips GROUP BY 1, 2),
dk AS (SELECT * FROM dd WHERE code IN (SELECT code FROM dd GROUP BY code HAVING COUNT(*) >= {min_days})),
daily AS (
  SELECT date, code, [{labels}][code] AS label, KG, trip_effort, KG / NULLIF(trip_effort, 0) AS CPUE,
         CASE WHEN KG / NULLIF(trip_effort, 0) < 0 THEN 0.0 ELSE KG / NULLIF(trip_effort, 0) END AS fit
  FROM dk)
"""


HAB_LABELS = ", ".join(f"'H{i}'" for i in range(1, 7))
GEAR_LABELS = ", ".join(f"'G{i}'" for i in range(1, 10))

TOP = """
sc AS (SELECT species_code, CAST(SUM(CAST(weight_g AS DECIMAL(28,9))) AS DOUBLE) / 1000.0 AS KG FROM s_landings GROUP BY 1),
rk AS (SELECT species_code, KG, row_number() OVER (ORDER BY KG DESC, species_code) AS rnk,
              COUNT(*) OVER () AS n FROM sc),
head AS (SELECT * FROM rk WHERE rnk <= 9 OR n <= 9),
tail AS (SELECT CAST(SUM(CAST(KG AS DECIMAL(28,9))) AS DOUBLE) AS KG FROM rk WHERE rnk > 9 AND n > 9),
top9 AS (
  SELECT species_code, KG + CASE WHEN species_code = 300 THEN COALESCE((SELECT KG FROM tail), 0) ELSE 0 END AS KG, rnk
  FROM head
  UNION ALL
  SELECT 300, (SELECT KG FROM tail), 10
  WHERE (SELECT MAX(n) FROM rk) > 9 AND NOT EXISTS (SELECT 1 FROM head WHERE species_code = 300)),
splab AS (SELECT species_code, MIN(COALESCE(category, 'NA') || ' (' || COALESCE(category_tetun, 'NA') || ')') AS species
          FROM f_species GROUP BY 1),
topsp AS (
  SELECT CAST(t.rnk AS INTEGER) AS rank, CAST(t.species_code AS INTEGER) AS species_code, l.species,
         t.KG / 1000.0 AS Tonnes
  FROM top9 t LEFT JOIN splab l ON l.species_code = t.species_code)
"""

HEAT = """
hc AS (SELECT latlng, COUNT(*) AS counts FROM s_points WHERE latlng IS NOT NULL GROUP BY latlng),
heat AS (SELECT TRY_CAST(split_part(latlng, ',', 1) AS DOUBLE) AS Lat,
                TRY_CAST(split_part(latlng, ',', 2) AS DOUBLE) AS Lng, counts FROM hc)
"""

DELTA = """
snap AS (SELECT * FROM f_trips WHERE date_numeric <= 10800),
mark AS (SELECT MAX(date_numeric) AS m FROM snap)
"""


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


BASE = (FIX, REFRESHED, CLEAN)

SQL: dict[str, str] = {
    "scan_snapshot": w(FIX) + "SELECT * FROM f_landings",
    "scan_dimension": w(FIX) + "SELECT * FROM f_municipalities",
    "delta_parent": w(FIX, DELTA) + "SELECT * FROM f_trips WHERE date_numeric > (SELECT m FROM mark)",
    "delta_child": w(FIX, DELTA) + """SELECT * FROM f_landings WHERE trip_id IN
        (SELECT trip_id FROM f_trips WHERE date_numeric > (SELECT m FROM mark))""",
    "refresh_union": w(FIX, DELTA) + """SELECT DISTINCT * FROM (
        SELECT * FROM f_landings WHERE trip_id IN (SELECT trip_id FROM snap)
        UNION ALL
        SELECT * FROM f_landings WHERE trip_id IN
          (SELECT trip_id FROM f_trips WHERE date_numeric > (SELECT m FROM mark) - 30))""",
    "parse_date": w(*BASE) + "SELECT trip_id, date FROM prep",
    "recode_habitat": w(*BASE) + "SELECT trip_id, habitat_code FROM prep",
    "clamp_effort": w(*BASE) + "SELECT trip_id, trip_hours, trip_effort FROM prep",
    "patch_imei": w(*BASE) + "SELECT trip_id, IMEI FROM prep",
    "station_lookup": w(*BASE) + "SELECT trip_id, municipality_code FROM prep",
    "trip_catch": w(*BASE) + """SELECT t.trip_id, COALESCE(k.KG, 0.0) AS KG FROM r_trips t
        LEFT JOIN (SELECT trip_id, CAST(SUM(CAST(weight_g AS DECIMAL(28,9))) AS DOUBLE) / 1000.0 AS KG FROM r_landings GROUP BY 1) k
        ON k.trip_id = t.trip_id""",
    "landing_dates": w(*BASE) + "SELECT l.*, p.date FROM r_landings l JOIN prep p ON p.trip_id = l.trip_id",
    "month_floor": w(*BASE) + "SELECT trip_id, CAST(date_trunc('month', date) AS DATE) AS month FROM prep",
    "default_window": w(*BASE) + """SELECT as_of,
        CAST(date_trunc('month', as_of - INTERVAL 1 YEAR) AS DATE) AS start,
        CAST(date_trunc('month', as_of) - INTERVAL 1 DAY AS DATE) AS "end"
        FROM (SELECT DISTINCT date AS as_of FROM prep WHERE date IS NOT NULL)""",
    "clean_trips": w(*BASE) + "SELECT * FROM c_trips",
    "pds_clean": w(*BASE) + "SELECT * FROM c_pds",
    "slice_trips": w(*BASE, MAIN) + "SELECT * FROM s_trips",
    "slice_landings": w(*BASE, MAIN) + "SELECT * FROM s_landings",
    "slice_pds": w(*BASE, MAIN) + "SELECT * FROM s_pds",
    "guard_empty": w(*BASE, NO_BOATS) + "SELECT * FROM s_trips WHERE FALSE",
    "guard_min_rows": w(*BASE, FEW_DAYS, MONTHLY) +
        "SELECT month, KG, trip_effort, CPUE, trips, fishing_days FROM monthly",
    "cutoff": w(*BASE) + """SELECT * FROM c_landings WHERE trip_id IN
        (SELECT trip_id FROM c_trips WHERE date < DATE '1998-01-01')""",
    "species_catch": w(*BASE, MAIN) +
        "SELECT species_code, CAST(SUM(CAST(weight_g AS DECIMAL(28,9))) AS DOUBLE) / 1000.0 AS KG FROM s_landings GROUP BY 1",
    "top_species": w(*BASE, MAIN, TOP) + "SELECT * FROM topsp",
    "species_share": w(*BASE, MAIN, TOP) +
        "SELECT *, Tonnes / SUM(Tonnes) OVER () AS share FROM topsp",
    "monthly_cpue": w(*BASE, MAIN, MONTHLY) +
        "SELECT month, KG, trip_effort, CPUE, trips, fishing_days FROM monthly",
    "boat_cpue": w(*BASE, MAIN, MONTHLY) +
        "SELECT month, CPUE_canoe, CPUE_motor, trips_canoe, trips_motor FROM monthly",
    "fleet_size": w(*BASE, MAIN, MONTHLY) + "SELECT canoes, motors FROM fleet",
    "national_catch": w(*BASE, MAIN, MONTHLY, nat_sql(True)) + "SELECT month, natcatch FROM national",
    "monthly_summary": w(*BASE, MAIN, summary_sql(True)) + "SELECT * FROM summary",
    "monthly_summary_partial": w(*BASE, PARTIAL, summary_sql(False)) + "SELECT * FROM summary",
    "summary_table": w(*BASE, MAIN, summary_sql(True)) + table_sql(True),
    "summary_table_partial": w(*BASE, PARTIAL, summary_sql(False)) + table_sql(False),
    "monthly_chart": w(*BASE, MAIN, summary_sql(True)) + """SELECT month, KG / 1000.0 AS Tonnes,
        trip_effort, CPUE, CAST(month + INTERVAL 3 DAY AS DATE) AS tick,
        strftime(month, '%b-%Y') AS tick_label, (SELECT MAX(CPUE) FROM summary) * 1.5 AS ylim
        FROM summary""",
    "daily_cpue_site": w(*BASE, MAIN, daily_sql("municipality_code", SITES, 5)) + "SELECT * FROM daily",
    "daily_cpue_habitat": w(*BASE, MAIN, daily_sql("habitat_code", HAB_LABELS, 5)) + "SELECT * FROM daily",
    "daily_cpue_gear": w(*BASE, MAIN, daily_sql("gear_code", GEAR_LABELS, 5)) + "SELECT * FROM daily",
    "daily_cpue_site_sparse": w(*BASE, MAIN, daily_sql("municipality_code", SITES, 215)) + "SELECT * FROM daily",
    "daily_cpue_gear_sparse": w(*BASE, MAIN, daily_sql("gear_code", GEAR_LABELS, 220)) + "SELECT * FROM daily",
    "log_axis": w(*BASE, MAIN, daily_sql("municipality_code", SITES, 5)) +
        "SELECT *, log10(fit + 1) AS y FROM daily",
    "mark_selected": w(*BASE, MAIN) + f"""SELECT id, long, lat, "group",
        CASE WHEN id IN ({SEL_SITES}) THEN 'cornflowerblue' ELSE colr END AS colr
        FROM f_shape WHERE (SELECT ok FROM guard)""",
    "heat_cells": w(*BASE, MAIN, HEAT) + "SELECT * FROM heat",
    "heat_boxes": w(*BASE, MAIN, HEAT) + """SELECT Lat, Lng, counts, Lng - 0.002 AS lng1,
        Lat - 0.002 AS lat1, Lng + 0.002 AS lng2, Lat + 0.002 AS lat2 FROM heat""",
    "heat_classes": w(*BASE, MAIN, HEAT) + """, iv AS (
          SELECT *, round_even(ln(counts) + 1, 0) AS intensity FROM heat),
        tp AS (SELECT MAX(intensity) AS top, MAX(intensity) / 7.0 AS c,
                      pow(10, floor(log10(MAX(intensity) / 7.0))) AS b FROM iv),
        un AS (SELECT top, CASE
            WHEN 2*b - c < 1.5*(c - b) AND 5*b - c < 2.75*(c - 2*b) AND 10*b - c < 1.5*(c - 5*b) THEN 10*b
            WHEN 2*b - c < 1.5*(c - b) AND 5*b - c < 2.75*(c - 2*b) THEN 5*b
            WHEN 2*b - c < 1.5*(c - b) THEN 2*b ELSE b END AS step FROM tp)
        SELECT Lat, Lng, counts, intensity,
               CAST(LEAST(floor(intensity / step) + 1, ceil(top / step - 1e-10)) AS INTEGER) AS class,
               CAST(ceil(top / step - 1e-10) AS INTEGER) AS n_classes, step
        FROM iv, un""",
    "nearest_donor": w(FIX) + """, don AS (SELECT * FROM f_sig WHERE (('0x' || substr(md5(CAST(trip_id AS VARCHAR) || '-' || CAST(0 AS VARCHAR)), 1, 8))::BIGINT % 10) < 8),
        qry AS (SELECT * FROM f_sig WHERE NOT ((('0x' || substr(md5(CAST(trip_id AS VARCHAR) || '-' || CAST(0 AS VARCHAR)), 1, 8))::BIGINT % 10) < 8)),
        pairs AS (SELECT q.trip_id, d.trip_id AS donor_tripid, list_distance(q.features, d.features) AS dist,
                         d.gear_code, d.habitat_code FROM qry q, don d),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY dist, donor_tripid) AS rn
                                FROM pairs WHERE dist <= 0.5) WHERE rn = 1)
        SELECT q.trip_id, b.donor_tripid, b.dist AS donor_distance, b.gear_code, b.habitat_code
        FROM qry q LEFT JOIN best b ON b.trip_id = q.trip_id""",
    "donor_fill": w(FIX) + """, tr AS (
          SELECT vec_id AS PDS_trip, CASE WHEN vec_id % 5 <> 0 THEN vec_id END AS trip_id,
                 CASE WHEN vec_id % 5 <> 0 THEN label END AS gear_code,
                 CASE WHEN vec_id % 5 <> 0 THEN label % 3 END AS habitat_code,
                 CAST(embedding[1:20] AS DOUBLE[]) AS f FROM embeddings),
        pairs AS (SELECT q.PDS_trip, d.trip_id AS donor, list_distance(q.f, d.f) AS dist,
                         d.gear_code AS g, d.habitat_code AS h
                  FROM tr q, tr d WHERE q.trip_id IS NULL AND d.trip_id IS NOT NULL),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PDS_trip ORDER BY dist, donor) AS rn
                                FROM pairs WHERE dist <= 0.5) WHERE rn = 1)
        SELECT t.PDS_trip, t.trip_id, COALESCE(b.g, t.gear_code) AS gear_code,
               COALESCE(b.h, t.habitat_code) AS habitat_code, b.donor AS donor_tripid,
               b.dist AS donor_distance
        FROM tr t LEFT JOIN best b ON b.PDS_trip = t.PDS_trip""",
    "check_pk": w(FIX, DELTA) + """SELECT trip_id, COUNT(*) AS n FROM (
        SELECT * FROM snap UNION ALL
        SELECT * FROM f_trips WHERE date_numeric > (SELECT m FROM mark) - 30)
        GROUP BY trip_id HAVING COUNT(*) > 1 OR trip_id IS NULL""",
    "check_fk": w(*BASE) + """SELECT * FROM r_trips WHERE station_code IS NOT NULL
        AND station_code NOT IN (SELECT station_code FROM f_stations)""",
    "cascade_delete": w(*BASE) + """SELECT * FROM r_landings WHERE trip_id NOT IN
        (SELECT trip_id FROM r_trips WHERE trip_effort IS NULL)""",
}

SQL["write_snapshot"] = SQL["scan_snapshot"]
SQL["backup"] = w(FIX) + """SELECT t.trip_id, s.station_name FROM f_trips t
    JOIN f_stations s ON s.station_code = t.station_code"""
SQL["export_csv"] = w(*BASE, MAIN, summary_sql(True)) + """SELECT strftime(month, '%b-%Y') AS Month,
    CAST(trips AS DOUBLE) AS trips, KG, natcatch FROM summary"""
SQL["clip_low"] = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS fit FROM customer"
SQL["clean_stored"] = w(*BASE) + """SELECT l.trip_id, l.species_code, l.weight_g, l.food_sale, l.note,
    p.municipality_code AS trip_municipality FROM c_landings l LEFT JOIN prep p ON p.trip_id = l.trip_id"""
SQL["monthly_summary_stored"] = SQL["monthly_summary"]
SQL["summary_table_headed"] = "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in (
    ("Month", "Month"), ("fishing_days", "Reported fishing days"), ("trips", "Reported trips"),
    ("trip_effort", "Reported effort (hours)"), ("KG", "Reported catch (KG)"), ("CPUE", "CPUE (KG/hour)"),
    ("natcatch", "Estimated national catch (T)"))) + " FROM (" + SQL["summary_table"] + ") x"
SQL["summary_one_boat"] = " UNION ALL ".join(
    "SELECT * FROM (" + w(*BASE, s, summary_sql(True)) + f"SELECT month, trips, KG, natcatch, '{b}' AS boat FROM summary)"
    for s, b in ((CANOES, "canoe"), (MOTORS, "motor")))
SQL["fleet_one_boat"] = w(*BASE, CANOES, MONTHLY) + "SELECT canoes, motors FROM fleet"
DAILIES = [("site", "municipality_code", SITES), ("habitat", "habitat_code", HAB_LABELS), ("gear", "gear_code", GEAR_LABELS)]
SQL["dashboard_bundle"] = " UNION ALL ".join(
    [f"SELECT '{n}' AS result, COUNT(*) AS rows FROM ({SQL[q]}) x" for n, q in (
        ("monthly", "monthly_summary"), ("table", "summary_table"), ("chart", "monthly_chart"),
        ("site", "daily_cpue_site"), ("habitat", "daily_cpue_habitat"), ("gear", "daily_cpue_gear"),
        ("species", "top_species"), ("heat", "heat_cells"))])
SQL["smooth_moments"] = w(*BASE, MAIN, daily_sql("municipality_code", SITES, 5)) + """SELECT code, COUNT(*) AS days,
    SUM(trip_effort * CPUE) / CAST(SUM(CAST(trip_effort AS DECIMAL(28,9))) AS DOUBLE) AS mean_fit,
    SUM(trip_effort * DATEDIFF('day', DATE '1996-12-31', date) * CPUE)
      / SUM(trip_effort * DATEDIFF('day', DATE '1996-12-31', date)) AS slope_fit
    FROM daily WHERE CPUE IS NOT NULL AND trip_effort > 0 GROUP BY code"""

# The smoothed series: a penalised cubic B-spline per series, solved as a banded system. Splines
# are built from the order below, value by value; the system's factors L D L' and the solution
# follow row by row. Nothing of it is shared with the fit that the queries run.


def spline_step(name: str, source: str, order: int) -> str:
    """B-splines of ``order`` at the points of ``source``, which has those of the order below."""
    return f"""{name} AS MATERIALIZED (SELECT s.code, s.pid, s.x, s.j - o AS j,
    SUM(v * CASE o WHEN 0 THEN (s.x - a.t) ELSE (b.t - s.x) END / (b.t - a.t)) AS v
  FROM {source} s JOIN kn a ON a.code = s.code AND a.k = s.j JOIN kn b ON b.code = s.code AND b.k = s.j + {order - 1}, range(2) r(o)
  GROUP BY s.code, s.pid, s.x, s.j - o)"""


def slope_step(name: str, source: str, order: int) -> str:
    """Derivatives of B-splines of ``order`` from values (or derivatives) of the order below."""
    return f"""{name} AS MATERIALIZED (SELECT s.code, s.pid, s.j - o AS j, SUM(v * (1 - 2 * o) * {order - 1} / (b.t - a.t)) AS v
  FROM {source} s JOIN kn a ON a.code = s.code AND a.k = s.j JOIN kn b ON b.code = s.code AND b.k = s.j + {order - 1}, range(2) r(o)
  GROUP BY s.code, s.pid, s.j - o)"""


SMOOTH_POINTS = """
us AS MATERIALIZED (SELECT code, date, CPUE AS y, trip_effort AS w0, DATEDIFF('day', DATE '1970-01-01', date) AS day,
         row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS i
       FROM daily WHERE CPUE IS NOT NULL AND trip_effort >= 0),
sz AS MATERIALIZED (SELECT code, COUNT(*) AS n, MIN(day) AS lo, MAX(day) AS hi, COUNT(CASE WHEN w0 > 0 THEN 1 END) / SUM(w0) AS scale FROM us GROUP BY code
       HAVING COUNT(*) >= 4 AND SUM(w0) > 0),
xs AS MATERIALIZED (SELECT us.code, i, date, y, w0 * scale AS w, (day - lo) / CAST(hi - lo AS DOUBLE) AS x, n FROM us JOIN sz ON sz.code = us.code)"""


# Solves the systems of ``mat`` (row r, its diagonal e0 and the values e1 to e3 left of it, right
# side b): factors downwards, solution c1 of each row upwards.
BANDED = """fw AS (
  SELECT code, CAST(-1 AS BIGINT) AS r, 1.0::DOUBLE AS p1, 1.0::DOUBLE AS p2, 1.0::DOUBLE AS p3, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, 0.0::DOUBLE AS z3,
         0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS l3, 0.0::DOUBLE AS l1_before FROM nk
  UNION ALL
  SELECT code, r, e0 - m1 * m1 * p1 - m2 * m2 * p2 - m3 * m3 * p3, p1, p2, b - m1 * z1 - m2 * z2 - m3 * z3, z1, z2, m1, m2, m3, l1
  FROM (SELECT *, (e1 - m3 * p3 * l2 - m2 * p2 * l1) / p1 AS m1
        FROM (SELECT *, (e2 - m3 * p3 * l1_before) / p2 AS m2
              FROM (SELECT fw.code, mat.r, e0, e1, e2, b, p1, p2, p3, z1, z2, z3, l1, l2, l1_before, e3 / p3 AS m3
                    FROM fw JOIN mat ON mat.code = fw.code AND mat.r = fw.r + 1) x) y) z),
ld AS MATERIALIZED (SELECT code, r, z1 / p1 AS q, COALESCE(lead(l1, 1) OVER w, 0) AS u1, COALESCE(lead(l2, 2) OVER w, 0) AS u2, COALESCE(lead(l3, 3) OVER w, 0) AS u3
       FROM fw WHERE r >= 0 WINDOW w AS (PARTITION BY code ORDER BY r)),
bw AS (
  SELECT code, MAX(r) + 1 AS r, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3 FROM mat GROUP BY code
  UNION ALL
  SELECT bw.code, ld.r, q - u1 * c1 - u2 * c2 - u3 * c3, c1, c2 FROM bw JOIN ld ON ld.code = bw.code AND ld.r = bw.r - 1),"""


def smoothed(daily: str, spar: float = 0.5) -> str:
    """The series of a ``daily`` part with their fit; series of fewer than 4 points as they are."""
    ramp = lambda a, b, lo, hi: f"2 ** (log2({a}) + (log2({b}) - log2({a})) * (n - {lo}) / {float(hi - lo)})"
    return daily + "," + SMOOTH_POINTS + f""",
nk AS MATERIALIZED (SELECT code, n, CAST(CASE WHEN n < 50 THEN n WHEN n < 200 THEN trunc({ramp(50, 100, 50, 200)})
         WHEN n < 800 THEN trunc({ramp(100, 140, 200, 800)}) WHEN n < 3200 THEN trunc({ramp(140, 200, 800, 3200)})
         ELSE trunc(200 + (n - 3200) ** 0.2) END AS BIGINT) AS k FROM sz),
kn AS MATERIALIZED (SELECT nk.code, r.k, xs.x AS t FROM nk, range(0, 400) r(k), xs
       WHERE r.k < nk.k + 6 AND xs.code = nk.code
         AND xs.i = CAST(floor(1 + (nk.n - 1) * least(greatest(r.k - 3, 0), nk.k - 1) / CAST(nk.k - 1 AS DOUBLE)) AS BIGINT) - 1),
iv AS MATERIALIZED (SELECT a.code, a.k AS j, a.t AS lo, b.t - a.t AS h FROM kn a JOIN kn b ON b.code = a.code AND b.k = a.k + 1 WHERE b.t > a.t),
spt AS MATERIALIZED (SELECT code, i AS pid, x FROM xs
       UNION ALL SELECT code, 100000 + 2 * j + g, lo + h / 2 + (2 * g - 1) * h / (2 * sqrt(3)) FROM iv, range(2) q(g)),
b1 AS MATERIALIZED (SELECT spt.code, pid, spt.x, MAX(j) AS j, 1.0::DOUBLE AS v FROM spt JOIN iv ON iv.code = spt.code AND iv.lo <= spt.x GROUP BY spt.code, pid, spt.x),
{spline_step('b2', 'b1', 2)}, {spline_step('b3', '(SELECT * FROM b2 WHERE pid < 100000)', 3)}, {spline_step('b4', 'b3', 4)},
{slope_step('d1', '(SELECT * FROM b2 WHERE pid >= 100000)', 3)}, {slope_step('d2', 'd1', 4)},
gram AS (SELECT a.code, a.j, b.j - a.j AS d, SUM(w * a.v * b.v) AS v FROM b4 a JOIN b4 b ON b.code = a.code AND b.pid = a.pid AND b.j >= a.j
         JOIN xs ON xs.code = a.code AND xs.i = a.pid GROUP BY a.code, a.j, b.j - a.j),
rough AS (SELECT a.code, a.j, b.j - a.j AS d, SUM(h / 2 * a.v * b.v) AS v FROM d2 a JOIN d2 b ON b.code = a.code AND b.pid = a.pid AND b.j >= a.j
          JOIN iv ON iv.code = a.code AND iv.j = (a.pid - 100000) // 2 GROUP BY a.code, a.j, b.j - a.j),
inner_rows AS (SELECT code, j FROM nk, range(2, 400) r(j) WHERE j < k - 1),
lam AS MATERIALIZED (SELECT g.code, SUM(g.v) / SUM(o.v) * 256.0 ** (3 * {spar} - 1) AS lam FROM inner_rows n JOIN gram g ON g.code = n.code AND g.j = n.j AND g.d = 0
        JOIN rough o ON o.code = n.code AND o.j = n.j AND o.d = 0 GROUP BY g.code),
bnd AS MATERIALIZED (SELECT code, j + d AS r, d, SUM(v) AS v FROM (SELECT * FROM gram UNION ALL
         SELECT o.code, j, d, lam * v FROM rough o JOIN lam ON lam.code = o.code) x GROUP BY code, j + d, d),
mat AS MATERIALIZED (SELECT bnd.code, r, SUM(CASE d WHEN 0 THEN v ELSE 0 END) AS e0, SUM(CASE d WHEN 1 THEN v ELSE 0 END) AS e1,
         SUM(CASE d WHEN 2 THEN v ELSE 0 END) AS e2, SUM(CASE d WHEN 3 THEN v ELSE 0 END) AS e3, ANY_VALUE(b.b) AS b
       FROM bnd JOIN (SELECT b4.code, j, SUM(w * y * v) AS b FROM b4 JOIN xs ON xs.code = b4.code AND xs.i = pid GROUP BY b4.code, j) b
         ON b.code = bnd.code AND b.j = r GROUP BY bnd.code, r),
{BANDED}
sf AS (SELECT b4.code, pid, SUM(c1 * v) AS fit FROM b4 JOIN bw ON bw.code = b4.code AND bw.r = b4.j GROUP BY b4.code, pid),
smooth AS (SELECT d.* REPLACE (CASE WHEN COALESCE(sf.fit, d.CPUE) < 0 THEN 0.0 ELSE COALESCE(sf.fit, d.CPUE) END AS fit)
           FROM daily d LEFT JOIN us ON us.code = d.code AND us.date = d.date LEFT JOIN sf ON sf.code = us.code AND sf.pid = us.i)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def reinsch(daily: str, spar: float = 0.5) -> str:
    """The same fit for series of 4 to 49 points by another method: with a knot at each point
    it is the natural cubic spline, whose second derivatives at the inner points solve
    (R + lam Q' W^-1 Q) g = Q' y, and the fit is y - lam W^-1 Q g."""
    whole = smoothed(daily, spar)
    return whole[:whole.index("bnd AS MATERIALIZED")] + f"""
hs AS MATERIALIZED (SELECT *, lead(x) OVER o - x AS h, x - lag(x) OVER o AS g, lag(y) OVER o AS ya, lead(y) OVER o AS yz, lag(w) OVER o AS wa, lead(w) OVER o AS wz
       FROM xs WINDOW o AS (PARTITION BY code ORDER BY i)),
qs AS MATERIALIZED (SELECT hs.*, lam, 1 / g AS qa, -1 / g - 1 / h AS q0, 1 / h AS qz FROM hs JOIN lam ON lam.code = hs.code WHERE g IS NOT NULL AND h IS NOT NULL),
mat AS MATERIALIZED (SELECT code, i - 1 AS r, (g + h) / 3 + lam * (qa * qa / wa + q0 * q0 / w + qz * qz / wz) AS e0,
         COALESCE(g / 6 + lam * (lag(q0, 1) OVER o * qa / wa + lag(qz, 1) OVER o * q0 / w), 0) AS e1,
         COALESCE(lam * lag(qz, 2) OVER o * qa / wa, 0) AS e2, 0.0::DOUBLE AS e3, qa * ya + q0 * y + qz * yz AS b
       FROM qs WINDOW o AS (PARTITION BY code ORDER BY i)),
{BANDED}
sol AS (SELECT code, r + 1 AS i, c1 FROM bw),
part AS (SELECT qs.code, qs.i - 1 + k AS i, c1 * CASE k WHEN 0 THEN qa WHEN 1 THEN q0 ELSE qz END AS v
         FROM qs JOIN sol ON sol.code = qs.code AND sol.i = qs.i, range(3) s(k)),
sf AS (SELECT xs.code, xs.i, xs.y - lam / xs.w * SUM(v) AS fit FROM xs JOIN lam ON lam.code = xs.code JOIN part p ON p.code = xs.code AND p.i = xs.i
       GROUP BY xs.code, xs.i, xs.y, lam, xs.w),
smooth AS (SELECT d.* REPLACE (CASE WHEN COALESCE(sf.fit, d.CPUE) < 0 THEN 0.0 ELSE COALESCE(sf.fit, d.CPUE) END AS fit)
           FROM daily d LEFT JOIN us ON us.code = d.code AND us.date = d.date LEFT JOIN sf ON sf.code = us.code AND sf.i = us.i)
"""


SHORT = slice_sql(start="1998-03-01", end="1998-04-10")
SQL["smooth_short"] = recursive(w(*BASE, SHORT, reinsch(daily_sql("municipality_code", SITES, 5))) + "SELECT * FROM smooth")
for _dim, _col, _labels in DAILIES:
    SQL[f"smooth_{_dim}"] = recursive(w(*BASE, MAIN, smoothed(daily_sql(_col, _labels, 5))) + "SELECT * FROM smooth")

# A refresh in which trips of the margin come in a second version.
CHANGED = DELTA + """, src AS (
  SELECT * REPLACE (CASE WHEN trip_id % 7 = 0 THEN trip_effort + 1 ELSE trip_effort END AS trip_effort) FROM f_trips),
dlt AS (SELECT DISTINCT * FROM src WHERE date_numeric > (SELECT m FROM mark) - 30),
x_trips AS (SELECT DISTINCT * FROM snap WHERE trip_id NOT IN (SELECT trip_id FROM dlt) UNION ALL SELECT * FROM dlt),
x_landings AS (SELECT DISTINCT * FROM f_landings WHERE trip_id IN (SELECT trip_id FROM x_trips))
"""
SQL["refresh_changed_trip"] = w(FIX, CHANGED) + "SELECT * FROM x_trips"
SQL["refresh_stored"] = SQL["refresh_changed_trip"]
SQL["monthly_summary_states"] = w(FIX, CHANGED, REFRESHED.replace("FROM f_trips", "FROM x_trips").replace(
    "FROM f_landings", "FROM x_landings"), CLEAN, MAIN, summary_sql(True)) + "SELECT * FROM summary"
SQL["refresh_stored_landings"] = w(FIX, CHANGED) + "SELECT * FROM x_landings"
SQL["clean_changed_landings"] = w(FIX, CHANGED, REFRESHED.replace("FROM f_trips", "FROM x_trips").replace(
    "FROM f_landings", "FROM x_landings"), CLEAN) + "SELECT * FROM c_landings"

DIMENSIONS = """
f_boat_types AS (SELECT CAST(p_partkey AS INTEGER) AS boat_code FROM part WHERE p_partkey BETWEEN 1 AND 2),
f_gear_types AS (SELECT CAST(p_partkey AS INTEGER) AS gear_code FROM part WHERE p_partkey BETWEEN 1 AND 9),
f_habitat_types AS (SELECT CAST(p_partkey AS INTEGER) AS habitat_code FROM part WHERE p_partkey BETWEEN 1 AND 6),
f_flags AS (SELECT CAST(p_partkey AS INTEGER) AS flag_code FROM part WHERE p_partkey IN (0, 4, 5)),
f_rankings AS (SELECT CAST(p_partkey AS INTEGER) AS rank_code FROM part WHERE p_partkey BETWEEN 1 AND 5),
f_boats AS (SELECT c_custkey AS boat_id, CASE WHEN c_custkey % 90 = 0 THEN 7 ELSE 1 + c_custkey % 2 END AS boat_code
            FROM customer, range(2) r(again) WHERE again = 0 OR c_custkey % 50 = 0),
f_vacs AS (SELECT CASE WHEN s_suppkey % 20 <> 0 THEN s_suppkey END AS vac_code, 1 + s_suppkey % 3 AS boat_code FROM supplier),
k_trips AS (SELECT *, CASE WHEN trip_id % 59 <> 0 THEN 1 + trip_id % 6 END AS rank_code,
                   CASE WHEN trip_id % 61 = 0 THEN NULL WHEN trip_id % 30 = 0 THEN 1 ELSE 4 * (trip_id % 2) END AS flag_code FROM r_trips),
k_pds_trips AS (SELECT *, CASE WHEN PDS_trip % 43 <> 0 THEN PDS_trip % 2000 END AS boat_id FROM r_pds_trips)
"""
SQL["cascade_delete_tracks"] = w(*BASE) + """SELECT * FROM r_pds_points WHERE PDS_trip NOT IN (
    SELECT PDS_trip FROM r_pds_trips WHERE
      COALESCE(trip_id IN (SELECT trip_id FROM r_trips WHERE trip_effort IS NULL), FALSE)
      OR COALESCE(donor_tripid IN (SELECT trip_id FROM r_trips WHERE trip_effort IS NULL), FALSE))"""
KEYED = (("trips", "trip_id", "(SELECT * FROM r_trips UNION ALL SELECT * FROM r_trips WHERE trip_id % 1000 = 0)"),
         ("pds_trips", "PDS_trip", "r_pds_trips"), ("municipalities", "municipality_code", "f_municipalities"),
         ("stations", "station_code", "f_stations"), ("species", "species_code", "f_species"),
         ("boat_types", "boat_code", "f_boat_types"), ("gear_types", "gear_code", "f_gear_types"),
         ("habitat_types", "habitat_code", "f_habitat_types"), ("flags", "flag_code", "f_flags"),
         ("boats", "boat_id", "f_boats"), ("rankings", "rank_code", "f_rankings"), ("vacs", "vac_code", "f_vacs"))
SQL["check_pk_all"] = w(*BASE, DIMENSIONS) + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", COUNT(*) AS violations FROM (SELECT {k} FROM {f} x GROUP BY {k}
        HAVING COUNT(*) > 1 OR {k} IS NULL) y""" for t, k, f in KEYED)
REFERS = (("stations", "municipality_code", "municipalities", "municipality_code"),
          ("trips", "boat_code", "boat_types", "boat_code"), ("trips", "gear_code", "gear_types", "gear_code"),
          ("trips", "habitat_code", "habitat_types", "habitat_code"), ("trips", "station_code", "stations", "station_code"),
          ("pds_trips", "boat_code", "boat_types", "boat_code"), ("pds_trips", "gear_code", "gear_types", "gear_code"),
          ("pds_trips", "habitat_code", "habitat_types", "habitat_code"), ("pds_trips", "trip_id", "trips", "trip_id"),
          ("pds_trips", "station_code", "stations", "station_code"), ("pds_trips", "donor_tripid", "trips", "trip_id"),
          ("pds_points", "PDS_trip", "pds_trips", "PDS_trip"), ("landings", "trip_id", "trips", "trip_id"),
          ("landings", "species_code", "species", "species_code"), ("landings", "flag_code", "flags", "flag_code"),
          ("boats", "boat_code", "boat_types", "boat_code"), ("vacs", "boat_code", "boat_types", "boat_code"),
          ("trips", "flag_code", "flags", "flag_code"), ("trips", "rank_code", "rankings", "rank_code"),
          ("pds_trips", "boat_id", "boats", "boat_id"))
_VIEW = {t: f"r_{t}" if t in ("landings", "pds_points") else f"k_{t}" if t in ("trips", "pds_trips") else f"f_{t}"
         for r in REFERS for t in (r[0], r[2])}
SQL["check_fk_all"] = w(*BASE, DIMENSIONS) + " UNION ALL ".join(
    f"""SELECT '{c}' AS child, '{ck}' AS "column", '{p}' AS parent, COUNT(*) AS orphans FROM {_VIEW[c]} x
        WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {_VIEW[p]})""" for c, ck, p, pk in REFERS)

NEWER = DELTA + ", newer AS (SELECT * FROM f_trips WHERE date_numeric > (SELECT m FROM mark) - 30)"
SQL["check_pk_delta"] = w(FIX, NEWER) + """SELECT trip_id, COUNT(*) AS n FROM (
    SELECT * FROM newer UNION ALL SELECT * FROM newer WHERE trip_id % 100 = 0
    UNION ALL SELECT * FROM snap WHERE trip_id IN (SELECT trip_id FROM newer)) x GROUP BY trip_id HAVING COUNT(*) > 1 OR trip_id IS NULL"""
SQL["check_fk_delta"] = w(FIX, NEWER) + """SELECT trip_id, species_code, 'species' AS parent FROM f_landings
    WHERE trip_id % 3 = 0 AND trip_id IN (SELECT trip_id FROM newer) AND species_code IS NOT NULL
      AND species_code NOT IN (SELECT species_code FROM f_species WHERE species_code % 17 <> 0)
    UNION ALL SELECT trip_id, species_code, 'trips' FROM f_landings
    WHERE trip_id % 3 = 0 AND trip_id NOT IN (SELECT trip_id FROM newer)"""

VALIDATE = w(FIX) + """, rr AS (SELECT s.*, r.rep FROM f_sig s, range(100) r(rep)),
    tr AS (SELECT * FROM rr WHERE (('0x' || substr(md5(CAST(trip_id AS VARCHAR) || '-' || CAST(rep AS VARCHAR)), 1, 8))::BIGINT % 10) < 8),
    qu AS (SELECT * FROM rr WHERE NOT ((('0x' || substr(md5(CAST(trip_id AS VARCHAR) || '-' || CAST(rep AS VARCHAR)), 1, 8))::BIGINT % 10) < 8)),
    pairs AS (SELECT q.rep, q.trip_id, q.gear_code AS qg, q.habitat_code AS qh, d.trip_id AS did,
                     d.gear_code AS dg, d.habitat_code AS dh, list_distance(q.features, d.features) AS dist
              FROM qu q JOIN tr d ON q.rep = d.rep),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, trip_id ORDER BY dist, did) AS rn
                            FROM pairs) WHERE rn = 1),
    kept AS (SELECT * FROM best b WHERE dist <= 0.5
             AND qh IN (SELECT habitat_code FROM tr WHERE tr.rep = b.rep)
             AND qg IN (SELECT gear_code FROM tr WHERE tr.rep = b.rep)),
    per AS (SELECT CAST(rep AS INTEGER) AS rep, COUNT(*) AS kept, AVG(CASE WHEN qg = dg THEN 1.0 ELSE 0.0 END) AS gear_acc,
                   AVG(CASE WHEN qh = dh THEN 1.0 ELSE 0.0 END) AS habitat_acc FROM kept GROUP BY rep)
"""
SQL["validate_donor_reps"] = VALIDATE + "SELECT * FROM per"
SQL["validate_donor"] = VALIDATE + """SELECT COUNT(*) AS reps, AVG(gear_acc) AS gear_mean,
    stddev_samp(gear_acc) AS gear_sd, AVG(habitat_acc) AS habitat_mean,
    stddev_samp(habitat_acc) AS habitat_sd FROM per"""
