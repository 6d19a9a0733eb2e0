"""Declared schemas of the fishery tables (never inferred).

Codes are ``int``; ids are ``bigint`` so that a large archive never overflows;
``date`` is kept as text at the source, like the original database, and parsed
by :func:`landfall.functions.columns.parse_date`.
"""

from __future__ import annotations

from pyspark.sql import types as T

I, L, D, S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Whole tables, in the order of the original data model: a table without a key is
# deduplicated on whole rows, so a missing column would merge different rows.
TRIPS = _struct(
    ("trip_id", L), ("date", S), ("station_code", I), ("habitat_code", I),
    ("boat_code", I), ("has_PDS", I), ("IMEI", S), ("boat_id", I), ("boat_reg_no", S),
    ("owner", S), ("gear_code", I), ("mesh", D), ("trip_hours", I), ("men", I),
    ("women", I), ("children", I), ("rel_effort", I), ("trip_effort", D),
    ("catch_value", D), ("rank_code", I), ("all_boats", I), ("all_gleaners", I),
    ("flag_code", I), ("note", S), ("date_numeric", D),
)
LANDINGS = _struct(
    ("trip_id", L), ("species_code", I), ("length", D), ("nfish", I),
    ("weight_g", D), ("food_sale", S), ("flag_code", I), ("note", S),
)
PDS_TRIPS = _struct(
    ("PDS_trip", L), ("date", S), ("boat_id", I), ("date_numeric", D), ("IMEI", S),
    ("boat_code", I), ("station_code", I), ("trip_id", L), ("gear_code", I),
    ("habitat_code", I), ("donor_tripid", L), ("donor_distance", D),
    *[(f"lat{i}", D) for i in range(1, 11)], *[(f"lng{i}", D) for i in range(1, 11)],
)
PDS_POINTS = _struct(("PDS_trip", L), ("latlng", S))
MUNICIPALITIES = _struct(
    ("municipality_code", I), ("municipality_name", S), ("fishers", I), ("canoes", I),
    ("motors", I), ("total_PDS_units", I), ("notes", S),
)
STATIONS = _struct(("station_code", I), ("station_name", S), ("municipality_code", I),
                   ("municipality_name", S), ("responsibility", S))
SPECIES = _struct(
    ("species_code", I), ("fishbase", S), ("category", S), ("category_tetun", S),
    ("family", S), ("a", D), ("b", D), ("minlength", I), ("maxlength", I),
    ("nstudies", I), ("maxweight", D),
)
SHAPE = _struct(("id", S), ("long", D), ("lat", D), ("group", S), ("colr", S))
BOAT_TYPES = _struct(("boat_code", I), ("boat_description", S))
BOATS = _struct(
    ("boat_id", I), ("boat_name", S), ("IMEI", S), ("owner", S), ("boat_description", S),
    ("boat_code", I), ("length_m", D), ("motor_type", S), ("motor_make", S), ("motor_HP", D),
    ("VTS_location", S), ("VTS_covered_when_parked", S), ("municipality_name", S),
    ("community", S), ("installation_date", S), ("primary_gear", S), ("secondary_gear", S),
    ("network_provider", S), ("boat_reg_no", S), ("notes", S),
)
GEAR_TYPES = _struct(("gear_code", I), ("gear", S), ("gear_name", S))
HABITAT_TYPES = _struct(("habitat_code", I), ("English", S), ("Tetun", S))
FLAGS = _struct(("flag_code", I), ("reason", S))
RANKINGS = _struct(("rank_code", I), ("rank_description", S))
VACS = _struct(("vac_code", I), ("boat_code", I), ("VAC", D))

SCHEMAS: dict[str, T.StructType] = {
    "trips": TRIPS,
    "landings": LANDINGS,
    "pds_trips": PDS_TRIPS,
    "pds_points": PDS_POINTS,
    "municipalities": MUNICIPALITIES,
    "stations": STATIONS,
    "species": SPECIES,
    "shape": SHAPE,
    "boat_types": BOAT_TYPES,
    "boats": BOATS,
    "gear_types": GEAR_TYPES,
    "habitat_types": HABITAT_TYPES,
    "flags": FLAGS,
    "rankings": RANKINGS,
    "vacs": VACS,
}

# Primary keys (None: the table has no key) and foreign keys of the data model.
PRIMARY_KEYS: dict[str, tuple[str, ...] | None] = {
    "trips": ("trip_id",),
    "landings": None,
    "pds_trips": ("PDS_trip",),
    "pds_points": None,
    "municipalities": ("municipality_code",),
    "stations": ("station_code",),
    "species": ("species_code",),
    "boat_types": ("boat_code",),
    "boats": ("boat_id",),
    "gear_types": ("gear_code",),
    "habitat_types": ("habitat_code",),
    "flags": ("flag_code",),
    "rankings": ("rank_code",),
    "vacs": ("vac_code",),
}
# (child table, child column, parent table, parent column); deletes cascade.
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("boats", "boat_code", "boat_types", "boat_code"),
    ("stations", "municipality_code", "municipalities", "municipality_code"),
    ("trips", "boat_code", "boat_types", "boat_code"),
    ("trips", "flag_code", "flags", "flag_code"),
    ("trips", "gear_code", "gear_types", "gear_code"),
    ("trips", "habitat_code", "habitat_types", "habitat_code"),
    ("trips", "station_code", "stations", "station_code"),
    ("trips", "rank_code", "rankings", "rank_code"),
    ("pds_trips", "boat_code", "boat_types", "boat_code"),
    ("pds_trips", "boat_id", "boats", "boat_id"),
    ("pds_trips", "gear_code", "gear_types", "gear_code"),
    ("pds_trips", "habitat_code", "habitat_types", "habitat_code"),
    ("pds_trips", "trip_id", "trips", "trip_id"),
    ("pds_trips", "station_code", "stations", "station_code"),
    ("pds_trips", "donor_tripid", "trips", "trip_id"),
    ("pds_points", "PDS_trip", "pds_trips", "PDS_trip"),
    ("vacs", "boat_code", "boat_types", "boat_code"),
    ("landings", "trip_id", "trips", "trip_id"),
    ("landings", "species_code", "species", "species_code"),
    ("landings", "flag_code", "flags", "flag_code"),
)
