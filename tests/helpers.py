import datetime as dt

from landfall import schema


def trips_df(spark, rows):
    """rows: dicts with any of the trips columns; missing ones are NULL."""
    cols = [f.name for f in schema.TRIPS]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema.TRIPS)


def landings_df(spark, rows):
    cols = [f.name for f in schema.LANDINGS]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema.LANDINGS)


def trip(i, date="2019-03-10", station=1, habitat=1, boat=1, gear=1, hours=5, effort=10.0,
         imei="1", dnum=17900.0):
    return dict(trip_id=i, date=date, station_code=station, habitat_code=habitat,
                boat_code=boat, gear_code=gear, trip_hours=hours, trip_effort=effort,
                IMEI=imei, date_numeric=dnum)


def landing(i, species=1, length=10.0, nfish=1, weight=1000.0, flag=0):
    return dict(trip_id=i, species_code=species, length=length, nfish=nfish, weight_g=weight,
                flag_code=flag)


def d(s):
    return dt.date.fromisoformat(s)
