"""Every registered query against its DuckDB SQL on sf0.001 (same rules as the
driver's check: column names, row count, order-insensitive values rounded to
6 places)."""

import datetime
import decimal
import math

import duckdb
import pytest

from landfall.catalog import QUERIES
from landfall.oracle import SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


DUCK_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
              "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(SQL[name])
    assert {f.name: DUCK_TYPES.get(repr(f.dataType)) for f in df.schema} == \
        {c: str(t) for c, t in zip(rel.columns, rel.types)}
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, df.collect()) == _rows(ocols, cur.fetchall())


def test_every_query_but_the_spline_has_an_oracle():
    assert set(QUERIES) - set(SQL) == {"smooth_site", "smooth_habitat", "smooth_gear"}
