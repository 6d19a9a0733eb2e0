"""Sources and sinks: snapshot scans, dimension-table reads, snapshot write-back,
dated backups and the CSV export of the monthly summary."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landfall.functions.columns import nan_to_null
from landfall.schema import SCHEMAS

# Display headings of the monthly summary, in column order (must match).
HEADINGS = (
    "Month", "Reported fishing days", "Reported trips", "Reported effort (hours)",
    "Reported catch (KG)", "CPUE (KG/hour)", "Estimated national catch (T)",
)
SUMMARY_COLUMNS = ("month", "fishing_days", "trips", "trip_effort", "KG", "CPUE", "natcatch")


def jdbc_source(url: str, table: str, options: dict | None = None, split: str | None = None) -> dict:
    """The ``source`` of :func:`read_table` for a database table. Filters on its
    columns (the high-water mark) are pushed into the database's query. ``split`` names
    a number or date column by whose ranges the table is read in many tasks."""
    by = {"split": split} if split else {}
    return {"format": "jdbc", "url": url, "dbtable": table, "pushDownPredicate": "true", **by, **(options or {})}


def bounds_query(source: dict) -> dict:
    """The one-row source that gives the range and the rows of a source's split column."""
    column = source["split"]
    rest = {k: v for k, v in source.items() if k not in ("split", "split_rows", "dbtable")}
    return {**rest, "dbtable": f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n "
                               f"FROM {source['dbtable']}) bounds"}


def split_options(source: dict, lo, hi, n: int) -> dict:
    """A source read by ranges of its split column: one task for about ``split_rows`` rows
    (100,000 unless given). Ranges only deal the rows out; none is filtered, NULL goes
    to the first. A table without values of the column is read in one task."""
    src = dict(source)
    column, rows = src.pop("split"), int(src.pop("split_rows", 100_000))
    parts = max(1, -(-int(n) // rows))
    if lo is None or parts == 1:
        return src
    text = lambda v, up: str(v) if isinstance(v, (dt.date, dt.datetime)) else str(math.ceil(v) if up else math.floor(v))
    return {**src, "partitionColumn": column, "lowerBound": text(lo, False), "upperBound": text(hi, True),
            "numPartitions": str(parts)}


def read_snapshot(spark: SparkSession, base: str, table: str,
                  schema: T.StructType | None = None, raw: bool = False) -> DataFrame:
    """Scan a snapshot table ``{base}/{table}`` with its declared schema.

    The schema is given, never inferred, so a scan reads only the declared
    columns and later projections prune further at the Parquet reader. ``raw`` leaves
    NaN in place, so that filters on doubles reach the files (see refresh/delta.py).
    """
    schema = schema or SCHEMAS[table]
    path = base if base.endswith(".parquet") else f"{base.rstrip('/')}/{table}"
    df = spark.read.schema(schema).parquet(path)
    return df if raw else nan_to_null(df)


def read_table(spark: SparkSession, source: dict, schema: T.StructType | None = None,
               raw: bool = False) -> DataFrame:
    """Whole-table read of a dimension table.

    ``source`` is ``{"format": "parquet", "path": ...}`` or
    ``{"format": "jdbc", "url": ..., "dbtable": ..., **options}``; credentials are
    the caller's (passed as options), never read from a file here. A database source
    with a ``split`` column is read by as many tasks as its rows ask for, whose ranges come
    from a min/max query; ``raw`` leaves NaN in place.
    """
    src = dict(source)
    fmt = src.pop("format", "parquet")
    clean = (lambda df: df) if raw else nan_to_null
    if fmt == "jdbc":
        if "split" in src:
            src = split_options(src, *spark.read.format("jdbc").options(**bounds_query(src)).load().first())
        df = spark.read.format("jdbc").options(**src).load()
        # columns of the declared type stay bare, so that filters on them are pushed down
        cols = [F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
                for f in schema or ()]
        return clean(df.select(*cols) if schema else df)
    path = src.pop("path")
    reader = spark.read.options(**src)
    if schema is not None:
        reader = reader.schema(schema)
    return clean(reader.format(fmt).load(path))


def write_snapshot(df: DataFrame, base: str, table: str, version: str | None = None) -> str:
    """Write a refreshed snapshot to a new directory and return its path.

    A refresh is written next to, not over, the snapshot it was read from
    (``{base}/{version}/{table}``) so that a failed job never leaves a half table.
    """
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    path = f"{base.rstrip('/')}/{version}/{table}"
    df.write.mode("errorifexists").parquet(path)
    return path


def backup_tables(tables: dict[str, DataFrame], base: str, as_of: dt.date) -> dict[str, str]:
    """Dated backup of every table to ``{base}/{as_of}/{table}``."""
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{as_of.isoformat()}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out


def export_summary_csv(summary: DataFrame, path: str, all_selected: bool) -> str:
    """CSV export of the monthly summary: header row, month as ``Mar-2019``,
    values unrounded, no Total row. The national-catch column is left out unless
    every gear and habitat is selected. One file: the table has one row per month.
    """
    cols = SUMMARY_COLUMNS if all_selected else SUMMARY_COLUMNS[:-1]
    heads = HEADINGS if all_selected else HEADINGS[:-1]
    out = summary.orderBy("month").select(
        F.date_format("month", "MMM-yyyy").alias(heads[0]),
        *[F.col(c).alias(h) for c, h in zip(cols[1:], heads[1:])])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
