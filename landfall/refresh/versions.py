"""Versioned snapshots of the fact tables, stored by month, whose refresh writes only the
months that changed.

A store is a folder: ``{base}/{table}/version=N/month=YYYY-MM`` holds the rows of one month
as version N wrote them, ``{base}/versions/N`` is the manifest of version N: which version
holds each month of each table, and the high-water mark of each parent table. A refresh
reads the mark from the manifest (no data is scanned for it), takes the delta, rewrites the
months that the delta's rows go to or come from into a new version, and writes the new
manifest last. Readers see whole versions only; a refresh that fails or runs twice leaves
the old one as it was, and the second of two refreshes at once fails on the manifest.

Children lie in their parent's month (``none`` without a dated parent), so months to be
rewritten follow from the parents: the parents' key column is scanned, children are read in
the rewritten months only. The driver holds months and marks, which the calendar bounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landfall.functions.columns import nan_to_null
from landfall.functions.dates import month_floor
from landfall.refresh.delta import dedupe, high_water, read_delta, read_delta_child, refresh
from landfall.schema import SCHEMAS
from landfall.session import materialize

NO_MONTH = "none"


@dataclass(frozen=True)
class Facts:
    """A parent table, its child table, their key, and the parent's date and mark columns."""
    parent: str
    child: str
    key: str
    date: str = "date"
    mark: str = "date_numeric"


FACTS = (Facts("trips", "landings", "trip_id"), Facts("pds_trips", "pds_points", "PDS_trip"))


@dataclass
class Version:
    number: int
    marks: dict[str, float | None] = field(default_factory=dict)
    months: dict[str, dict[str, int]] = field(default_factory=dict)     # table -> month -> version


def latest_version(spark: SparkSession, base: str) -> Version | None:
    """The manifest with the highest number; None where no store is."""
    try:
        rows = spark.read.text(f"{base.rstrip('/')}/versions/*").select(
            F.max(F.struct(F.get_json_object("value", "$.number").cast("int"), "value"))).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Version(**json.loads(rows["value"])) if rows else None


def read_manifest(spark: SparkSession, base: str, number: int) -> Version:
    """An earlier version, which still reads as it was."""
    return Version(**json.loads(spark.read.text(f"{base.rstrip('/')}/versions/{number}").first()["value"]))


def write_manifest(spark: SparkSession, base: str, version: Version) -> None:
    one = spark.createDataFrame([(json.dumps(version.__dict__),)], "value string").coalesce(1)
    one.write.mode("errorifexists").text(f"{base.rstrip('/')}/versions/{version.number}")


def with_month(parent: DataFrame, date: str) -> DataFrame:
    """The month of a text date; unreadable and missing dates are ``none``."""
    day = F.expr(f"try_cast(`{date}` AS DATE)")
    return parent.withColumn("month", F.coalesce(F.date_format(month_floor(day), "yyyy-MM"), F.lit(NO_MONTH)))


def with_parent_month(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children with the month of their parent (the first, if a key stands twice)."""
    # Months are compared as numbers (``none`` last): a least text would be found by sorting.
    number = F.coalesce(F.try_to_number(F.replace(F.col("month"), F.lit("-"), F.lit("")), F.lit("999999")).cast("int"), F.lit(10 ** 6))
    of = parent.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(number).alias("_m"))
    month = F.when(F.col("_m") < 10 ** 6, F.format_string("%04d-%02d", F.floor(F.col("_m") / 100).cast("int"), F.col("_m") % 100))
    return child.join(of, key, "left").withColumn("month", F.coalesce(month, F.lit(NO_MONTH))).select(*child.columns, "month")


def write_months(df: DataFrame, base: str, table: str, number: int) -> list[str]:
    """Write rows with their ``month`` as a version's part of a table; the months written."""
    path = f"{base.rstrip('/')}/{table}/version={number}"
    df.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
    kind = T.StructType([f for f in df.schema.fields if f.name != "month"] + [T.StructField("month", T.StringType())])
    return [r["month"] for r in df.sparkSession.read.schema(kind).parquet(path).select("month").distinct().collect()]


def read_months(spark: SparkSession, base: str, table: str, version: Version, schema: T.StructType | None = None,
                months: Iterable[str] | None = None) -> DataFrame:
    """The rows of a version's table with their ``month``, of some months or of all."""
    schema = schema or SCHEMAS[table]
    kind = T.StructType([*schema.fields, T.StructField("month", T.StringType())])
    held = version.months.get(table, {})
    root = f"{base.rstrip('/')}/{table}"
    paths = [f"{root}/version={held[m]}/month={m}" for m in sorted(held if months is None else set(months) & set(held))]
    if not paths:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", root).parquet(*paths).select(*kind.names)


def read_version(spark: SparkSession, base: str, table: str, version: Version, schema: T.StructType | None = None) -> DataFrame:
    return read_months(spark, base, table, version, schema).drop("month")


def create_store(spark: SparkSession, base: str, tables: dict[str, DataFrame], facts: Iterable[Facts] = FACTS) -> Version:
    """The first version, from whole tables, which are deduplicated here once."""
    v = Version(1)
    for f in facts:
        parent = with_month(dedupe(nan_to_null(tables[f.parent])), f.date)
        v.months[f.parent] = dict.fromkeys(write_months(parent, base, f.parent, 1), 1)
        kept = read_months(spark, base, f.parent, v, tables[f.parent].schema)
        child = with_parent_month(dedupe(nan_to_null(tables[f.child])), kept, f.key)
        v.months[f.child] = dict.fromkeys(write_months(child, base, f.child, 1), 1)
        v.marks[f.parent] = high_water(kept, f.mark)
    write_manifest(spark, base, v)
    return v


def refresh_store(spark: SparkSession, base: str, source: Callable[[str], DataFrame], facts: Iterable[Facts] = FACTS,
                  lookback: float = 0.0, schemas: dict[str, T.StructType] = SCHEMAS) -> Version:
    """A new version with the rows above the marks. ``source`` gives a newer table by its
    name, as it is read (NaN in place, so that the mark's filter is pushed down)."""
    old = latest_version(spark, base)
    new = Version(old.number + 1, dict(old.marks), {t: dict(m) for t, m in old.months.items()})
    changed_any = False
    for f in facts:
        delta = read_delta(source(f.parent), old.marks.get(f.parent), f.mark, lookback)
        delta = materialize(with_month(dedupe(delta), f.date), f"delta-{f.parent}")
        keys = delta.select(f.key)
        snapshot = read_months(spark, base, f.parent, old, schemas[f.parent])
        months = {r["month"] for r in delta.select("month").unionByName(
            snapshot.join(keys, f.key, "left_semi").select("month")).distinct().collect()}
        if not months:
            continue
        changed_any = True
        inside = read_months(spark, base, f.parent, old, schemas[f.parent], months)
        replace_months(new, f.parent, months, write_months(refresh(inside, delta, f.key, dedupe_rows=False),
                                                           base, f.parent, new.number))
        newer = delta.agg(F.max(f.mark)).first()[0]
        new.marks[f.parent] = max((x for x in (old.marks.get(f.parent), newer) if x is not None), default=None)

        rows = dedupe(read_delta_child(source(f.child), delta, f.key))
        rows = with_parent_month(rows, delta, f.key)
        strays = read_months(spark, base, f.child, old, schemas[f.child], [NO_MONTH])
        if NO_MONTH not in months and not strays.join(keys, f.key, "left_semi").isEmpty():
            months = months | {NO_MONTH}             # children that came before their parent
        inside = read_months(spark, base, f.child, old, schemas[f.child], months)
        replace_months(new, f.child, months, write_months(
            refresh(inside, rows, f.key, dedupe_rows=False, changed=delta), base, f.child, new.number))
    if not changed_any:
        return old
    write_manifest(spark, base, new)
    return new


def replace_months(version: Version, table: str, rewritten: set[str], written: list[str]) -> None:
    """Months that were rewritten lie in this version; those left without a row are gone."""
    held = version.months.setdefault(table, {})
    for m in rewritten:
        held.pop(m, None)
    held.update(dict.fromkeys(written, version.number))
