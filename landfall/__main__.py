"""Command line: refresh, clean, slice and write every dashboard result.

    python -m landfall --tables DIR [--source DIR] [--store DIR] --start 2019-01-01 --end 2019-12-31 \
        [--sites Dili Baucau ...] [--habitats ...] [--gears ...] [--boats Canoe Motor] \
        [--spar 0.5] [--as-of 2020-01-01] [--min-date 2016-09-01] --out DIR

``--tables`` holds the snapshot tables (trips, landings, pds_trips, pds_points,
municipalities, stations, species, and optionally shape) as Parquet folders in
the declared schemas; ``--source`` holds the newer full tables whose rows
above the snapshot's high-water mark are added: a folder of Parquet tables or a
``jdbc:`` URL (``--jdbc-option user=... --jdbc-option password=...``), whose tables are
read by ranges of their keys. With ``--store`` the fact tables live in a versioned store
by month: it is made from ``--tables`` once, and later runs write only the months that
``--source`` changes. Folders may be on any file system that Spark reads. Results are written as Parquet folders under
``--out`` plus ``summary_csv``; tables written on the way are removed at the end.
Master, memory and shuffle partitions are set by spark-submit.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.errors import AnalysisException

from landfall.config import Params, Selection
from landfall.plans.clean import persist_clean
from landfall.plans.reports import dashboard
from landfall.plans.slicing import slice_tables
from landfall.refresh import (create_store, dedupe, latest_version, read_version, refresh_store,
                              refresh_tables)
from landfall.schema import SCHEMAS
from landfall.session import drop_materialized, get_spark, materialize, materialized
from landfall.sources.snapshot import export_summary_csv, jdbc_source, read_snapshot, read_table
from landfall.tables import Tables

FACTS = (("trips", "landings", "trip_id"), ("pds_trips", "pds_points", "PDS_trip"))
DIMS = ("municipalities", "stations", "species")


def read_source(spark, source: str, table: str, options: dict):
    """A newer table from a folder or a database, as it is stored there."""
    if source.startswith("jdbc:"):
        split = next(key for parent, child, key in FACTS if table in (parent, child))
        return read_table(spark, jdbc_source(source, table, options, split), SCHEMAS[table], raw=True)
    return read_snapshot(spark, source, table, raw=True)


def load_store(spark, store: str, base: str, source: str | None, options: dict) -> dict:
    """The fact tables of a versioned store, made from the snapshot if there is none yet and
    refreshed if there is a newer source. Its files are read as they are."""
    names = [n for parent, child, _ in FACTS for n in (parent, child)]
    version = latest_version(spark, store) or create_store(
        spark, store, {n: read_snapshot(spark, base, n, raw=True) for n in names})
    if source:
        version = refresh_store(spark, store, lambda n: read_source(spark, source, n, options))
    return {n: read_version(spark, store, n, version) for n in names}


def load(spark, base: str, source: str | None, options: dict | None = None, store: str | None = None) -> Tables:
    """Refreshed tables. A snapshot without a newer source is deduplicated as it is first
    taken; without a store the large tables are written once, so cleaning does not refresh
    them again. A missing dimension table is an error, a missing shape is not."""
    t = load_store(spark, store, base, source, options or {}) if store else {}
    for parent, child, key in () if store else FACTS:
        p, c = read_snapshot(spark, base, parent), read_snapshot(spark, base, child)
        if source:
            p, c = refresh_tables(p, c, read_source(spark, source, parent, options or {}),
                                  read_source(spark, source, child, options or {}), key)
        else:
            p, c = dedupe(p), dedupe(c)
        t[parent], t[child] = materialize(p, f"load-{parent}"), materialize(c, f"load-{child}")
    for d in DIMS:
        t[d] = read_snapshot(spark, base, d)
    try:
        t["shape"] = read_snapshot(spark, base, "shape")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return Tables(**t)


def run(args: argparse.Namespace, spark=None) -> dict[str, str]:
    spark = spark or get_spark()
    params = Params(as_of=args.as_of or dt.date.today())
    if args.min_date:
        params = params.with_(min_date=args.min_date)
    lab = params.labels
    sel = Selection(start=args.start, end=args.end,
                    sites=tuple(args.sites or lab.sites), habitats=tuple(args.habitats or lab.habitats),
                    gears=tuple(args.gears or lab.gears), boats=tuple(args.boats or lab.boats),
                    spar=args.spar)
    before = materialized()
    options = dict(o.split("=", 1) for o in args.jdbc_option or ())
    cleaned = persist_clean(load(spark, args.tables, args.source, options, args.store), params)
    sliced, spine = slice_tables(cleaned, sel, params)
    out, held, base = {}, [], args.out.rstrip("/")
    results = dashboard(sliced, spine, sel, params, held=held)
    for name, df in results.items():
        out[name] = f"{base}/{name}"
        # headings hold blanks and brackets, which Parquet columns may
        df.write.mode("overwrite").parquet(out[name])
    out["summary_csv"] = export_summary_csv(results["monthly"], f"{base}/summary_csv",
                                            sel.raising_enabled(lab))
    for df in held:
        df.unpersist()
    drop_materialized(spark, before)
    return out


def parse(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="landfall", description=__doc__.split("\n")[0])
    day = dt.date.fromisoformat
    ap.add_argument("--tables", required=True)
    ap.add_argument("--source")
    ap.add_argument("--store")
    ap.add_argument("--jdbc-option", action="append", dest="jdbc_option", metavar="NAME=VALUE")
    ap.add_argument("--start", type=day, required=True)
    ap.add_argument("--end", type=day, required=True)
    ap.add_argument("--as-of", type=day, dest="as_of")
    ap.add_argument("--min-date", type=day, dest="min_date")
    for dim in ("sites", "habitats", "gears", "boats"):
        ap.add_argument(f"--{dim}", nargs="*")
    ap.add_argument("--spar", type=float, default=0.0)
    ap.add_argument("--out", required=True)
    return ap.parse_args(argv)


if __name__ == "__main__":
    for k, v in run(parse()).items():
        print(k, v)
