"""Snapshot + delta refresh (high-water mark, parent delta, child delta, union, dedupe).

Sources are given as they are read (``raw`` readers): the mark is compared with the stored
column itself, so the filter reaches Parquet statistics or the database's query, and NaN
becomes NULL only in the rows that come through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.functions.columns import nan_to_null


def high_water(df: DataFrame, col: str = "date_numeric") -> float | None:
    """Largest ``col`` in the snapshot, NULL and NaN ignored; ``None`` for an empty
    snapshot (then the delta is a full load). Only this scalar reaches the driver,
    so the delta filter below is a literal that Parquet/JDBC scans push down."""
    row = df.agg(F.max(F.nanvl(F.col(col).cast("double"), F.lit(None))).alias("m")).first()
    return None if row is None or row["m"] is None else float(row["m"])


def read_delta(source: DataFrame, mark: float | None, col: str = "date_numeric",
               lookback: float = 0.0) -> DataFrame:
    """Rows strictly newer than the mark (``col > mark - lookback``), NaN as NULL. A NaN
    mark column is greater than any number, so such rows are dropped after the scan.

    With the default ``lookback=0`` a row that arrives with a value at or below
    the mark is never picked up, as in the original; a lookback re-reads a margin
    and :func:`refresh` replaces what the snapshot already holds of it.
    """
    if mark is None:
        return nan_to_null(source)
    newer = source.filter(F.col(col) > F.lit(mark - lookback))
    return nan_to_null(newer).filter(F.col(col).isNotNull())


def read_delta_child(child: DataFrame, delta_parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is in the delta (``key IN (SELECT key FROM delta)``)."""
    return nan_to_null(child).join(delta_parent.select(key), key, "left_semi")


def dedupe(df: DataFrame) -> DataFrame:
    """Full-row dedupe, NULL equal to NULL, once when a snapshot is first taken.
    Tables without a key lose honest repeats too; that is the original behaviour and
    results depend on it. Every column takes part, so rows that differ in a note stay."""
    return df.dropDuplicates()


def refresh(snapshot: DataFrame, delta: DataFrame, key: str, dedupe_rows: bool = True,
            changed: DataFrame | None = None) -> DataFrame:
    """The snapshot with the rows of ``delta``, which replace those of the same key.

    Only the delta is deduplicated: the snapshot was when it was taken, and no row of
    a key in the delta stays in it. The snapshot meets only the delta's distinct keys
    (``changed``, by default those of ``delta``), a side that Spark broadcasts after
    checking its size, so a refresh costs a scan of the snapshot and a shuffle of the
    delta. A parent that comes in a second version leaves one version, not two."""
    keys = (delta if changed is None else changed).select(key).distinct()
    kept = snapshot.join(keys, key, "left_anti").select(*snapshot.columns)
    return kept.unionByName(dedupe(delta) if dedupe_rows else delta)


def refresh_tables(snap_parent: DataFrame, snap_child: DataFrame, source_parent: DataFrame,
                   source_child: DataFrame, key: str, col: str = "date_numeric",
                   lookback: float = 0.0, dedupe_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """Refresh a parent table and its child table together (trips + landings or
    tracked trips + points); the children of a replaced parent are replaced with it."""
    mark = high_water(snap_parent, col)
    dp = read_delta(source_parent, mark, col, lookback)
    dc = nan_to_null(source_child) if mark is None else read_delta_child(source_child, dp, key)
    return (refresh(snap_parent, dp, key, dedupe_rows),
            refresh(snap_child, dc, key, dedupe_rows, changed=dp))
