"""Data-quality checks of the data model's keys: primary-key violations,
foreign-key orphans, and cascading deletes along the foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.operators.joins import drop_with, keep_with
from landfall.schema import FOREIGN_KEYS, PRIMARY_KEYS


def check_pk(df: DataFrame, key) -> DataFrame:
    """Key values that repeat or are NULL, with their row count ``n``."""
    key = [key] if isinstance(key, str) else list(key)
    null = None
    for k in key:
        null = F.col(k).isNull() if null is None else (null | F.col(k).isNull())
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) | null))


def check_fk(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None
             ) -> DataFrame:
    """Child rows whose non-NULL key has no parent row."""
    pk = parent_key or key
    return (child.filter(F.col(key).isNotNull())
            .join(parent.select(F.col(pk).alias(key)), key, "left_anti"))


def check_pk_new(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Key values of ``new`` rows that repeat among them, are NULL, or stand among the
    ``known`` rows, with the number of their rows in both. Of the known rows only the key
    is scanned, against the distinct new keys: they are not shuffled while those are
    small enough to broadcast, and only new rows are grouped."""
    per = new.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
    again = known.select(key).join(per.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_old"))
    n = F.col("_new") + F.coalesce("_old", F.lit(0))
    return per.join(again, key, "left").select(key, n.alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def check_fk_new(new: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """``new`` rows whose non-NULL key has no parent row. The parents' keys are scanned
    against the distinct new keys first, so the parents are not shuffled for a small delta."""
    pk = parent_key or key
    held = new.filter(F.col(key).isNotNull())
    found = parent.select(F.col(pk).alias(key)).join(held.select(key).distinct(), key, "left_semi").distinct()
    return held.join(found, key, "left_anti")


def check_pks(tables: dict[str, DataFrame], pks=PRIMARY_KEYS) -> DataFrame:
    """Per table with a key: how many key values repeat or are NULL; NULL for a table
    that is not given or lacks a key column, which is not checked."""
    out = None
    for name, key in pks.items():
        if not key:
            continue
        df = tables.get(name)
        if df is not None and set(key) <= set(df.columns):
            one = check_pk(df, key).agg(F.count(F.lit(1)).alias("violations"))
        else:
            one = unchecked(tables, "violations")
        one = one.select(F.lit(name).alias("table"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def check_fks(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Per foreign key its orphans; NULL for a key whose tables or columns are not given,
    which is not checked."""
    out = None
    for child, ckey, parent, pkey in fks:
        c, p = tables.get(child), tables.get(parent)
        if c is not None and p is not None and ckey in c.columns and pkey in p.columns:
            one = check_fk(c, ckey, p, pkey).agg(F.count(F.lit(1)).alias("orphans"))
        else:
            one = unchecked(tables, "orphans")
        one = one.select(F.lit(child).alias("child"), F.lit(ckey).alias("column"), F.lit(parent).alias("parent"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


def unchecked(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """One row that says that nothing was counted."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(F.lit(None).cast("long").alias(name))


def children_first_last(tables, root: str, fks) -> list[str]:
    """The tables that deletes from ``root`` can reach, every parent before its children."""
    reach, todo = {root}, [root]
    while todo:
        parent = todo.pop()
        for child, _, p, _ in fks:
            if p == parent and child in tables and child not in reach:
                reach.add(child)
                todo.append(child)
    order: list[str] = []
    while len(order) < len(reach):
        order += [t for t in tables if t in reach and t not in order and all(
            p in order or p not in reach for c, _, p, _ in fks if c == t)]
    return order


def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame,
                   fks=FOREIGN_KEYS, pks=PRIMARY_KEYS) -> dict[str, DataFrame]:
    """Remove the ``root`` rows whose key is in ``ids`` and, along every foreign key, the
    rows that refer to a removed row. Tables are walked parents first (the key graph is
    small and fixed); each has one set of removed keys, collected over all its edges
    before its children are looked at, so a child reached by several edges is done once."""
    removed: dict[str, DataFrame] = {root: ids.select(F.col(ids.columns[0]).alias(pks[root][0]))}
    out = dict(tables)
    out[root] = drop_with(tables[root], removed[root], pks[root][0])
    for table in children_first_last(tables, root, fks)[1:]:
        gone = None
        for child, ckey, parent, pcol in fks:
            if child != table or parent not in removed or ckey not in tables[table].columns:
                continue
            keys = removed[parent].select(F.col(pcol).alias(ckey)).distinct()
            out[table] = drop_with(out[table], keys, ckey)
            pk = pks.get(table)
            if pk:
                hit = keep_with(tables[table], keys, ckey).select(*pk)
                gone = hit if gone is None else gone.unionByName(hit)
        if gone is not None:
            removed[table] = gone.distinct()
    return out
