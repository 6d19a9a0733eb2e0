"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "landfall", extra: dict | None = None) -> SparkSession:
    """Session with adaptive execution (runtime coalescing, skew-join splitting,
    size-checked broadcast conversion) and Arrow for the Python steps. Master, number
    of shuffle partitions, memory and checkpoint folder are the submitter's: nothing is
    set here unless it is asked for."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and only read here; if it is unset
    there, this fails rather than writing to a folder only one machine sees. Only
    in local mode (tests) an unset folder is replaced by a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="landfall-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage durably (survives lost executors, unlike a local checkpoint) and
    lets later scans prune columns, push filters and prune ``partition_by`` folders. The
    write's shuffle files are dropped when it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/landfall/{name}-{uuid.uuid4().hex}"
    if partition_by:
        # Group rows of one folder into few files; adaptive execution splits a
        # folder that holds far more than the others instead of making it one task.
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        w.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _written.append(path)
    return spark.read.parquet(path)


_written: list[str] = []   # what this process has materialized, oldest first


def drop_materialized(spark: SparkSession, since: int = 0) -> None:
    """Remove what :func:`materialize` has written, from the ``since``-th table on; call
    it when the results that read those tables are stored."""
    for path in _written[since:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:]


def materialized() -> int:
    """How many tables :func:`materialize` has written so far."""
    return len(_written)
