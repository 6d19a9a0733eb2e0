"""The command line over stored snapshot tables in the declared schemas."""

import glob
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from landfall import fixtures
from landfall.__main__ import load, parse, run
from landfall.config import GEARS, HABITATS, SITES
from landfall.refresh import latest_version
from landfall.session import get_spark, materialized

SF = "/root/testdata/sf0.001"


def test_cli_writes_every_result(spark, scratch):
    base, src, out = (os.path.join(scratch, d) for d in ("snap", "src", "out"))
    t = fixtures.load(spark, SF)
    for name, df in t.items():
        df.write.parquet(os.path.join(src, name))
        if name == "trips":
            df = df.filter(F.col("date_numeric") <= 10800)
        df.write.parquet(os.path.join(base, name))
    before = materialized()
    args = parse(["--tables", "file://" + base, "--source", src, "--start", "1996-12-31",
                  "--end", "1999-07-01", "--as-of", "2001-07-01", "--min-date", "1996-01-01", "--sites", *SITES[:9],
                  "--habitats", *HABITATS, "--gears", *GEARS, "--spar", "0.5", "--out", out])
    paths = run(args, spark)
    assert {"monthly", "table", "site", "species", "heat_classes", "summary_csv"} <= set(paths)
    monthly = spark.read.parquet(paths["monthly"])
    assert monthly.count() == 32 and monthly.agg(F.sum("trips")).first()[0] > 30
    assert glob.glob(os.path.join(paths["summary_csv"], "part-*.csv"))
    assert {"Reported trips", "CPUE (KG/hour)"} <= set(spark.read.parquet(paths["table"]).columns)
    assert spark.read.parquet(paths["shape"]).count() > 0        # found through a URI
    assert materialized() == before                              # nothing is left behind


def test_cli_with_a_store(spark, scratch):
    """Two runs on one store: the second writes only what the source changes, and both
    give what a run without a store gives."""
    base, src, store = (os.path.join(scratch, d) for d in ("snap", "src", "store"))
    t = fixtures.load(spark, SF)
    for name, df in t.items():
        df.write.parquet(os.path.join(src, name))
        if name == "trips":
            df = df.filter(F.col("date_numeric") <= 10800)
        df.dropDuplicates().write.parquet(os.path.join(base, name))      # a snapshot holds no repeats
    common = ["--tables", base, "--start", "1996-12-31", "--end", "1999-07-01", "--as-of", "2001-07-01",
              "--min-date", "1996-01-01", "--sites", *SITES[:9], "--habitats", *HABITATS, "--gears", *GEARS]
    run(parse([*common, "--store", store, "--out", os.path.join(scratch, "one")]), spark)
    rows = {}
    for name, more in (("stored", ["--store", store]), ("plain", [])):
        paths = run(parse([*common, *more, "--source", src, "--out", os.path.join(scratch, name)]), spark)
        rows[name] = sorted(map(repr, spark.read.parquet(paths["monthly"]).collect()))
    assert rows["stored"] == rows["plain"]
    assert latest_version(spark, store).number == 2


def test_a_missing_dimension_table_is_an_error(spark, scratch):
    t = fixtures.load(spark, SF)
    for name, df in t.items():
        if name != "species":
            df.limit(5).write.parquet(os.path.join(scratch, name))
    with pytest.raises(AnalysisException):
        load(spark, scratch, None)


def test_session_keeps_what_the_submitter_set(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "123")
    s = get_spark()
    assert s.conf.get("spark.sql.shuffle.partitions") == "123"
    assert s.sparkContext.master == "local[4]"
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """The shuffle of a finished write is dropped; the submitter's setting stays as it was."""
    from landfall.session import SHUFFLE_CLEANUP, materialize
    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                     for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, was = files(), spark.conf.get(SHUFFLE_CLEANUP)
    df = materialize(spark.range(10_000).repartition(7, "id"), "cleanup")
    assert df.count() == 10_000 and spark.conf.get(SHUFFLE_CLEANUP) == was
    assert not {f for f in files() - before if os.path.getsize(f) > 10_000}
