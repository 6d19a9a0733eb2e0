"""Benchmark: the whole dashboard on one scale factor.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1) and prints
one JSON line. Steps:

* ``prepare``: stand-in tables from the test tables, refreshed (full-row dedupe)
  and written once to the checkpoint folder.
* ``clean``: the quality rules, written as the cleaned tables the reports read
  (partitioned by month, so each report's slice prunes month folders).
* every dashboard result of the main selection and the donor jobs, each
  executed in full with a ``noop`` write (no collect).

``value`` is the sum of all timed steps. With ``BENCH_ALL=1``
every registered query is also timed (lazily, from the test tables) and reported
under ``named``, outside ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landfall import fixtures  # noqa: E402
from landfall.catalog import MAIN, PARAMS, SMOOTH, refreshed  # noqa: E402
from landfall.operators.donor import (donate_attributes, donor_accuracy,  # noqa: E402
                                      nearest_donor, train_split, validate_donor)
from landfall.plans.clean import persist_clean  # noqa: E402
from landfall.plans.reports import daily, dashboard  # noqa: E402
from landfall.plans.slicing import slice_tables  # noqa: E402
from landfall.session import get_spark, materialize  # noqa: E402
from landfall.tables import Tables  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    t = time.perf_counter()
    out = fn()
    return out, round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus), extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    times: dict[str, float] = {}

    def prepare():
        r = refreshed(spark, sf_dir)
        return Tables(**{k: materialize(v, f"bench-{k}") for k, v in r.items()})
    src, times["prepare"] = timed(prepare)

    cleaned, times["clean"] = timed(lambda: persist_clean(src, PARAMS, "bench-clean"))

    sliced, spine = slice_tables(cleaned, MAIN, PARAMS)
    for name, df in dashboard(sliced, spine, MAIN, PARAMS, held=[]).items():
        _, times[name] = timed(lambda df=df: run(df))
    smooth_sliced, _ = slice_tables(cleaned, SMOOTH, PARAMS)
    _, times["site_smoothed"] = timed(
        lambda: run(daily(smooth_sliced, "site", SMOOTH, PARAMS)))

    sig = fixtures.signatures(spark, sf_dir).withColumn("rep", F.lit(0))
    train = train_split("trip_id", "rep")
    _, times["nearest_donor"] = timed(lambda: run(nearest_donor(
        sig.filter(~train).drop("rep"), sig.filter(train).drop("rep"), cap=PARAMS.donor_cap)))
    _, times["donor_fill"] = timed(lambda: run(donate_attributes(
        fixtures.tracks(spark, sf_dir), cap=PARAMS.donor_cap)))
    _, times["validate_donor"] = timed(lambda: run(donor_accuracy(validate_donor(
        fixtures.signatures(spark, sf_dir), 100, PARAMS.donor_cap))))

    named: dict[str, float] = {}
    if os.environ.get("BENCH_ALL") == "1":   # opt-in: every registered query, lazily from the test tables
        from landfall.catalog import QUERIES
        for name, fn in QUERIES.items():
            _, named[name] = timed(lambda fn=fn: run(fn(spark, sf_dir)))

    total = round(sum(times.values()), 3)
    mem_gb = round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30, 1)
    print(json.dumps({"metric": "dashboard_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus), "host_cpus": os.cpu_count(), "host_mem_gb": mem_gb,
                      **({"named": named} if named else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
