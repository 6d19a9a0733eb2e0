"""Invariants over the test tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from landfall import catalog
from landfall.operators.aggregates import daily_cpue, species_catch
from landfall.operators.spatial import heat
from landfall.operators.aggregates import with_total

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundle(spark):
    s, spine = catalog.sliced(spark, SF)
    return s, spine


def test_total_is_sum_of_months(spark, bundle):
    summary = catalog.summary_of(spark, SF)
    rows = with_total(summary).collect()
    body = [r for r in rows if not r.is_total]
    total = [r for r in rows if r.is_total][0]
    assert total.trips == sum(r.trips for r in body)
    assert total.KG == pytest.approx(sum(r.KG for r in body))


def test_monthly_kg_equals_daily_kg(spark, bundle):
    s, spine = bundle
    monthly = catalog.monthly_cpue(s.trips, spine).agg(F.sum("KG")).first()[0]
    daily = daily_cpue(s.trips, "habitat_code", catalog.TEST_LABELS.habitats, 1).agg(
        F.sum("KG")).first()[0]
    assert monthly == pytest.approx(daily)


def test_heat_counts_sum_to_points(spark, bundle):
    s, _ = bundle
    n = s.pds_points.filter(F.col("latlng").isNotNull()).count()
    assert heat(s.pds_points).agg(F.sum("counts")).first()[0] == n


def test_top_species_keeps_all_tonnes(spark, bundle):
    s, _ = bundle
    top = catalog.top(s, catalog.PARAMS).agg(F.sum("Tonnes")).first()[0]
    allkg = species_catch(s.landings).agg(F.sum("KG")).first()[0]
    assert top == pytest.approx(allkg / 1000)


def test_clean_counts_match_fixture_notes(spark):
    assert catalog.cleaned(spark, SF).trips.count() == 929
    assert catalog.sliced(spark, SF)[0].trips.count() == 204
    assert catalog.cleaned(spark, SF).pds_trips.count() == 377


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.collect()), key=repr)


def test_stored_path_equals_lazy_path(spark):
    """Slicing the month-partitioned store (children filtered by copied trip
    attributes) gives the same reports as slicing lazily (semi joins)."""
    from landfall.plans.clean import persist_clean
    from landfall.plans.reports import dashboard
    from landfall.plans.slicing import slice_tables

    r = catalog.refreshed(spark, SF)
    stored = persist_clean(r, catalog.PARAMS, "prop-store")
    a = dashboard(*slice_tables(stored, catalog.MAIN, catalog.PARAMS), catalog.MAIN, catalog.PARAMS,
                  held=[])
    b = dashboard(*catalog.sliced(spark, SF), catalog.MAIN, catalog.PARAMS)
    for name in ("monthly", "table", "site", "habitat", "gear", "species", "heat", "heat_classes"):
        assert _rows(a[name]) == _rows(b[name]), name
