"""Smoothing spline properties (no oracle exists for it)."""

import numpy as np
import pandas as pd

from landfall.functions.spline import n_knots, smooth_fit
from landfall.operators.smooth import smooth_series


def test_line_and_constant_are_reproduced():
    x = np.arange(40.0)
    w = np.linspace(1, 3, 40)
    assert np.allclose(smooth_fit(x, 1 + 0.5 * x, w, 0.8), 1 + 0.5 * x, atol=1e-8)
    assert np.allclose(smooth_fit(x, np.full(40, 7.0), w, 0.3), 7.0, atol=1e-8)


def test_spar_zero_returns_input():
    y = np.random.default_rng(0).normal(size=20)
    assert np.array_equal(smooth_fit(np.arange(20.0), y, np.ones(20), 0.0), y)


def test_large_spar_tends_to_weighted_line():
    rng = np.random.default_rng(3)
    x = np.arange(60.0)
    y = 2 + 0.1 * x + rng.normal(size=60)
    w = rng.uniform(1, 5, 60)
    fit = smooth_fit(x, y, w, 1.0)
    coef = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert np.abs(fit - np.polyval(coef, x)).max() < 0.2


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(5)
    n = 30
    dates = pd.date_range("2019-01-01", periods=n).date
    pdf = pd.DataFrame({"code": 1, "date": dates, "CPUE": rng.uniform(0, 5, n),
                        "trip_effort": rng.uniform(1, 10, n)})
    a = spark.createDataFrame(pdf)
    b = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    fa = {r.date: r.fit for r in smooth_series(a, "code", "date", "CPUE", "trip_effort", 0.6).collect()}
    fb = {r.date: r.fit for r in smooth_series(b, "code", "date", "CPUE", "trip_effort", 0.6).collect()}
    assert fa.keys() == fb.keys()
    assert all(abs(fa[k] - fb[k]) < 1e-10 for k in fa)


def test_knot_count_rule():
    assert n_knots(10) == 10 and n_knots(49) == 49
    ks = [n_knots(n) for n in range(50, 4000, 25)]
    assert ks == sorted(ks)                     # never decreases
    assert 99 <= n_knots(200) <= 100 and 139 <= n_knots(800) <= 140
    assert 199 <= n_knots(3200) <= 200


def test_weighted_mean_is_preserved():
    # Constants are not penalised, so weighted residuals sum to zero.
    rng = np.random.default_rng(9)
    x = np.sort(rng.choice(np.arange(400.0), 120, replace=False))
    y = rng.gamma(2.0, 1.5, 120)
    w = rng.uniform(1, 20, 120)
    for spar in (0.2, 0.5, 0.9):
        fit = smooth_fit(x, y, w, spar)
        assert abs(np.average(fit, weights=w) - np.average(y, weights=w)) < 1e-9
        assert fit.std() < y.std()
