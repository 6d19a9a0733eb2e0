"""Nearest-donor matching against a brute-force numpy answer."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfall import session
from landfall.operators.donor import (donate_attributes, donor_accuracy, nearest_donor, train_split,
                                      validate_donor)


def _frame(spark, ids, feats, gears, habs):
    rows = [(int(i), [float(v) for v in f], int(g), int(h))
            for i, f, g, h in zip(ids, feats, gears, habs)]
    return spark.createDataFrame(rows, "trip_id long, features array<double>, gear_code int, habitat_code int")


def _brute(qf, df, dids, cap):
    out = {}
    for i, q in enumerate(qf):
        dist = np.sqrt(((df - q) ** 2).sum(axis=1))
        order = np.lexsort((dids, dist))
        j = order[0]
        out[i] = (int(dids[j]), float(dist[j])) if dist[j] <= cap else (None, None)
    return out


@pytest.mark.parametrize("block_rows,spread", [(2048, 0.3), (5, 0.3), (3, 0.02)])
def test_matches_brute_force(spark, block_rows, spread):
    rng = np.random.default_rng(7)
    nd, nq, k = 60, 25, 20
    df = rng.normal(0, spread, (nd, k))
    qf = rng.normal(0, spread, (nq, k))
    dids = np.arange(1000, 1000 + nd)
    donors = _frame(spark, dids, df, rng.integers(1, 9, nd), rng.integers(1, 6, nd))
    queries = _frame(spark, np.arange(nq), qf, np.zeros(nq), np.zeros(nq))
    cap = 0.9 if spread > 0.1 else 0.2
    got = {r.trip_id: (r.donor_tripid, r.donor_distance) for r in
           nearest_donor(queries, donors, cap=cap, block_rows=block_rows).collect()}
    want = _brute(qf, df, dids, cap)
    assert set(got) == set(range(nq))
    for i in range(nq):
        assert got[i][0] == want[i][0]
        if want[i][1] is not None:
            assert got[i][1] == pytest.approx(want[i][1], abs=1e-12)


def test_ties_go_to_smallest_donor_id(spark):
    f = [[0.0] * 20]
    donors = _frame(spark, [7, 3, 5], f * 3, [1, 2, 3], [1, 1, 1])
    queries = _frame(spark, [1], [[0.01] + [0.0] * 19], [0], [0])
    r = nearest_donor(queries, donors, cap=0.2).collect()[0]
    assert r.donor_tripid == 3 and r.gear_code == 2


def in_training(i, rep):
    return int(hashlib.md5(f"{i}-{rep}".encode()).hexdigest()[:8], 16) % 10 < 8


def test_every_repeat_draws_another_split(spark):
    r = spark.range(200).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99))))
    parts = r.filter(train_split("id", "rep")).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert len({tuple(p.ids) for p in parts}) == 100
    assert all(list(p.ids) == [i for i in range(200) if in_training(i, p.rep)] for p in parts)


def test_equal_donors_count_once_and_dense_cells_are_searched_by_growing_radius(spark):
    rng = np.random.default_rng(3)
    feats = np.vstack([rng.normal(0, 0.05, (40, 20)), np.zeros((30, 20))])   # one cell, thirty equal donors
    donors = _frame(spark, np.arange(70), feats, np.arange(70), np.arange(70))
    queries = _frame(spark, np.arange(20), rng.normal(0, 0.05, (20, 20)), np.zeros(20), np.zeros(20))
    got = {r.trip_id: (r.donor_tripid, r.gear_code) for r in nearest_donor(queries, donors, cap=2.0, block_rows=4).collect()}
    qf = np.array([q.features for q in queries.orderBy("trip_id").collect()])
    want = _brute(qf, feats, np.arange(70), 2.0)
    assert got == {i: (w[0], w[0]) for i, w in want.items()}


def test_validation_counts(spark):
    rng = np.random.default_rng(11)
    n = 80
    feats = rng.normal(0, 0.1, (n, 20))
    labels = rng.integers(0, 4, n)
    sig = _frame(spark, np.arange(n), feats, labels, labels % 3)
    per = validate_donor(sig, reps=5, cap=2.0).orderBy("rep").collect()
    assert len(per) == 5
    for r in per:
        ids = np.arange(n)
        train = np.array([in_training(i, r.rep) for i in ids])
        q, d = feats[~train], feats[train]
        dist = np.sqrt(((q[:, None, :] - d[None, :, :]) ** 2).sum(-1))
        best = dist.argmin(axis=1)
        kept = [i for i in range(len(q))
                if labels[~train][i] in set(labels[train])
                and (labels[~train][i] % 3) in set(labels[train] % 3)]
        assert r.kept == len(kept)
        acc = np.mean([labels[~train][i] == labels[train][best[i]] for i in kept])
        assert r.gear_acc == pytest.approx(acc)
    s = donor_accuracy(validate_donor(sig, reps=5, cap=2.0)).collect()[0]
    assert s.reps == 5 and 0 <= s.gear_mean <= 1


def _brute_validation(ids, feats, gears, habs, reps, cap):
    dist = np.sqrt(((feats[:, None, :] - feats[None, :, :]) ** 2).sum(-1))
    out = {}
    for rep in range(reps):
        train = np.array([in_training(i, rep) for i in ids])
        hits = []
        for q in np.nonzero(~train)[0]:
            near = min((dist[q, d], ids[d], d) for d in np.nonzero(train)[0])
            if near[0] <= cap and gears[q] in gears[train] and habs[q] in habs[train]:
                hits.append((gears[q] == gears[near[2]], habs[q] == habs[near[2]]))
        if hits:
            out[rep] = (len(hits), *np.mean(hits, axis=0))
    return out


@pytest.mark.parametrize("block_rows,cap", [(16384, 0.6), (7, 0.6), (30, 0.3), (16384, 0.3)])
def test_validation_with_equal_signatures_and_two_words_of_repeats(spark, block_rows, cap):
    rng = np.random.default_rng(5)
    feats = np.vstack([rng.normal(0, 0.1, (120, 20)), np.tile(rng.normal(0, 0.1, 20), (40, 1)), np.full((3, 20), 9.0)])
    ids = rng.permutation(len(feats))
    gears, habs = rng.integers(0, 5, len(feats)), rng.integers(0, 3, len(feats))
    gears[-1] = 77                                              # a code of one row
    got = {r.rep: (r.kept, r.gear_acc, r.habitat_acc) for r in validate_donor(
        _frame(spark, ids, feats, gears, habs), reps=70, cap=cap, block_rows=block_rows).collect()}
    want = _brute_validation(ids, feats, gears, habs, 70, cap)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_validation_takes_all_donors_where_the_nearest_do_not_serve_every_repeat(spark):
    # 100 donors at the same few distances: one training part in ten leaves most of them out.
    feats = np.zeros((200, 20))
    feats[:, 3] = np.arange(200) * 1e-3
    ids, codes = np.arange(200), np.arange(200) % 4
    got = {r.rep: (r.kept, r.gear_acc) for r in validate_donor(
        _frame(spark, ids, feats, codes, codes % 2), reps=40, cap=0.2, split=(10, 1)).collect()}
    for rep in range(40):
        train = np.array([int(hashlib.md5(f"{i}-{rep}".encode()).hexdigest()[:8], 16) % 10 < 1 for i in ids])
        d = np.sqrt(((feats[~train][:, None] - feats[train][None]) ** 2).sum(-1))
        near = ids[train][d.argmin(axis=1)]
        kept = [(q % 4, n % 4) for q, n, x in zip(ids[~train], near, d.min(axis=1))
                if x <= 0.2 and q % 4 in ids[train] % 4 and q % 2 in ids[train] % 2]
        assert got[rep] == (len(kept), pytest.approx(np.mean([a == b for a, b in kept])))


def test_validation_stores_no_row_for_each_repeat(spark):
    rng = np.random.default_rng(2)
    n = 60
    sig = _frame(spark, np.arange(n), rng.normal(0, 0.05, (n, 20)), np.arange(n) % 4, np.arange(n) % 3)
    since = session.materialized()
    assert len(validate_donor(sig, reps=100, cap=1.0, block_rows=8).collect()) == 100
    assert max(spark.read.parquet(p).count() for p in session._written[since:]) < 12 * n


def test_donate_attributes_on_track_columns(spark):
    cols = ", ".join([f"lat{i} double" for i in range(1, 11)] + [f"lng{i} double" for i in range(1, 11)])
    schema = f"PDS_trip long, trip_id long, gear_code int, habitat_code int, {cols}"
    base = [-8.5 + 0.01 * i for i in range(10)] + [125.5 + 0.01 * i for i in range(10)]
    far = [v + 1.0 for v in base]
    near = [v + 0.001 for v in base]
    rows = [(1, 100, 3, 2, *base), (2, 200, 5, 1, *far),
            (3, None, None, None, *near), (4, None, 7, 7, *[v + 5 for v in base])]
    out = {r.PDS_trip: r for r in donate_attributes(spark.createDataFrame(rows, schema),
                                                    block_rows=1).collect()}
    assert (out[3].gear_code, out[3].habitat_code, out[3].donor_tripid) == (3, 2, 100)
    assert out[3].donor_distance == pytest.approx((20 * 0.001 ** 2) ** 0.5)
    assert (out[4].gear_code, out[4].donor_tripid) == (7, None)   # no donor within the cap
    assert out[1].donor_tripid is None and out[1].gear_code == 3   # linked trips unchanged
