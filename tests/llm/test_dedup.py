"""Repeated strings and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from landfall.llm import components, simhash, suffix_dedup
from tests.llm.cases import TEXTS, by_row, frame, low, words


def cut(rows, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for _, x in raw:
        for k in range(len(x) - length + 1):
            seen[x[k:k + length]] = seen.get(x[k:k + length], 0) + 1
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(a for a, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=3, n=40):
    r = random.Random(seed)
    text = lambda k: " ".join("".join(r.choices("abcdeé😀", k=r.randint(2, 9))) for _ in range(k))
    shared = [text(25) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared)[r.randint(0, 40):], text(r.randint(0, 10))]
        rows.append((i, " ".join(parts), "en", "a"))
    rows += [(100, rows[3][1], "en", "a"), (101, rows[3][1] + "x", "en", "a"), (102, "ab" * 300, "en", "a"), (103, "=" * 500, "en", "a")]
    return rows


@pytest.mark.parametrize("bucket_rows", [32_768, 7])
def test_repeated_strings(spark, bucket_rows):
    rows = TEXTS + passages()
    got = suffix_dedup.remove_repeats(frame(spark, rows), 100, bucket_rows)
    assert by_row(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == cut(rows, 100)


def test_repeated_strings_in_cut_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)         # texts longer than a piece
    rows = passages(seed=5, n=20)
    got = suffix_dedup.remove_repeats(frame(spark, rows), 60)
    assert by_row(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == cut(rows, 60)


def test_multikey_sort():
    r = np.random.default_rng(0)
    rows = r.integers(0, 2, (300, 24)).astype(np.uint8)
    rows[50:90] = rows[10]
    order = suffix_dedup.multikey_sort(rows)
    assert [bytes(rows[i]) for i in order] == sorted(map(bytes, rows))
    shared = suffix_dedup.common_prefix(rows, order)
    for a, b, n in zip(order, order[1:], shared[1:]):
        same = rows[a] == rows[b]
        assert n == (24 if same.all() else same.argmin())


def fingerprint(text, shingle=3):
    w = words(low(text))
    s = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius):
    """Smallest index reachable over links of at most radius bits."""
    label = list(range(len(values)))
    changed = True
    v = np.array(values, dtype=np.uint64)
    while changed:
        changed = False
        for i in range(len(v)):
            least = min(label[j] for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius))
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_simhash(spark):
    r = random.Random(1)
    base = [r.choice("abcdefgh") * r.randint(1, 5) for _ in range(60)]
    rows = TEXTS + [(200 + i, " ".join(base[:r.randint(40, 60)] + ["end"] * r.randint(0, 2)), "en", "a") for i in range(60)]
    f = [fingerprint(t) for _, t, *_ in rows]
    label = groups(f, 3)
    ids = [x[0] for x in rows]
    least = {g: min((ids[i] for i in range(len(ids)) if label[i] == g and ids[i] is not None), default=None) for g in set(label)}
    want = sorted(((ids[i], f[i], least[label[i]]) for i in range(len(ids))), key=repr)
    got = simhash.near_duplicates(frame(spark, rows))
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got.collect()), key=repr) == want
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == sorted(least.values(), key=repr)


def test_crowded_buckets_are_hashed_again(spark):
    r = np.random.default_rng(2)
    near = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(
        np.uint64(1) << r.integers(0, 24, (400, 4)).astype(np.uint64), axis=1)
    values = sorted({int(x) for x in near} | {int(x) for x in r.integers(0, 1 << 63, 50)})
    fps = spark.createDataFrame([(x,) for x in values], "fp long")
    found = components.components(simhash.links(fps, 3, most=20))
    got = {x["node"]: x["label"] for x in found.collect()}
    want = groups(values, 3)
    assert all(got.get(v, v) == values[l] for v, l in zip(values, want))


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(4)
    levels = simhash.mask_tables(3)
    for _ in range(300):
        differ = sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        tables = [n for n, m in enumerate(levels[0][0]) if not m & differ]
        assert tables
        for level in levels[1:]:
            tables = [t * len(level[t]) + n for t in tables for n, m in enumerate(level[t]) if not m & differ]
            assert tables
    assert all(bin(m).count("1") >= 55 for ms in levels[-1] for m in ms)     # at most 512 values a bucket


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (70, 60)]
    edges += [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: label[n] for a, b in edges if a != b for n in (a, b)}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
