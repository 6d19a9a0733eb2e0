"""MinHash near-duplicates, centroid clustering and fill-in-the-middle against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landfall.llm import centroids, fill_middle, minhash
from tests.llm.cases import LONG, TEXTS, by_row, frame, low, words


# --- MinHash ----------------------------------------------------------------------------
def shingles(text, k=2):
    w = words(low(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, percent=80):
    """doc_id, set size, smallest id reachable and kept, by comparing all pairs."""
    s = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = [(d, len(s[i]), least.get(root(i)) if s[i] else d) for i, (d, *_) in enumerate(rows)]
    return sorted([(d, n, c, d == c) for d, n, c in out], key=repr)


def copies(seed, n, words_in, edits):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words_in)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10_000)}"
        rows.append((1000 * seed + i, " ".join(w), "en", "a"))
    return rows


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("most, block", [(4096, 1024), (5, 7)])      # 5, 7: crowded buckets, the finer sketch and blocks
def test_near_duplicates(spark, most, block):
    rows = TEXTS + copies(1, 60, 120, 9) + copies(2, 40, 30, 3) + copies(3, 30, 6, 1) + [(None, TEXTS[0][1], "en", "a")]
    got = minhash.near_duplicates(frame(spark, rows), most=most, block=block)
    assert by_row(got, COLUMNS) == near(rows)


def test_a_chain_of_links_is_one_component(spark):
    """Neighbours are linked, ends are not, and the crowd around them is just below the threshold."""
    w = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(w[8 * i:8 * i + 90]), "en", "a") for i in range(13)]
    shared = [f"s{i}" for i in range(70)]
    rows += [(100 + i, " ".join(shared + [f"o{i}-{k}" for k in range(12)]), "en", "a") for i in range(40)]
    want = near(rows)
    assert len({c for _, _, c, _ in want}) == 41 and by_row(minhash.near_duplicates(frame(spark, rows)), COLUMNS) == want


@pytest.mark.parametrize("size", [16, 128])
def test_every_coordinate_is_filled_and_agrees_as_often_as_sets_do(size):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 3, 10, 100, 3000)]
    assert (minhash.sketches(sets, size) != minhash.EMPTY).all()
    alone = [minhash.sketches([s], size)[0] for s in sets]
    assert (np.array(alone) == minhash.sketches(sets, size)).all()       # others of the batch change nothing
    same = []
    for _ in range(300):
        x = np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64))
        a, b = minhash.sketches([x[:90], x[10:]], size)                  # 80 of 100 in common
        same.append((a == b).mean())
    assert abs(np.mean(same) - 0.8) < 0.01 and np.std(same) < 1.2 * (0.16 / size) ** 0.5


def test_bands_miss_hardly_a_pair():
    r = np.random.default_rng(5)
    size, rows = minhash.LEVELS[0]
    for _ in range(400):
        x = np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64))
        a, b = minhash.band_keys(minhash.sketches([x[:90], x[10:]], size), rows)
        assert (a == b).any()


def test_empty_documents(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "a"), (2, " \n", "en", "a"), (None, "", "en", "a")]
    assert by_row(minhash.near_duplicates(frame(spark, rows)), COLUMNS) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


# --- centroids --------------------------------------------------------------------------
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("cluster", T.StringType()), T.StructField("v", T.IntegerType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "other", 3) for i, v in rows], VECTORS)


def clustered(rows, k, rounds, length, scale=64):
    """By Python integers, every distance anew."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (name(r[0]), r[0] is None, r[0] or 0, r[1]))[:k]
    now = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        now = [[sum(x) // len(x) for x in zip(*[v for (_, v), o in zip(kept, of) if o == j])] or now[j] for j in range(len(now))]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted([(i, o, d, inertia[o], sum(inertia.values()), digest[o]) for i, o, d in out], key=repr)


RESULT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
ODD = [(None, [0.5] * 4), (7, [0.25, float("nan"), 1.0, 1.0]), (8, [1.0, None, 1.0, 1.0]), (9, None), (10, []), (11, [1.0] * 3),
       (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [0.0] * 4), (13, [0.0] * 4), (13, [-0.001, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("n", [0, 2, 300])
def test_clusters(spark, n):
    r = np.random.default_rng(n)
    rows = ODD + [(100 + i, (r.normal(size=4) + 3 * (i % 3)).tolist()) for i in range(n)] + [(500, [2.0] * 4)] * (n // 3)
    got = centroids.with_inertia(*centroids.cluster(vectors(spark, rows), clusters=5, rounds=3, length=4))
    assert by_row(got, RESULT) == clustered(rows, 5, 3, 4)


def test_dot_products_are_updated_by_changes_only(spark):
    """After rounds of updates the stored dot products are those with the last centroids."""
    r = np.random.default_rng(1)
    rows = centroids.integers(vectors(spark, [(i, r.normal(size=6).tolist()) for i in range(50)]), "vec_id", "embedding", 6, 64)
    a, b = r.integers(-90, 90, (3, 6)), r.integers(-90, 90, (3, 6))
    b[1] = a[1]
    b[2, :5] = a[2, :5]
    both = centroids.assigned(centroids.assigned(rows, a, None), b, a).collect()
    for x in both:
        assert x.dots == (b @ np.array(x.v)).tolist() and x.square == sum(c * c for c in x.v)


def test_no_vectors_and_too_large_components(spark):
    none = centroids.with_inertia(*centroids.cluster(vectors(spark, ODD[1:6]), length=4))
    assert none.count() == 0 and none.columns == RESULT
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e300] * 4)]), length=4)


# --- fill in the middle -----------------------------------------------------------------
def filled(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(4)
    letters = ["a", "é", "漢", "😀", "<", ">", "P", "S", "M", "\n", "\x00"]
    rows = [(i, "".join(r.choices(letters, k=r.randint(1, 40))), "en", "a") for i in range(100, 400)]
    rows += [(401, "x<P>y", "en", "a"), (402, "<S>", "en", "a"), (403, "<" * 9, "en", "a"), (404, "漢" * 40_000 + "a" * 90_000, "en", "a"),
             (405, LONG + "é" * 70_000 + LONG, "en", "a"), (406, "aé" * 60_000, "en", "a")]
    return TEXTS + rows


def test_fill_in_the_middle(spark):
    rows = odd_texts()
    t = fill_middle.transform(frame(spark, rows))
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert by_row(t, cols) == sorted([filled(i, x) for i, x, *_ in rows], key=repr)
    back = t.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert by_row(back, ["doc_id", "text"]) == sorted([(i, x or "") for i, x, *_ in rows], key=repr)
    assert fill_middle.transform(frame(spark, [])).count() == 0


def test_boundaries_of_every_container_kind():
    r = random.Random(6)
    kinds = set()
    mixed = "".join(r.choices(["a", "é", "漢", "😀"], k=60_000))
    sparse = "😀" * 30_000 + "é" * 10
    for text in ("", "abc", "a" * 200_000, mixed, sparse, "é" * 5_000 + mixed + "a" * 70_000, "a" * 65_535, "a" * 65_536, "漢" * 21_845 + "a"):
        raw = text.encode()
        b = fill_middle.Boundaries(raw)
        kinds |= {type(c).__name__ for c in b.containers}
        assert len(b) == len(text) + 1 and b.select(len(text)) == len(raw)
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        for k in [0, len(text), *[r.randint(0, len(text)) for _ in range(200)]]:
            assert b.select(k) == ends[k]
    few = fill_middle.container(np.array([3, 70, 500, 9_000]))
    assert type(few).__name__ == "Array" and [few.select(k) for k in range(4)] == [3, 70, 500, 9_000]
    assert kinds == {"Bitmap", "Runs", "Array"}
