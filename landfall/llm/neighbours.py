"""Approximate nearest neighbours on stable projections indexed by kd-trees.

Vectors are projected to ``dims`` dimensions by Gaussian (2-stable) vectors, so the
squared projected distance over the squared true distance is chi-square distributed with
``dims`` degrees of freedom. A kd-tree over a bounded sample of projections
(``sample`` vectors) cuts the projected space into cells; every vector is put into its
cell, and a cell with more than ``cell_rows`` vectors is dealt over several shards by a
hash. Each shard builds its own kd-tree.

A query takes leaves in order of their projected distance and verifies their vectors by
true distance. It stops by the chi-square test: once a leaf's projected distance is so
large that a vector as near as the k-th nearest found would have been projected nearer
with probability ``confidence``. It first searches its own cell; the distance found there
bounds which other cells have to be searched by the same test. Queries of a shard are
worked on in blocks of ``block``, so neither vectors nor queries of one task are unbounded.

Equal vectors are searched once and share the ids of their first k + 1 rows (more of one
vector can never be asked for), so a vector that a third of the rows hold is no hot cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of different lengths have no distance, so each length that a query
has is searched by itself; rows count, not ids: an id with several rows is found (and, as
a query, answered) as often; rows with a null id are found, last of equal distances, and
ask nothing; fewer candidates than k are returned all; ties go to smaller ids; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfall.llm.text import store


def chi_square_quantile(p: float, dims: int) -> float:
    """x with chi-square distribution function p, for an even number of dimensions."""
    def cdf(x):
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dims))


class Cells:
    """A kd-tree's top: splits of the projected space into cells with their regions."""

    def __init__(self, points: np.ndarray, count: int):
        dims = points.shape[1]
        self.splits: list[tuple[int, float, int, int]] = []   # dimension, value, left, right; cells are < 0
        lows, highs = [], []

        def build(p, lo, hi, n):
            spread = np.ptp(p, axis=0) if len(p) else np.zeros(dims)
            if n < 2 or len(p) < 2 or not spread.max():
                lows.append(lo)
                highs.append(hi)
                return -len(lows)
            d = int(spread.argmax())
            value = float(np.median(p[:, d]))
            left = p[:, d] <= value
            if left.all():
                value = float(p[:, d][p[:, d] < value].max())
                left = p[:, d] <= value
            at = len(self.splits)
            self.splits.append((d, value, 0, 0))
            cut_hi, cut_lo = hi.copy(), lo.copy()
            cut_hi[d] = cut_lo[d] = value
            a = build(p[left], lo, cut_hi, n // 2)
            b = build(p[~left], cut_lo, hi, n - n // 2)
            self.splits[at] = (d, value, a, b)
            return at

        self.root = build(points, np.full(dims, -np.inf), np.full(dims, np.inf), count)
        self.lows, self.highs = np.array(lows), np.array(highs)

    def of(self, p: np.ndarray) -> np.ndarray:
        """The cell of each projected point."""
        out = np.zeros(len(p), np.int64)
        todo = [(self.root, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            d, value, a, b = self.splits[node]
            left = p[rows, d] <= value
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance of one query to each cell."""
        gap = np.maximum(np.maximum(self.lows - q, q - self.highs), 0)
        return (gap ** 2).sum(axis=1)


def leaves(p: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of the leaves of a kd-tree over points p, and the leaves' bounds."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        spread = np.ptp(p[rows], axis=0)
        if len(rows) <= size or not spread.max():
            out.append(rows)
            continue
        d = spread.argmax()
        half = len(rows) // 2
        order = rows[np.argpartition(p[rows, d], half)]
        todo += [order[:half], order[half:]]
    return out, np.array([p[r].min(axis=0) for r in out]), np.array([p[r].max(axis=0) for r in out])


def search_shard(vectors: np.ndarray, first: np.ndarray, queries: np.ndarray, bounds: np.ndarray,
                 matrix: np.ndarray, k: int, ratio: float, leaf: int = 64):
    """Per query the rows and distances of its k nearest vectors found in a shard.
    ``first``: each vector's smallest id, which breaks ties."""
    p, q = vectors @ matrix, queries @ matrix
    rows, lo, hi = leaves(p, leaf)
    for i in range(len(queries)):
        gap = np.maximum(np.maximum(lo - q[i], q[i] - hi), 0)
        near = (gap ** 2).sum(axis=1)
        got_rows, got = np.zeros(0, np.int64), np.zeros(0)
        most = bounds[i]
        for l in np.argsort(near, kind="stable"):
            if near[l] > ratio * most * most:
                break
            r = rows[l]
            d = np.sqrt(((vectors[r] - queries[i]) ** 2).sum(axis=1))
            r, d = r[d <= most], d[d <= most]
            if not len(r):
                continue
            got_rows, got = np.concatenate([got_rows, r]), np.concatenate([got, d])
            if len(got) > k:
                best = np.lexsort((first[got_rows], got))[:k]
                got_rows, got = got_rows[best], got[best]
            if len(got) >= k:
                most = min(most, float(got.max()))
        yield got_rows, got


NO_ID = (1 << 63) - 1                # stands for a null id, and sorts last


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    d = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where("vec is not null").where(~bad).where(F.exists("vec", lambda x: x != 0))
    return d.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "vec")


def nearest(table: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            query_every: int = 100, dims: int = 8, confidence: float = 0.95, sample: int = 16_384,
            cell_rows: int = 8192, block: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest vectors found
    for every row whose id is divisible by ``query_every``."""
    d = store(usable(table, vec_id, vector), "ann-vectors")
    asks = (F.col("id") % query_every == 0) & (F.col("id") != NO_ID)
    lengths = d.groupBy(F.size("vec").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked")).where("asked > 0").orderBy("length").collect()
    if not lengths:
        return d.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                        F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, [nearest_of_length(
        d.where(F.size("vec") == x["length"]), asks, x["length"], x["n"], k, dims, confidence, sample, cell_rows, block, seed)
        for x in lengths])


def nearest_of_length(d: DataFrame, asks, length: int, total: int, k: int, dims: int, confidence: float, sample: int,
                      cell_rows: int, block: int, seed: int) -> DataFrame:
    """The nearest of the rows that ask among ``total`` vectors of one length."""
    matrix = projection(length, dims, seed)
    ratio = chi_square_quantile(confidence, dims)

    # equal vectors once, with the ids of their first k + 1 rows (one may be the query's own)
    smallest = Window.partitionBy("vec").orderBy("id")
    distinct = store(d.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
                     .groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-distinct")

    picked = distinct.select("vec", F.xxhash64("vec", F.lit(seed)).alias("h")).where(
        F.pmod("h", F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30)))
    some = np.array([r["vec"] for r in picked.select("vec").limit(2 * sample).collect()]).reshape(-1, length)
    cells = Cells(some @ matrix, max(1, min(len(some) // 8, -(-total // cell_rows))))

    def place(batches):
        for b in batches:
            p = np.stack(b["vec"].to_numpy()) @ matrix if len(b) else np.zeros((0, dims))
            yield b.assign(cell=cells.of(p))

    placed = store(distinct.mapInPandas(place, "vec array<double>, ids array<long>, cell long"), "ann-placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("shards"))
    vectors = store(placed.join(sizes, "cell").withColumn(
        "shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")).drop("shards"), "ann-shards")
    asked = d.where(asks).groupBy("id", "vec").agg(F.count(F.lit(1)).alias("rows"))
    queries = store(asked.select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()), "ann-queries")

    def search(wanted: DataFrame, name: str) -> DataFrame:
        """wanted: qid, vec, bound, cell. Returns qid, id, score: the k + 1 nearest ids."""
        w = wanted.join(sizes, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        blocks = w.groupBy("cell", "shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        w = w.join(blocks, ["cell", "shard"]).withColumn(
            "block", F.pmod(F.hash("qid"), F.col("blocks"))).select("cell", "shard", "block", "qid", "vec", "bound")
        v = vectors.join(blocks, ["cell", "shard"]).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "shard", "block", "vec", "ids")

        def one(key, points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = {"qid": [], "score": [], "ids": []}
            if len(points) and len(asks):
                x, ids = np.stack(points["vec"].to_numpy()), points["ids"].to_numpy()
                first = np.array([i[0] for i in ids])
                for qid, (rows, dist) in zip(asks["qid"], search_shard(
                        x, first, np.stack(asks["vec"].to_numpy()), asks["bound"].to_numpy(), matrix, k + 1, ratio)):
                    out["qid"] += [qid] * len(rows)
                    out["score"] += dist.tolist()
                    out["ids"] += [ids[r] for r in rows]
            return pd.DataFrame({"qid": pd.Series(out["qid"], dtype="int64"), "score": pd.Series(out["score"], dtype="float64"),
                                 "ids": pd.Series(out["ids"], dtype=object)})

        key = ["cell", "shard", "block"]
        found = v.groupBy(*key).cogroup(w.groupBy(*key)).applyInPandas(one, "qid long, score double, ids array<long>")
        return found.select("qid", "score", F.explode("ids").alias("id"))

    def best(found: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("qid").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def home(batches):
        for b in batches:
            p = np.stack(b["vec"].to_numpy()) @ matrix if len(b) else np.zeros((0, dims))
            yield b.assign(bound=np.inf, cell=cells.of(p))

    wanted = "vec array<double>, qid long, bound double, cell long"
    near = store(best(search(queries.mapInPandas(home, wanted), "home"), k + 1), "ann-home")

    def others(batches):
        for b in batches:
            p = np.stack(b["vec"].to_numpy()) @ matrix if len(b) else np.zeros((0, dims))
            own = cells.of(p)
            rows = []
            for i in range(len(b)):
                most = ratio * b["bound"].iloc[i] ** 2
                c = np.flatnonzero(cells.distances(p[i]) <= most)
                c = c[c != own[i]]
                rows.append(pd.DataFrame({"at": i, "cell": c}))
            if rows:
                r = pd.concat(rows)
                yield b.iloc[r["at"].to_numpy()].reset_index(drop=True).assign(cell=r["cell"].to_numpy())

    bound = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(
        F.lit(float("inf"))).alias("bound"))
    more = queries.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    far = search(more.select("vec", "qid", "bound").mapInPandas(others, wanted), "others")
    top = store(best(near.select("qid", "score", "id").unionByName(far.select("qid", "score", "id")), k + 1), "ann-top")

    # every query row with that vector, without itself: one row of its id and vector goes
    named = asked.withColumnRenamed("id", "query_id").join(queries, "vec").select("query_id", "qid", "rows")
    rows = named.join(top.drop("rank"), "qid").withColumn("same", (F.col("id") == F.col("query_id")) & (F.col("score") == 0))
    one = Window.partitionBy("query_id", "qid", "same").orderBy("score", "id")
    rows = rows.withColumn("nth", F.row_number().over(one)).where(~F.col("same") | (F.col("nth") > 1))
    order = Window.partitionBy("query_id", "qid").orderBy("score", "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")
