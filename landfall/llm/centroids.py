"""Clustering around centroids with an incremental distance matrix, in exact integers.

Each vector's components become integers, and its row of the matrix holds its dot product
with every centroid, so its squared distance to centroid c is v.v - 2 v.c + c.c. The rows
are stored. When the centroids move, only the components that changed are multiplied:
v.c' = v.c + the sum of v[i] * (c'[i] - c[i]) over the changed i of that centroid; then
the nearest is chosen again. Nothing is rounded, so the result depends on neither order
nor partitioning.

A round is one pass over the stored rows without a shuffle, then sums per cluster, which
every task adds up first: a cluster that holds most rows is a few numbers per task. Only
the centroids (clusters x length) and their sums reach the driver. Every round is written
to the shared folder.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components take no part; components beyond 2^27 after scaling raise an error, for their
distances would pass 64 bits; an id's hash counts null as the empty text; rows that tie as first centroids are
taken in order of id and vector, repeated rows one by one; fewer rows than clusters give
fewer clusters; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import store

LARGEST = 1 << 27


def integers(table: DataFrame, vec_id: str, vector: str, length: int, scale: int) -> DataFrame:
    """vec_id and v (integers) of the rows that take part."""
    d = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.size("x") == length).where(~bad)
    large = F.exists("x", lambda x: F.abs(x) * scale > LARGEST)
    x = F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("x"))
    return d.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.int64)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


STATE = "vec_id long, v array<int>, square long, dots array<long>, cluster int, distance long"


def assigned(rows: DataFrame, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The matrix rows for centroids ``now``: from vectors, or from the matrix rows for ``before``."""
    own = (now * now).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), now.shape[1])
            if before is None:
                square, dots = (v * v).sum(axis=1), v @ now.T
            else:
                square, dots = np.asarray(b.column(2)), matrix(b.column(3), len(now))
                for k in range(len(now)):
                    moved = np.flatnonzero(now[k] != before[k])
                    if len(moved):
                        dots[:, k] += v[:, moved] @ (now[k] - before[k])[moved]
            distance = square[:, None] - 2 * dots + own
            cluster = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(square), lists(dots), pa.array(cluster.astype(np.int32)),
                pa.array(distance[np.arange(len(v)), cluster])], names=[x.split()[0] for x in STATE.split(", ")])

    return rows.mapInArrow(run, STATE)


def cluster_sums(rows: DataFrame, clusters: int, length: int) -> tuple[list[int], np.ndarray]:
    """Vectors per cluster and their component sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(clusters, np.int64), np.zeros((clusters, length), np.int64)
        for b in batches:
            cluster, v = np.asarray(b.column(0)), matrix(b.column(1), length)
            n += np.bincount(cluster, minlength=clusters)
            for k in np.unique(cluster):
                total[k] += v[cluster == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(clusters, dtype=np.int32), length + 1)),
            pa.array(np.tile(np.arange(-1, length, dtype=np.int32), clusters)),
            pa.array(np.column_stack([n, total]).ravel())], names=["cluster", "at", "part"])

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster int, at int, part long")
    got = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    n, total = [0] * clusters, [[0] * length for _ in range(clusters)]
    for r in got:
        if r["at"] < 0:
            n[r["cluster"]] = int(r["part"])
        else:
            total[r["cluster"]][r["at"]] = int(r["part"])
    return n, total


def cluster(table: DataFrame, clusters: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: int = 1,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared, to its final centroid) of every vector, and
    the centroids. The first centroids are the vectors with the smallest hashes of their ids."""
    rows = integers(table, vec_id, vector, length, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.orderBy(name, F.col("vec_id").asc_nulls_last(), "v").limit(clusters).collect()
    now = np.array([r["v"] for r in first], np.int64).reshape(-1, length)
    if not len(now):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state = store(assigned(rows, now, None), "centroid-rows")
    for _ in range(rounds):
        n, total = cluster_sums(state, len(now), length)
        before = now
        now = np.array([[x // n[k] for x in total[k]] if n[k] else before[k] for k in range(len(now))], np.int64)
        state = store(assigned(state, now, before), "centroid-rows")
    return state.select("vec_id", "cluster", "distance"), now


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256."""
    k = len(centroids)
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance",
                        of([F.lit(per.get(i, 0)).cast("long") for i in range(k)] or [F.lit(0).cast("long")]).alias("cluster_inertia"),
                        F.lit(sum(per.values())).cast("long").alias("inertia"),
                        of([F.lit(x) for x in digest] or [F.lit("")]).alias("centroid_sha256"))
