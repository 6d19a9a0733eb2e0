"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: the 64-bit hashes of a document's word shingles vote on each bit. Two
fingerprints are linked if at most ``radius`` bits differ.

Covering: bit i is given the non-zero vector 1 + i mod (2^(r+1) - 1) of r + 1 bits; table
v hides the bits whose vector is orthogonal to v. The vectors of any r differing bits
span at most r dimensions, so some v is orthogonal to all of them: every pair within the
radius has equal keys in some table. No pair is missed, whatever the data.

Only distinct fingerprints are hashed, so exact copies never meet. A bucket with more
than ``most`` distinct fingerprints is hashed again on the bits that its table hides: in
``groups`` runs, of which every choice of r stays hidden, which again covers all pairs
within the radius. The last level hides so few bits that a bucket cannot hold more than
512 values, so no group is unbounded and none is left out. Buckets are searched for
links by following them from value to value, each only against values not yet reached:
a spanning forest comes out, not all pairs. Components are found on the links as rows.

Defined cases: null text or text without a word has fingerprint 0 and is linked like any
other; one or two words are one shingle; null ids take part, but a component's id is the
smallest non-null one (null if there is none); repeated rows are in one component; an
empty table gives an empty result; other columns are ignored by :func:`near_duplicates`
and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.components import components
from landfall.llm.text import distinct_rows, lower_ascii, row_keys, store, words

BITS = 64
GROUPS = (6, 6)                      # runs of hidden bits at the second and third level


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per list of 64-bit hashes the number whose bits are set in over half of them."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    if not len(values):
        return out
    bit_of = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    step = 1 << 12                                   # documents at once
    for a in range(0, len(n), step):
        b = min(a + step, len(n))
        part = values[offsets[a]:offsets[b]].view(np.uint8).reshape(-1, 8)
        owner = np.repeat(np.arange(b - a, dtype=np.int64) * 256, n[a:b])
        for byte in range(8):
            seen = np.bincount(owner + part[:, byte], minlength=(b - a) * 256).reshape(b - a, 256) @ bit_of
            for bit in range(8):
                out[a:b] |= (2 * seen[:, bit] > n[a:b]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the fingerprint (a signed long) of every row."""
    d = docs.select(*keep, words(lower_ascii(F.col("text"))).alias("_w"))
    n = F.size("_w")
    rolling = F.transform("_w", lambda x, i: F.xxhash64(F.concat_ws(
        " ", x, *[F.get("_w", i + k) for k in range(1, shingle)])))
    d = d.select(*keep, F.when(n == 0, F.array().cast("array<long>")).when(
        n < shingle, F.array(F.xxhash64(F.concat_ws(" ", "_w")))).otherwise(
        F.slice(rolling, F.lit(1), F.greatest(n - (shingle - 1), F.lit(1)))).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(len(keep))
            values = np.asarray(h.values).view(np.uint64)
            fp = majority(values, np.asarray(h.offsets))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """Kept bits of the 2^(radius+1) - 1 tables."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def finer_masks(mask: int, groups: int, radius: int) -> list[int]:
    """Masks that keep, beyond ``mask``, all but ``radius`` of ``groups`` runs of its hidden bits."""
    hidden = [i for i in range(BITS) if not mask >> i & 1]
    runs = [hidden[len(hidden) * g // groups:len(hidden) * (g + 1) // groups] for g in range(groups)]
    every = (1 << BITS) - 1
    return [every & ~sum(1 << i for r in hide for i in r) for hide in combinations(runs, min(radius, groups))]


def mask_tables(radius: int) -> list[list[list[int]]]:
    """Per level, per table of the level above, its masks; level 0 has one list."""
    levels = [[covering_masks(radius)]]
    for groups in GROUPS:
        levels.append([finer_masks(m, groups, radius) for masks in levels[-1] for m in masks])
    return levels


def bucketed(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """table, key and fp of each row of (table, fp) under the masks of its table, with
    the number of fingerprints of the bucket; buckets of one are left out."""
    per = len(masks[0])
    all_masks = F.array(*[F.lit(signed(m)) for ms in masks for m in ms])
    if len(masks) == 1:
        masked = rows.select("fp", F.posexplode(all_masks).alias("next", "mask"))
    else:
        flat = rows.sparkSession.range(1).select(F.posexplode(all_masks).alias("next", "mask"))
        flat = flat.withColumn("table", F.floor(F.col("next") / per).cast("int"))
        masked = rows.join(F.broadcast(flat), "table")        # at most 6,000 fixed rows
    keyed = masked.select(F.col("next").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()
    size = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(size, ["table", "key"])


def link_sorted(radius: int):
    """Links inside the buckets of a partition sorted by table and key."""
    def in_bucket(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = fp
        while len(left) > 1:
            reached, left = left[:1], left[1:]
            while len(reached) and len(left):
                at, reached = reached[0], reached[1:]
                near = np.bitwise_count(left ^ at) <= radius
                if near.any():
                    found = left[near]
                    yield np.full(len(found), at), found
                    reached, left = np.concatenate([reached, found]), left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in chain_end(batches):
            if b is None:
                if rest is None:
                    return
                t, k, f = rest
                whole = len(f)
            else:
                t, k, f = (np.asarray(c) for c in b.columns[:3])
                f = f.view(np.uint64)
                if rest is not None:
                    t, k, f = (np.concatenate(x) for x in zip(rest, (t, k, f)))
                new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
                whole = int(new[-1]) if len(new) else 0   # the last bucket may go on
            rest = (t[whole:], k[whole:], f[whole:])
            if not whole:
                continue
            t, k, f = t[:whole], k[:whole], f[:whole]
            start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            n = np.diff(np.r_[start, whole])
            pair = start[n == 2]
            close = np.bitwise_count(f[pair] ^ f[pair + 1]) <= radius
            a, c = [f[pair][close]], [f[pair + 1][close]]
            for s, m in zip(start[n > 2], n[n > 2]):
                for x, y in in_bucket(f[s:s + m]):
                    a.append(x)
                    c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, c)], names=["a", "b"])

    def chain_end(batches):
        yield from batches
        yield None
    return run


def links(fps: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """a, b: links that connect whatever distinct fingerprints (column fp) are within
    ``radius`` bits of each other, directly or by a path of such links."""
    rows, out = fps.select(F.lit(0).alias("table"), "fp"), []
    for level, masks in enumerate(mask_tables(radius)):
        b = store(bucketed(rows, masks), f"simhash-buckets-{level}")
        last = level == len(GROUPS)
        small = b if last else b.where(F.col("n") <= most)
        out.append(small.repartition("table", "key").sortWithinPartitions("table", "key").select(
            "table", "key", "fp").mapInArrow(link_sorted(radius), "a long, b long"))
        if last:
            break
        rows = b.where(F.col("n") > most).select("table", "fp")
        if rows.isEmpty():
            break
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, most: int = 4096,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its component) of every row,
    and the columns ``keep``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    f = store(fingerprints(d, shingle, ["doc_id", *keep]), "simhash")
    per = store(f.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(per, radius, most))
    labelled = per.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    group = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = store(labelled.join(group, "label").select("fp", "label", "component_id"), "simhash-named")
    return f.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id
    (null ids last; rows with equal ids by a hash of the row; equal rows once)."""
    keyed = row_keys(docs)
    n = near_duplicates(keyed, shingle, radius, keep=("_llm_k1", "_llm_k2"))
    first = n.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_llm_k1", "_llm_k2")).alias("w"))
    stay = first.select("w._llm_k1", "w._llm_k2")
    return distinct_rows(keyed, docs.columns).join(stay, ["_llm_k1", "_llm_k2"], "left_semi").select("row.*")
