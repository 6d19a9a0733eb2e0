"""Nearest-track donor matching and its repeated hold-out validation.

A tracked trip without a reported trip gets the gear and habitat of the
nearest linked trip in the 20-dimensional space of its track signature
(10 latitudes, 10 longitudes), if that donor lies within ``cap``.

Plan, exact for every pair within ``cap``:

* Blocking: a pair within ``cap`` differs by at most ``cap`` in every
  coordinate, so on a grid of cell size ``cap`` over two coordinates the donor
  lies in the query's cell or one of its 8 neighbours. Each query visits those
  9 cells; nothing farther is ever compared.
* Equal donors count once (the smallest id, with its values).
* Growing radius: the cell size starts so small that the fullest cell holds about
  ``block_rows`` donors. A query matched within the present radius is done (nothing
  nearer can lie outside the cells it visited); only the others go on to the doubled
  radius, up to ``cap``. Where tracks are dense, queries are answered in small cells, so
  the work grows about as the rows do, not as their square. One fullest-cell count
  fixes the number of radii; there is one code path whatever it is.
* Hot cells: per-cell counts set a salt so that a cell with many queries or
  donors is split into blocks of at most ``block_rows`` on each side; every
  query block meets every donor block of its cell. Work per task is bounded,
  no pair rows are materialised.
* Inside a block numpy computes the distances of a chunk of queries to all
  donors and keeps each query's best; a final ``min`` over (distance, donor id)
  across blocks picks the nearest, ties to the smallest donor id.
* The validation's repeats are bits of a row, not rows: distances are measured once for all
  repeats, and a query keeps only the donors that are its nearest in some repeat.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from landfall.session import materialize


def _best_in_block(cap: float, q_extra, d_extra, by, dims: int, chunk: int = 1024):
    qcols = [f"_q{i}" for i in range(dims)]
    dcols = [f"_d{i}" for i in range(dims)]
    cols = by + ["_qid", "_did", "_dist"] + q_extra + d_extra

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({c: [] for c in cols})
        did = d["_did"].to_numpy()
        order = np.argsort(did, kind="stable")          # ties go to the smallest id
        did = did[order]
        dm = np.column_stack([d[c].to_numpy(dtype=float) for c in dcols])[order]
        qm = np.column_stack([q[c].to_numpy(dtype=float) for c in qcols])
        best_i = np.empty(len(qm), dtype=np.int64)
        best_d = np.empty(len(qm))
        dn = (dm * dm).sum(axis=1)
        for s in range(0, len(qm), chunk):
            qc = qm[s:s + chunk]
            qn = (qc * qc).sum(axis=1)
            # Squared distances by one matrix product; rounding error is at most
            # a few ulps of |q|^2 + |d|^2, so every donor within ``tol`` of the
            # row minimum is re-measured exactly and the exact minimum wins
            # (ties to the smallest donor id, as donors are sorted by id).
            approx = qn[:, None] + dn[None, :] - 2.0 * (qc @ dm.T)
            lo = approx.min(axis=1)
            tol = 1e-12 * (qn + dn.max()) + 1e-300
            ii, jj = np.nonzero(approx <= (lo + tol)[:, None])
            diff = qc[ii] - dm[jj]
            exact = np.einsum("ij,ij->i", diff, diff)
            pick = np.lexsort((jj, exact, ii))
            first = np.ones(len(pick), dtype=bool)
            first[1:] = ii[pick][1:] != ii[pick][:-1]
            pick = pick[first]
            best_i[s + ii[pick]] = jj[pick]
            best_d[s + ii[pick]] = np.sqrt(exact[pick])
        ok = best_d <= cap
        hit = best_i[ok]
        out = {c: q[c].to_numpy()[ok] for c in by + ["_qid"]}
        out["_did"] = did[hit]
        out["_dist"] = best_d[ok]
        for c in q_extra:
            out[c] = q[c].to_numpy()[ok]
        for c in d_extra:
            out[c] = d[c].to_numpy()[order][hit]
        return pd.DataFrame(out, columns=cols)
    return run


def by_only(by, keys):
    return [c for c in by if c not in keys]


def grid(df: DataFrame, features: str, dims, radius: float) -> DataFrame:
    """Cells of size ``radius`` on the blocking coordinates."""
    return df.withColumns({f"_c{j}": F.floor(F.element_at(F.col(features), i + 1) / F.lit(radius)).cast("long")
                           for j, i in enumerate(dims)})


def blocks(q: DataFrame, d: DataFrame, radius: float, by, block_dims, block_rows: int, dims: int,
           d_extra, q_extra):
    """Both sides in blocks that hold every pair within ``radius``, and the blocks' keys."""
    cells = [f"_c{j}" for j in range(len(block_dims))]
    keys = by + cells
    d = grid(d, "_df", block_dims, radius)
    offsets = list(itertools.product((-1, 0, 1), repeat=len(cells)))
    q = grid(q, "_qf", block_dims, radius).withColumn(
        "_off", F.explode(F.array(*[F.array(*[F.lit(o) for o in off]) for off in offsets])))
    q = q.withColumns({c: F.col(c) + F.col("_off")[j] for j, c in enumerate(cells)}).drop("_off")
    # Rows per cell on each side, in one aggregation over both sides' keys; only
    # cells holding queries and donors remain.
    tagged = (q.select(*keys, F.lit(1).alias("_isq"))
              .unionByName(d.select(*keys, F.lit(0).alias("_isq"))))
    sizes = (tagged.groupBy(*keys)
             .agg(F.sum("_isq").alias("_nq"), F.sum(1 - F.col("_isq")).alias("_nd"))
             .filter((F.col("_nq") > 0) & (F.col("_nd") > 0))
             .select(*keys, F.ceil(F.col("_nq") / block_rows).cast("int").alias("_sq"),
                     F.ceil(F.col("_nd") / block_rows).cast("int").alias("_sd")))
    q = (q.join(sizes, keys, "inner")
         .withColumn("_i", F.pmod(F.xxhash64("_qid"), F.col("_sq")).cast("int"))
         .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_sd") - 1)))
         .drop("_sq", "_sd"))
    d = (d.join(sizes, keys, "inner")
         .withColumn("_j", F.pmod(F.xxhash64("_did"), F.col("_sd")).cast("int"))
         .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1)))
         .drop("_sq", "_sd"))
    gkeys = keys + ["_i", "_j"]
    # Features as plain double columns: Arrow hands numpy a matrix, no per-row arrays.
    q = q.select(*gkeys, *by_only(by, gkeys), "_qid", *q_extra,
                 *[F.col("_qf")[i].alias(f"_q{i}") for i in range(dims)])
    d = d.select(*gkeys, *by_only(by, gkeys), "_did", *d_extra,
                 *[F.col("_df")[i].alias(f"_d{i}") for i in range(dims)])
    return q, d, gkeys


def within(q: DataFrame, d: DataFrame, radius: float, by, block_dims, block_rows: int, dims: int,
           d_extra, q_extra) -> DataFrame:
    """Per query its nearest donor within ``radius``: by, _qid, _did, _dist, extras."""
    q, d, gkeys = blocks(q, d, radius, by, block_dims, block_rows, dims, d_extra, q_extra)
    qs, ds = q.schema, d.schema
    out_schema = T.StructType(
        [qs[c] for c in by] + [T.StructField("_qid", qs["_qid"].dataType),
                               T.StructField("_did", ds["_did"].dataType),
                               T.StructField("_dist", T.DoubleType())]
        + [qs[c] for c in q_extra] + [ds[c] for c in d_extra])
    res = (q.groupBy(*gkeys).cogroup(d.groupBy(*gkeys))
           .applyInPandas(_best_in_block(radius, q_extra, d_extra, by, dims), schema=out_schema))
    best = (res.groupBy(*by, "_qid")
            .agg(F.min(F.struct("_dist", "_did", *d_extra, *q_extra)).alias("_b")))
    return best.select(*by, "_qid", *[F.col(f"_b.{c}").alias(c) for c in ("_did", "_dist", *d_extra, *q_extra)])


def radius_halvings(d: DataFrame, cap: float, by, block_dims, block_rows: int) -> int:
    """How often ``cap`` is halved for the first radius, by the fullest cell of donors."""
    cells = [f"_c{j}" for j in range(len(block_dims))]
    fullest = grid(d, "_df", block_dims, cap).groupBy(*by, *cells).count().agg(F.max("count")).first()[0] or 0
    halvings = 0
    while fullest > block_rows << (halvings * len(block_dims)) and halvings < 16:
        halvings += 1
    return halvings


def nearest_donor(queries: DataFrame, donors: DataFrame, *, key: str = "trip_id",
                  features: str = "features", carry=("gear_code", "habitat_code"),
                  query_carry=(), cap: float = 0.2, by=(), block_dims=(0, 1),
                  block_rows: int = 2048, keep_unmatched: bool = True,
                  donor_key: str = "donor_tripid", distance: str = "donor_distance",
                  dims: int = 20) -> DataFrame:
    """Nearest donor within ``cap`` for each query (Euclidean over the first
    ``dims`` elements of ``features``).

    Returns ``by``, ``key``, ``donor_key``, ``distance``, the donor's ``carry``
    columns and the query's ``query_carry`` columns prefixed ``query_``. With
    ``keep_unmatched`` a query without a donor within ``cap`` is kept with NULLs.
    """
    by, carry, query_carry = list(by), list(carry), list(query_carry)
    q_extra = [f"query_{c}" for c in query_carry]
    d_extra = list(carry)
    q = queries.select(*by, F.col(key).alias("_qid"), F.col(features).alias("_qf"),
                       *[F.col(c).alias(f"query_{c}") for c in query_carry])
    d = (donors.groupBy(*by, F.col(features).alias("_df"))
         .agg(F.min(F.struct(F.col(key).alias("_did"), *d_extra)).alias("_d"))
         .select(*by, "_df", "_d.*"))
    halvings = radius_halvings(d, cap, by, block_dims, block_rows)
    if halvings:
        q, d = materialize(q, "donor-queries"), materialize(d, "donors")
    best = None
    for step in range(halvings, -1, -1):
        found = within(q, d, cap / (1 << step), by, block_dims, block_rows, dims, d_extra, q_extra)
        if step:
            found = materialize(found, "donor-found")
            done = found.select(*[F.col(c).alias(f"_m{c}") for c in (*by, "_qid")])
            same = [F.col(c).eqNullSafe(F.col(f"_m{c}")) for c in (*by, "_qid")]
            q = materialize(q.join(done, same, "left_anti"), "donor-queries")
        best = found if best is None else best.unionByName(found)
    best = best.select(*by, F.col("_qid").alias(key), F.col("_did").alias(donor_key),
                       F.col("_dist").alias(distance), *d_extra, *q_extra)
    if not keep_unmatched:
        return best
    base = queries.select(*by, key, *[F.col(c).alias(f"query_{c}") for c in query_carry])
    return base.join(best.drop(*q_extra), by + [key], "left")


def track_signature(pds_trips: DataFrame, out: str = "features") -> DataFrame:
    """The 20-number track signature (lat1..lat10, then lng1..lng10) as one array."""
    cols = [f"lat{i}" for i in range(1, 11)] + [f"lng{i}" for i in range(1, 11)]
    return pds_trips.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


# Grid coordinates for track signatures: the mid-trip position (lat5, lng5).
# Any pair of coordinates gives the same exact answer; start positions would
# put every trip of a harbour into one cell, mid-trip positions spread them.
TRACK_BLOCK_DIMS = (4, 14)


def donate_attributes(pds_trips: DataFrame, cap: float = 0.2, block_rows: int = 2048,
                      block_dims=TRACK_BLOCK_DIMS) -> DataFrame:
    """Fill gear and habitat of tracked trips that have no reported trip from
    the nearest linked tracked trip within ``cap`` (its reported trip id and the
    distance are kept as ``donor_tripid`` and ``donor_distance``). Linked trips
    and trips without a donor keep their own values."""
    sig = track_signature(pds_trips)
    donors = (sig.filter(F.col("trip_id").isNotNull())
              .select(F.col("trip_id").alias("_donor"), "features", "gear_code", "habitat_code"))
    queries = sig.filter(F.col("trip_id").isNull()).select("PDS_trip", "features")
    nn = nearest_donor(queries, donors.withColumnRenamed("_donor", "PDS_trip"), key="PDS_trip",
                       cap=cap, block_rows=block_rows, keep_unmatched=False,
                       donor_key="_dt", distance="_dd", block_dims=block_dims)
    nn = nn.select("PDS_trip", "_dt", "_dd", F.col("gear_code").alias("_g"),
                   F.col("habitat_code").alias("_h"))
    j = pds_trips.join(nn, "PDS_trip", "left")
    return j.withColumns({
        "gear_code": F.coalesce("_g", "gear_code"),
        "habitat_code": F.coalesce("_h", "habitat_code"),
        "donor_tripid": F.col("_dt").cast("long"),
        "donor_distance": F.col("_dd"),
    }).drop("_g", "_h", "_dt", "_dd")


def train_split(key, rep, of: int = 10, train: int = 8):
    """Repeatable hold-out split: a row is in the training part of repeat ``rep`` when a
    hash of both (the first 8 hex digits of the md5 of ``key-rep``) mod ``of`` is below
    ``train``. Every repeat draws another part."""
    key, rep = (F.col(c) if isinstance(c, str) else c for c in (key, rep))
    h = F.md5(F.concat_ws("-", key.cast("string"), rep.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % of < train


WORD = 62       # repeats in one long


def words(name: str, reps: int) -> list[str]:
    """Columns that hold one bit for each repeat."""
    return [f"{name}{w}" for w in range(-(-reps // WORD))]


def train_bits(key: str, reps: int, split) -> dict:
    """The repeats in whose training part a row is, as bits."""
    def word(start: int):
        def add(acc, rep):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), rep - start)
            return F.when(train_split(F.col(key), rep, *split), acc.bitwiseOR(bit)).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(start), F.lit(min(reps, start + WORD) - 1)), F.lit(0).cast("long"), add)
    return {c: word(w * WORD) for w, c in enumerate(words("_t", reps))}


def reps_of(cols, reps: int):
    """The repeats whose bits are set, as an array."""
    bits = F.array(*cols)
    return F.filter(F.sequence(F.lit(0), F.lit(reps - 1)), lambda rep: F.call_function(
        "shiftright", F.get(bits, F.floor(rep / WORD).cast("int")), rep % WORD).bitwiseAND(F.lit(1)) == 1)


def any_bit(cols):
    return functools.reduce(lambda a, b: a | b, [F.col(c) != 0 for c in cols])


def first_bits(df: DataFrame, by, order, cols) -> DataFrame:
    """Each bit stays with the first row of its group that has it; rows without a bit go."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = {c: F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(c).over(before), F.lit(0).cast("long"))))
            for c in cols}
    return df.select(*[left[c].alias(c) if c in left else c for c in df.columns]).filter(any_bit(cols))


def _first_in_block(radius: float, need, has, carry, dims: int, near: int = 8, cells: int = 1 << 22):
    """Per query the donors that are the nearest of the block in a repeat that it needs."""
    qcols = [f"_q{i}" for i in range(dims)]
    dcols = [f"_d{i}" for i in range(dims)]
    cols = ["_qid", "_did", "_dist", *carry, *need]

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({c: [] for c in cols})
        d = d.sort_values(["_did", *carry], kind="stable", na_position="first")     # ties go to the smallest id
        dm = np.column_stack([d[c].to_numpy(dtype=float) for c in dcols])
        qm = np.column_stack([q[c].to_numpy(dtype=float) for c in qcols])
        bits = np.column_stack([d[c].to_numpy(dtype=np.int64) for c in has])
        open_ = np.column_stack([q[c].to_numpy(dtype=np.int64) for c in need])
        dn = (dm * dm).sum(axis=1)
        out = []

        def take(at, qc, approx, limit, sure):
            """Deal the open repeats of queries ``at`` to donors in order of distance, among
            those below ``limit``; a pair counts if it is measured at ``sure`` at most."""
            ii, jj = np.nonzero(approx <= limit[:, None])
            diff = qc[ii] - dm[jj]
            exact = np.einsum("ij,ij->i", diff, diff)
            ok = (exact <= sure[ii]) & (np.sqrt(exact) <= radius)
            ii, jj, exact = ii[ok], jj[ok], exact[ok]
            order = np.lexsort((jj, exact, ii))
            ii, jj, exact = ii[order], jj[order], exact[order]
            n = np.bincount(ii, minlength=len(at))
            start = np.cumsum(n) - n
            for k in range(int(n.max(initial=0))):
                has_k = np.nonzero((n > k) & open_[at].any(axis=1))[0]
                if not len(has_k):
                    break
                e = start[has_k] + k
                new = open_[at[has_k]] & bits[jj[e]]
                open_[at[has_k]] &= ~new
                hit = new.any(axis=1)
                out.append((at[has_k[hit]], jj[e[hit]], np.sqrt(exact[e[hit]]), new[hit]))

        step = max(1, cells // len(dm))
        edges = np.arange(0, len(dm), max(1, len(dm) // 64))
        for s in range(0, len(qm), step):
            at = np.arange(s, min(s + step, len(qm)))
            qc = qm[at]
            qn = (qc * qc).sum(axis=1)
            # Squared distances by one matrix product, wrong by far less than ``tol`` / 2:
            # pairs that may count are measured exactly.
            approx = qn[:, None] + dn[None, :] - 2.0 * (qc @ dm.T)
            tol = 1e-12 * (qn + dn.max()) + 1e-300
            whole = np.full(len(at), radius * radius * (1 + 1e-12)) + tol
            # The ``near``-th least minimum of the stripes bounds the ``near`` nearest donors;
            # queries that need more take all donors within the radius.
            close = whole
            if len(edges) > near:
                least = np.minimum.reduceat(approx, edges, axis=1)
                close = np.minimum(whole, np.partition(least, near - 1, axis=1)[:, near - 1] + tol)
            take(at, qc, approx, close, close - tol / 2)
            rest = np.nonzero(open_[at].any(axis=1) & (close < whole))[0]
            if len(rest):
                take(at[rest], qc[rest], approx[rest], whole[rest], np.full(len(rest), np.inf))
        if not out:
            return pd.DataFrame({c: [] for c in cols})
        i, j, dist, new = (np.concatenate(x) for x in zip(*out))
        res = {"_qid": q["_qid"].to_numpy()[i], "_did": d["_did"].to_numpy()[j], "_dist": dist}
        res |= {c: d[c].to_numpy()[j] for c in carry}
        res |= {c: new[:, w] for w, c in enumerate(need)}
        return pd.DataFrame(res, columns=cols)
    return run


def first_within(q: DataFrame, d: DataFrame, radius: float, block_dims, block_rows: int, dims: int,
                 need, has, carry) -> DataFrame:
    """Per query and repeat that it needs the nearest donor within ``radius``, as one row for each
    such donor with the repeats' bits: _qid, _did, _dist, carry, need."""
    q, d, gkeys = blocks(q, d, radius, [], block_dims, block_rows, dims, [*carry, *has], need)
    out_schema = T.StructType(
        [q.schema["_qid"], d.schema["_did"], T.StructField("_dist", T.DoubleType())]
        + [d.schema[c] for c in carry] + [T.StructField(c, T.LongType()) for c in need])
    res = (q.groupBy(*gkeys).cogroup(d.groupBy(*gkeys))
           .applyInPandas(_first_in_block(radius, need, has, carry, dims), schema=out_schema))
    return first_bits(res, ["_qid"], ["_dist", "_did", *carry], need)


def validate_donor(signatures: DataFrame, reps: int = 100, cap: float = 0.2, *,
                   key: str = "trip_id", features: str = "features", split=(10, 8),
                   block_rows: int = 16384, block_dims=(0, 1), dims: int = 20) -> DataFrame:
    """Per repeat: split the linked trips into training and query parts, match
    each query to its nearest training trip, drop queries farther than ``cap``
    or whose habitat or gear never occurs in the training part, and report the
    kept count and the share of gear and of habitat matches.

    A row is never repeated by the repeats: whether it is in the training part of each is a
    bit, distances are measured once for all repeats, and a query keeps the few donors that are
    its nearest in some repeat, with those repeats' bits. Equal signatures are searched once.
    """
    codes = ["gear_code", "habitat_code"]
    need, has = words("_n", reps), words("_t", reps)
    vector = F.transform(F.slice(F.col(features), 1, dims), lambda x: x.cast("double") + F.lit(0.0))   # -0.0 is 0.0
    rows = signatures.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *codes, vector.alias("_f"))
    two = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("_f"), F.xxhash64(F.lit(1), "_f"))]
    rows = rows.select("_id", *codes, "_f", F.unhex(F.concat(*two)).alias("_v"),
                       *[c.alias(n) for n, c in train_bits("_id", reps, split).items()])
    out_of = [F.bitwise_not(F.col(t)).bitwiseAND(F.lit((1 << min(WORD, reps - w * WORD)) - 1).cast("long")).alias(n)
              for w, (t, n) in enumerate(zip(has, need))]
    # Narrow rows, and each different signature once.
    member = materialize(rows.select("_id", *codes, "_v", *has, *out_of), "donor-rows")
    q = materialize(rows.filter(F.col("_f").isNotNull()).select("_v", "_f", *out_of).groupBy("_v").agg(
        F.first("_f").alias("_qf"), *[F.bit_or(n).alias(n) for n in need])
        .withColumnRenamed("_v", "_qid"), "donor-queries")
    # Of equal signatures those stay that come first in a repeat's training part: by parts
    # of their rows, so that one signature that stands very often is no single task, then all.
    d = first_bits(member.select("_id", *codes, "_v", *has, F.pmod(F.xxhash64("_id"), F.lit(64)).alias("_part")),
                   ["_v", "_part"], ["_id", *codes], has).drop("_part")
    d = first_bits(d, ["_v"], ["_id", *codes], has)
    d = d.join(q.select(F.col("_qid").alias("_v"), F.col("_qf").alias("_df")), "_v").drop("_v")
    d = materialize(d.withColumnRenamed("_id", "_did"), "donors")

    # What is shuffled grows as the rows squared over the block's size: larger tables take
    # larger blocks, up to four times as large, so that a task's memory stays bounded.
    block_rows = min(max(block_rows, d.count() // 8), 4 * block_rows)
    every, parts = q.filter(any_bit(need)), []
    for step in range(radius_halvings(d, cap, [], block_dims, block_rows), -1, -1):
        found = materialize(first_within(every, d, cap / (1 << step), block_dims, block_rows, dims,
                                         need, has, codes), "donor-found")
        parts.append(found)
        if step:
            done = found.groupBy("_qid").agg(*[F.bit_or(n).alias(f"_m{n}") for n in need])
            left = [F.col(n).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"_m{n}"), F.lit(0).cast("long")))).alias(n)
                    for n in need]
            every = materialize(every.join(done, "_qid", "left").select("_qid", "_qf", *left).filter(any_bit(need)),
                                "donor-queries")
    nn = functools.reduce(DataFrame.unionByName, parts)
    nn = nn.select(F.col("_qid").alias("_v"), "_did", "_dist", *codes, *[F.col(n).alias(f"_m{n}") for n in need])
    asks = member.select("_id", "_v", *[F.col(c).alias(f"query_{c}") for c in codes], *need)
    shared = [F.col(n).bitwiseAND(F.col(f"_m{n}")) for n in need]
    nn = (asks.join(nn, "_v").withColumn("rep", F.explode(reps_of(shared, reps)))
          .groupBy("rep", "_id").agg(F.min(F.struct("_dist", "_did", *codes, *[f"query_{c}" for c in codes])).alias("_b"))
          .select("rep", "_b.*"))
    # Codes seen in each repeat's training part: bounded by the closed code lists.
    for c in codes:
        seen = (member.groupBy(c).agg(*[F.bit_or(t).alias(t) for t in has])
                .select(F.col(c).alias(f"query_{c}"), F.explode(reps_of([F.col(t) for t in has], reps)).alias("rep")))
        nn = nn.join(seen, ["rep", f"query_{c}"], "left_semi")
    hit = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return nn.groupBy("rep").agg(
        F.count(F.lit(1)).alias("kept"),
        F.avg(hit("query_gear_code", "gear_code")).alias("gear_acc"),
        F.avg(hit("query_habitat_code", "habitat_code")).alias("habitat_acc"))


def donor_accuracy(per_rep: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the per-repeat accuracies."""
    return per_rep.agg(
        F.count(F.lit(1)).alias("reps"),
        F.avg("gear_acc").alias("gear_mean"), F.stddev_samp("gear_acc").alias("gear_sd"),
        F.avg("habitat_acc").alias("habitat_mean"),
        F.stddev_samp("habitat_acc").alias("habitat_sd"))
