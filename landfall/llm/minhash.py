"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles (by their 64-bit hashes). Its sketch
has ``size`` coordinates. In round i < size every element is thrown by that round's hash
into one coordinate with a value in [i, i + 1); a coordinate keeps its least value. As
soon as all are filled the sketch is done, so a large set needs one or two rounds. Rounds
size .. 2 size - 1 throw all elements into the one coordinate i - size, so whatever the
set, every coordinate is filled. Two sketches agree in a coordinate with the sets'
similarity as probability, and the share of agreeing coordinates keeps Chernoff's bounds.

Sets that are equal count once (a class). Classes that agree in a whole band of rows
meet in a bucket: at similarity 0.8, 32 bands of 4 miss a pair with probability 5e-8.
Links are searched in crowds, and each one is verified on the full sets:

1. Classes are candidates if they share a bucket and their sketches agree in at least
   ``share`` of the coordinates (at similarity 0.8 a pair falls below 0.55 with probability
   2e-9). A crowd is what candidates connect. It takes no list of all candidates: every
   class is compared with its bucket's first one (an aggregate and joins), then rounds add
   each class's best candidate outside its crowd, as in Boruvka's spanning trees, until
   no bucket holds a candidate of another crowd.
2. A crowd's full sets meet once, in blocks of bounded size, each two blocks in one group.
   Sets that are linked are followed from set to set, each compared exactly with all that
   are not reached yet, so a spanning forest comes out and not all pairs.

A bucket with more than ``most`` classes is banded again on a finer sketch (128 bands of
8, missing 6e-11); if it is still too large, 1 searches it block by block. No bucket or
crowd is cut or left out.

Sets are not stored for all documents: those of candidates are taken from their texts again.

Defined cases: null or empty text and text without a word have an empty set and are linked
with nothing; fewer words than a shingle are one shingle; rows with null ids take part, but a component's id is
its smallest non-null one (null if there is none); repeated rows are in one component and
all kept if their id is the smallest; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.components import components
from landfall.llm.text import lower_ascii, store, words

LEVELS = ((128, 4), (1024, 8))       # coordinates and rows a band, first and finer sketch
ROUNDS = 60                          # of best candidates; crowds at least halve in number in each
BLOCK_ELEMENTS = 1 << 20             # shingles of a block of a crowd
RUN = 1 << 19                        # elements worked on at once
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def scatter(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of each number, another one for each salt."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per non-empty set; size a power of two up to 2048."""
    out = np.full(len(sets) * size, EMPTY)
    if not sets:
        return out.reshape(0, size)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * size):
        h = scatter(x, turn)
        place = (h & np.uint64(size - 1)).astype(np.int64) if turn < size else turn - size
        np.minimum.at(out, owner * size + place, np.uint64(turn << 52) | h >> np.uint64(12))
        open_ = np.zeros(len(sets), bool)
        live = np.unique(owner)
        open_[live] = (out.reshape(-1, size)[live] == EMPTY).any(axis=1)
        if not open_.any():
            break
        stay = open_[owner]
        x, owner = x[stay], owner[stay]
    return out.reshape(-1, size)


def band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    """One number per sketch and band of ``rows`` coordinates."""
    parts = s.reshape(len(s), s.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = scatter(key ^ parts[:, :, i], i)
    return key.view(np.int64)


def shingle_hashes(text, shingle: int):
    """Hashes of the shingles of a text column, repeats included; none for no word."""
    w = words(lower_ascii(text))
    return w, lambda c: F.when(F.size(c) == 0, F.array().cast("array<long>")).when(
        F.size(c) < shingle, F.array(F.xxhash64(F.concat_ws(" ", c)))).otherwise(F.slice(
            F.transform(c, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(c, i + k) for k in range(1, shingle)]))),
            F.lit(1), F.greatest(F.size(c) - (shingle - 1), F.lit(1))))


def runs(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The distinct sorted values of each list, some lists at a time."""
    flat, ends = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN)) - 1)
        yield [np.unique(flat[a:b]) for a, b in zip(ends[at:to], ends[at + 1:to + 1])]
        at = to


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def hashed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the hashes of every row's shingles."""
    w, of = shingle_hashes(F.col("text"), shingle)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), w.alias("_w")).select(
        "doc_id", of(F.col("_w")).alias("hashes"))


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), key (128 bits of the set), bands and sig (a byte per
    coordinate) of every row; key, bands and sig are null for an empty set."""
    size, rows = LEVELS[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in runs(b.column(1)):
                full = [s for s in sets if len(s)]
                s = sketches(full, size)
                slot = np.cumsum([len(x) > 0 for x in sets]) - 1
                take = pa.array([int(i) if len(x) else None for i, x in zip(slot, sets)], pa.int64())
                sig = (s & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(sets)), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in full], pa.binary()).take(take),
                    lists(band_keys(s, rows)).take(take), pa.array([x.tobytes() for x in sig], pa.binary()).take(take)],
                    names=["doc_id", "n", "key", "bands", "sig"])
                at += len(sets)

    return hashed(docs, shingle).mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id and set of the classes ``wanted`` (id, key, rep), taken from the texts of the
    documents whose id is a class's ``rep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in runs(b.column(0)):
                sets = [x for x in sets if len(x)]
                if not sets:
                    continue
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "set"])

    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    # empty sets go in the task: a filter here would make Spark split the text anew for every word
    sets = hashed(some, shingle).select("hashes").mapInArrow(run, "key binary, set array<long>")
    return store(sets.join(wanted.select("id", "key"), "key").groupBy("id").agg(F.first("set").alias("set")), "minhash-sets")


def bucketed(rows: DataFrame) -> DataFrame:
    """bucket, id, n (classes of the bucket) and least (its first class) of ``rows`` (id,
    bands). Buckets of one class are left out; of buckets with the same classes one stays."""
    each = rows.select("id", F.explode("bands").alias("bucket"))
    size = each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")).where("n > 1")
    size = size.groupBy("n", "least", "x", "y").agg(F.min("bucket").alias("bucket")).drop("x", "y")
    return store(each.join(size, "bucket"), "minhash-buckets")


def agreeing(pairs: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose sketches agree in ``least`` coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in b.columns[2:])
                yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    of = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def by_group(keys: tuple[str, ...], work):
    """Hands each group of a partition that is sorted by ``keys`` to ``work``, as a table."""
    def changes(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            new = changes(t)
            if len(new):                             # the last group may go on
                t, rest = t.slice(0, new[-1]).combine_chunks(), t.slice(new[-1])
                for x, y in zip(np.append(0, new[:-1]), new):
                    yield from work(t.slice(x, y - x))
            else:
                rest = t
        if rest is not None and rest.num_rows:
            yield from work(rest.combine_chunks())
    return run


def pair_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def best_candidates(least: int, percent: int):
    """Each class's best candidate of another crowd, in a bucket (or two blocks of it)."""
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, label, n, ids = (t.column(k).to_numpy() for k in ("block", "label", "size", "id"))
        if label.min() == label.max():
            return
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            may = (label[part, None] != label) & (np.minimum(n[part, None], n) * 100 >= np.maximum(n[part, None], n) * percent)
            if side.min() != side.max():             # two blocks: each one's own pairs are searched elsewhere
                may &= side[part, None] != side
            i, j = np.nonzero(may)
            if not len(i):
                continue
            same = np.full(may.shape, -1, np.int16)
            for k in range(0, len(i), 65536):
                x, y = i[k:k + 65536], j[k:k + 65536]
                same[x, y] = (sig[at + x] == sig[y]).sum(axis=1)
            i, j = np.arange(len(may)), same.argmax(axis=1)
            good = same[i, j] >= least
            i, j = i[good] + at, j[good]
            yield pair_batch(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))
    return by_group(("bucket", "x", "y"), work)


def spanning_links(percent: int):
    """Links that connect what is linked in a crowd (or, in two blocks, across them)."""
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side = t.column("id").to_numpy(), t.column("block").to_numpy()
        column = t.column("set").combine_chunks()
        n = np.diff(np.asarray(column.offsets))
        ends = np.append(0, np.cumsum(n))
        element = np.unique(np.asarray(column.flatten()), return_inverse=True)[1]
        of = np.repeat(np.arange(len(n)), n)
        two = side.min() != side.max()
        left, held = np.ones(len(n), bool), 0

        def index():
            stay = np.flatnonzero(left[of])
            stay = stay[np.argsort(element[stay], kind="stable")]
            return of[stay], np.searchsorted(element[stay], np.arange(element.max() + 2)), int(left.sum())

        a, b = [], []
        for seed in range(len(n)):
            todo = [seed] if left[seed] else []
            left[seed] = False
            while todo and left.any():
                at = todo.pop()
                if 2 * left.sum() <= held or not held:
                    owners, start, held = index()
                e = element[ends[at]:ends[at + 1]]
                per = start[e + 1] - start[e]
                places = np.repeat(start[e] - np.append(0, np.cumsum(per)[:-1]), per) + np.arange(per.sum())
                common = np.bincount(owners[places], minlength=len(n))
                near = left & (common * 100 >= (n + n[at] - common) * percent)
                if two:
                    near &= side != side[at]
                hit = np.flatnonzero(near)
                left[hit] = False
                todo += hit.tolist()
                a += [ids[at]] * len(hit)
                b += ids[hit].tolist()
        if a:
            yield pair_batch(a, b)
    return by_group(("label", "x", "y"), work)


def dealt(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Rows with their ``block`` of the group's ``blocks``, once for every two blocks x <= y
    they are in, in partitions sorted by them."""
    r = rows.withColumn("_blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    r = r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    r = r.withColumn("x", F.least("block", "_other")).withColumn("y", F.greatest("block", "_other")).drop("_blocks", "_other")
    return r.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, share: float = 0.55,
                    most: int = 4096, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (the smallest doc_id reachable over links
    of at least ``percent`` similarity) and kept (doc_id is that one) of every row."""
    least = int(np.ceil(share * LEVELS[0][0]))
    f = store(sketched(docs, shingle), "minhash-rows")
    classes = store(f.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
    ).withColumn("id", F.monotonically_increasing_id()), "minhash-classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        return full_sets(docs, classes.select("id", "key", "rep").join(ids, "id", "left_semi"), shingle)

    def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The buckets of ``rows`` that hold several crowds, with their classes' labels."""
        named = rows.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        several = named.groupBy("bucket").agg(F.min("label").alias("u"), F.max("label").alias("v")).where("u < v")
        return named.join(several.select("bucket"), "bucket")

    members = bucketed(classes.select("id", "bands"))
    stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    edges = store(agreeing(stars, classes, least, percent), "minhash-pairs")
    crowd = store(components(edges), "minhash-crowds")
    rows = members.where(F.col("n") <= most)
    for level in LEVELS[1:]:
        large = labelled(members.where(F.col("n") > most), crowd).select("id").distinct()
        if not large.isEmpty():
            rows = rows.unionByName(bucketed(finer(sets_of(large), *level)))
    rows = rows.join(classes.select("id", F.col("n").alias("size"), "sig"), "id")
    for _ in range(ROUNDS):
        open_ = store(labelled(rows, crowd), "minhash-open")
        pairs = store(dealt(open_, "bucket", F.ceil(F.col("n") / most)).mapInArrow(
            best_candidates(least, percent), "a long, b long").distinct(), "minhash-pairs")
        if pairs.isEmpty():
            break
        edges = edges.unionByName(pairs)
        crowd = store(components(edges), "minhash-crowds")
        rows = open_.drop("label")                   # buckets of one crowd stay so
    else:
        raise RuntimeError("crowds did not settle")

    sets = sets_of(crowd.select(F.col("node").alias("id"))).join(crowd.withColumnRenamed("node", "id"), "id")
    size = crowd.join(classes.select(F.col("id").alias("node"), "n"), "node").groupBy("label").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("elements") / BLOCK_ELEMENTS))
    links = dealt(sets.join(size, "label"), "label", blocks).select("label", "x", "y", "block", "id", "set").mapInArrow(
        spanning_links(percent), "a long, b long")
    label = store(components(links), "minhash-labels")
    named = classes.select("id", "key", "rep").join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "rep", F.coalesce("label", "id").alias("label"))
    group = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = store(named.join(group, "label").select("key", "component_id"), "minhash-named")
    out = f.select("doc_id", "n", "key").join(named, "key", "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def finer(sets: DataFrame, size: int, rows: int) -> DataFrame:
    """id and bands of a sketch of ``size`` coordinates, for every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in runs(b.column(1)):
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(part)), lists(band_keys(sketches(part, size), rows))], names=["id", "bands"])
                at += len(part)

    return sets.select("id", "set").mapInArrow(run, "id long, bands array<long>")
