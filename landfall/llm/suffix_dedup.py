"""Repeated byte strings found by a distributed, sparse suffix array.

Every byte covered by a ``length``-byte string that also starts anywhere else is found,
whatever the documents; strings never cross documents.

Sparse suffixes: a window of ``length`` bytes is looked after by one suffix, the one that
starts at the least hash of a 16-byte gram among its first ``length / 2`` places. The choice
depends on the window's bytes alone, so equal windows have equal suffixes at equal
distance, and only one suffix in about ``length / 4`` bytes is needed. A suffix serves the
windows that start ``near`` to ``far`` bytes before it.

1. Suffixes whose leading half (which every window of theirs holds) stands only once are
   left out by counting hashes.
2. The others are range-partitioned by their leading bytes and a hash of the leading
   half. Splitters come from a bounded sample and carry a tie-break, so a leading half
   that very many suffixes share is split over several buckets.
3. A bucket sorts its suffixes by multikey quicksort (characters of 8 bytes: only ties
   go on to the next character), and so the texts before them. For each distance d, neighbours
   that share length - d bytes after and d bytes before their suffix are equal windows.
4. Across boundaries: windows whose leading half is that of a splitter may have equals in
   other buckets. One row per different window and bucket, by a 128-bit hash, is counted
   over all buckets, with map-side sums.
5. Found windows become byte ranges of texts, and texts are cut.

Texts are worked on once, however many documents hold them; texts that several
documents hold are repeated as a whole. Nothing is sampled but the splitters.

Defined cases: null and empty texts have no bytes and keep the empty string; texts
shorter than ``length`` are kept whole; repeated rows are copies of each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import store

GRAM = 16
PIECE = 1 << 21                      # bytes worked on at once
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def eight(buf: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    every = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    return every if at is None else every[at]


def gram_keys(buf: np.ndarray) -> np.ndarray:
    """A hash of the gram at each place, with the place in its low 24 bits."""
    x = eight(buf)
    h = x[:-8] * _MIX[0] + x[8:] * _MIX[1]
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    return (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)


def sliding_least(k: np.ndarray, width: int) -> np.ndarray:
    """The least of k[i:i + width] for each i."""
    have = 1
    while have * 2 <= width:
        k = np.minimum(k[:-have], k[have:])
        have *= 2
    return np.minimum(k[:len(k) - (width - have)], k[width - have:]) if width > have else k


def lead_keys(buf: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """Range key of the suffixes at these places: three leading bytes, then 39 bits of a
    hash of the leading ``half + 1`` bytes; never negative."""
    h = np.zeros(len(at), np.uint64)
    rng = np.random.default_rng(11)
    for j in [*range(0, half - 6, 8), half - 7]:
        h += (eight(buf, at + j) ^ (eight(buf, at + j) >> np.uint64(29))) * np.uint64(rng.integers(1 << 62) * 2 + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    lead = (buf[at].astype(np.uint64) << np.uint64(16)) | (buf[at + 1].astype(np.uint64) << np.uint64(8)) | buf[at + 2]
    return ((lead << np.uint64(39)) | (h >> np.uint64(25))).astype(np.int64)


def suffixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Text number, place, near, far and range key of the suffixes that the texts at
    [start, end) of a buffer need. A piece of a text has ``length`` bytes of overlap."""
    half = length // 2
    if len(buf) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = (sliding_least(gram_keys(buf), half)[:len(buf) - length + 1] & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[:len(at)]
    whole = np.arange(len(at)) + length <= ends[text]
    window = np.flatnonzero(whole)
    if not len(window):
        return window, window, window, window, window
    at, text = at[window], text[window]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    return (text[first], place - starts[text[first]], place - window[last], place - window[first],
            lead_keys(buf, place, half))


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (text, start, end) of about PIECE bytes; longer texts are cut into pieces
    that overlap so that each window lies in one of them."""
    run, size = [], 0
    for t in range(len(offsets) - 1):
        a, b = int(offsets[t]), int(offsets[t + 1])
        if b - a < length:
            continue
        while a == int(offsets[t]) or a + length <= b:
            e = min(b, a + PIECE + length - 1)
            run.append((t, a, e))
            size += e - a
            if size >= PIECE:
                yield tuple(np.array(x) for x in zip(*run))
                run, size = [], 0
            a += PIECE
    if run:
        yield tuple(np.array(x) for x in zip(*run))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


MORE = np.dtype([("pos", "<i8"), ("reach", "<i4")])


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """key, h1, h2 (the text), pos, reach (near and far) of every needed suffix. Suffixes
    of one text with equal keys (periodic text has very many) are one row: n counts them,
    ``more`` packs the others' places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for t, a, e in pieces(offsets, length):
                buf = np.concatenate([data[x:y] for x, y in zip(a, e)])
                ends = np.cumsum(e - a)
                text, pos, near, far, key = suffixes(buf, ends - (e - a), ends, length)
                place = np.empty(len(pos), MORE)
                place["pos"], place["reach"] = pos + (a - offsets[t])[text], near << 16 | far
                text = t[text]
                order = np.lexsort((place["pos"], key, text))
                text, key, place = text[order], key[order], place[order]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])]) \
                    if len(key) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(key)])
                more = [None] * len(first)
                for i in np.flatnonzero(n > 1):
                    more[i] = place[first[i] + 1:first[i] + n[i]].tobytes()
                which = pa.array(text[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first]), b.column(0).take(which), b.column(1).take(which),
                     pa.array(place["pos"][first]), pa.array(place["reach"][first]), pa.array(n.astype(np.int32)),
                     pa.array(more, pa.binary())], names=["key", "h1", "h2", "pos", "reach", "n", "more"])

    return texts.mapInArrow(run, "key long, h1 long, h2 int, pos long, reach int, n int, more binary")


def tie_break(h1: np.ndarray, pos: np.ndarray) -> np.ndarray:
    x = (h1.view(np.uint64) + pos.astype(np.uint64) * _MIX[0]) * _MIX[1]
    return (x >> np.uint64(1)).astype(np.int64)


def bucket_of(key: np.ndarray, tie: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of (key, tie) between splitters (rows of key and tie), and whether the key
    is that of a splitter."""
    if not len(split):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    left, right = np.searchsorted(split[:, 0], key, "left"), np.searchsorted(split[:, 0], key, "right")
    cut = left < right
    out = left.copy()
    for i in np.flatnonzero(cut):
        out[i] += np.searchsorted(split[left[i]:right[i], 1], tie[i], "left")
    return out, cut


RECORD = ("bucket long, cut boolean, h1 long, h2 int, pos long, near int, far int, n int, after binary, before binary, "
          "ranges binary")


def merged_ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranges in order, those that touch or overlap made one: rows of start and stop."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return np.stack([start[new], stop[np.r_[new[1:] - 1, len(stop) - 1]]], axis=1)



def records(texts: DataFrame, split: np.ndarray, length: int) -> DataFrame:
    """One row per wanted suffix: its bucket, the bytes after and (reversed) before it.

    ``texts``: h1, h2, text, at (array of pos, reach and more). Suffixes of one text that are alike
    in all their bytes are sent once, with their number n; if there are several, all their
    windows repeat, and ``ranges`` packs the bytes that those cover."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(),
                 pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            lists = b.column(3)
            list_at = np.asarray(lists.offsets)
            values = lists.values
            pos_all = np.asarray(values.field(0), np.int64)
            reach_all = np.asarray(values.field(1), np.int64)
            more_all = values.field(2)
            rows: list[tuple] = []
            size = 0
            for t in range(b.num_rows):
                mine = slice(list_at[t], list_at[t + 1])
                more = [np.frombuffer(m, MORE) for m in more_all[mine].drop_null().to_pylist()]
                pos = np.concatenate([pos_all[mine], *[m["pos"] for m in more]])
                reach = np.concatenate([reach_all[mine], *[m["reach"].astype(np.int64) for m in more]])
                text = data[offsets[t]:offsets[t + 1]]
                raw = text.tobytes()
                h1, h2 = b.column(0)[t].as_py(), b.column(1)[t].as_py()
                key = lead_keys(text, pos, half)
                bucket, cut = bucket_of(key, tie_break(np.full(len(pos), h1, np.int64), pos), split)
                near_of, far_of = reach >> 16, reach & 0xFFFF
                alike: dict = {}
                for i in range(len(pos)):
                    p = int(pos[i])
                    after, before = raw[p:p + length - int(near_of[i])], raw[p - int(far_of[i]):p][::-1]
                    alike.setdefault((after, before, int(near_of[i])), []).append(i)
                for (after, before, _), same in alike.items():
                    i, ranges = same[0], None
                    if len(same) > 1:
                        ranges = merged_ranges(pos[same] - far_of[same], pos[same] - near_of[same] + length).tobytes()
                    rows.append((int(bucket[i]), bool(cut[i]), h1, h2, int(pos[i]), int(near_of[i]), int(far_of[i]),
                                 len(same), after, before, ranges))
                    size += len(after) + len(before)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return texts.mapInArrow(run, RECORD)


def matrix(strings, width: int) -> np.ndarray:
    """Byte strings as rows of equal width, filled up with zeros."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows. Rows are parted by one character of 8 bytes; only rows that are
    equal so far go on to the next."""
    chars = rows.view(">u8")
    order = np.arange(len(rows))
    group = np.zeros(len(rows), np.int64)            # of each place of the order
    tied = np.arange(len(rows))                      # places still in a group of several
    for c in range(chars.shape[1]):
        if len(tied) < 2:
            break
        own = chars[order[tied], c].astype(np.uint64)
        by = np.lexsort((own, group[tied]))
        order[tied] = order[tied][by]
        own = own[by]
        g = group[tied]
        new = np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])]
        group[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = np.r_[~new[1:], False] | ~new         # alike with a neighbour
        tied = tied[same]
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the one before it (-1 for the first)."""
    out = np.full(len(order), -1)
    for a in range(1, len(order), 4096):
        b = min(a + 4096, len(order))
        differ = rows[order[a:b]] != rows[order[a - 1:b - 1]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(after, before, near, far, n, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix and distance whether its window repeats in the bucket, and for
    windows that do not: True; for others only for the first of equal windows."""
    half = length // 2
    a, b = matrix(after, length), matrix(before, half)
    after_order, before_order = multikey_sort(a), multikey_sort(b)
    after_shared, before_shared = common_prefix(a, after_order), common_prefix(b, before_order)
    repeats = np.zeros((len(near), half), bool)
    firsts = np.zeros((len(near), half), bool)
    of_after, of_before = np.empty(len(near), np.int64), np.empty(len(near), np.int64)
    for d in range(half):
        rows = np.flatnonzero((near <= d) & (d <= far))
        if not len(rows):
            continue
        of_after[after_order] = np.cumsum(after_shared < length - d)
        of_before[before_order] = np.cumsum(before_shared < d)
        _, first, which, count = np.unique(of_after[rows] * (len(near) + 1) + of_before[rows],
                                           return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=n[rows], minlength=len(count))
        repeats[rows, d] = total[which] > 1
        firsts[rows[first], d] = True
    return repeats, firsts


FOUND = "h1 long, h2 int, start long, stop long, w1 long, w2 long, n int"


def search_bucket(length: int):
    """Ranges of repeated windows in a bucket (n = 0), and rows of windows to be compared
    across buckets: their hash and number; start is -1 unless the bucket has it once."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows[rows["ranges"].notna()].itertuples():
            out += [(r.h1, r.h2, a, b, 0, 0, 0) for a, b in np.frombuffer(r.ranges, np.int64).reshape(-1, 2)]
        if len(rows):
            near, far, pos = (rows[c].to_numpy(np.int64) for c in ("near", "far", "pos"))
            h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
            after, before = rows["after"].to_numpy(), rows["before"].to_numpy()
            n = rows["n"].to_numpy()
            repeats, firsts = repeated_windows(after, before, near, far, n, length)
            edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (i, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            out += list(zip(h1[i], h2[i], pos[i] - high + 1, pos[i] - low + length, *[[0] * len(i)] * 3))
            for i in np.flatnonzero(rows["cut"].to_numpy()):
                text = before[i][::-1] + after[i]
                for d in np.flatnonzero(firsts[i]):
                    at = len(before[i]) - int(d)
                    w = np.frombuffer(hashlib.blake2b(text[at:at + length], digest_size=16).digest(), np.int64)
                    once = not repeats[i, d]
                    start = int(pos[i] - d)
                    out.append((h1[i], h2[i], start if once else -1, start + length, w[0], w[1], 1 if once else 2))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")]).astype("int64")
    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """h1, h2, text and its number of copies, once per text."""
    return docs.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def cut_texts(length: int):
    """n_bytes, n_removed, n_spans, kept_sha256 of texts with their repeated ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copies, ranges in zip(b.column(2), b.column(3), b.column(4)):
                raw = (text.as_py() or "").encode()
                if copies.as_py() > 1 and len(raw) >= length:
                    ranges = [(0, len(raw))]
                else:
                    ranges = sorted((r["start"], r["stop"]) for r in ranges.as_py() or [])
                kept, at, removed, spans, stop = [], 0, 0, 0, -1
                for s, e in ranges:
                    if s > stop:                     # touching ranges are one run
                        kept.append(raw[at:s])
                        spans += 1
                        removed += e - s
                        stop = e
                    elif e > stop:
                        removed += e - stop
                        stop = e
                    at = max(at, e)
                kept.append(raw[at:])
                out.append((len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                names=["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def repeated_ranges(docs: DataFrame, length: int = 400, bucket_rows: int = 32_768,
                    sample: int = 200_000) -> DataFrame:
    """h1, h2, start, stop: byte ranges of texts (h1, h2, text) covered by repeated strings;
    ranges of one text may overlap."""
    a = anchors(docs.where(F.octet_length("text") >= length).select("h1", "h2", "text"), length)
    # stored on its own, so that a hot key's partition of the join can be split
    often = store(a.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("key"), "suffix-keys")
    wanted = store(a.join(often, "key"), "suffixes")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, sample / max(total, 1))
    some = wanted.where(F.pmod(F.xxhash64("h1", "pos"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "key", "h1", "pos").limit(2 * sample).toPandas()
    split = np.zeros((0, 2), np.int64)
    buckets = -(-total // bucket_rows)
    if buckets > 1 and len(some):
        key = some["key"].to_numpy()
        tie = tie_break(some["h1"].to_numpy(), some["pos"].to_numpy())
        order = np.lexsort((tie, key))
        at = order[np.unique(np.arange(1, buckets) * len(order) // buckets)]
        split = np.stack([key[at], tie[at]], axis=1)

    places = wanted.groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "reach", "more")).alias("at"))
    texts = distinct_texts(docs).join(places, ["h1", "h2"]).select("h1", "h2", "text", "at")
    found = store(records(texts, split, length).groupBy("bucket").applyInPandas(search_bucket(length), FOUND), "suffix-windows")
    across = found.where("n > 0")
    again = across.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    return found.where("n = 0").select("h1", "h2", "start", "stop").unionByName(
        across.where("start >= 0").join(again, ["w1", "w2"]).select("h1", "h2", "start", "stop"))


def remove_repeats(docs: DataFrame, length: int = 400, bucket_rows: int = 32_768) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
    ranges = repeated_ranges(d, length, bucket_rows).groupBy("h1", "h2").agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = distinct_texts(d).join(ranges, ["h1", "h2"], "left").select("h1", "h2", "text", "copies", "ranges")
    per = store(cut.mapInArrow(
        cut_texts(length), "h1 long, h2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "cut-texts")
    return d.select("doc_id", "h1", "h2").join(per, ["h1", "h2"]).drop("h1", "h2")
