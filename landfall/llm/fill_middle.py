"""Fill-in-the-middle transformation with a compressed set of code point boundaries.

Texts are cut by code points but held as UTF-8 bytes. The byte offsets at which code
points start, and the text's end, form a set in the manner of a roaring bitmap: offsets
are dealt by their high 16 bits to containers, and a container is whichever is smallest
of a sorted array, a bitmap, or runs (a stretch of ASCII is one run). Cumulative
cardinalities find the container of the k-th boundary, a select inside it the offset: both
cuts of a text come from two such selects, and the three parts are slices of its bytes.

A text is worked on where it is read: no shuffle, and a task holds one batch at a time.

Defined cases: null text is empty, and plain; a null id counts as the empty text in its
hash; repeated rows give equal results; a text that holds a marker is plain; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
MARKERS = ("<P>", "<S>", "<M>")
FLUSH = 1 << 24                      # bytes of output a batch


class Array:
    """Sorted 16-bit offsets."""
    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.at[k])


class Bitmap:
    """One bit per offset, in 64-bit words with the set bits up to each."""
    def __init__(self, at: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[at] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.upto, k, side="right"))
        word = int(self.words[w])
        for _ in range(k - (int(self.upto[w - 1]) if w else 0)):
            word &= word - 1                         # drops the lowest set bit
        return 64 * w + (word & -word).bit_length() - 1


class Runs:
    """First offset of each run of consecutive ones, with the offsets up to each run's end."""
    def __init__(self, at: np.ndarray, first: np.ndarray):
        self.start = at[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(at))

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.start[r]) + k - (int(self.upto[r - 1]) if r else 0)


def container(at: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of sorted offsets below 2^16."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    size = {Array: 2 * len(at), Bitmap: CHUNK // 8, Runs: 4 * len(first) + 2}
    kind = min(size, key=size.get)
    return Runs(at, first) if kind is Runs else kind(at)


class Boundaries:
    """Where the code points of a UTF-8 text start, and where it ends."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, np.uint8)
        starts = np.append((b & 0xC0) != 0x80, True)
        self.high, self.containers, count = [], [], []
        for high in range(-(-len(starts) // CHUNK)):
            at = np.flatnonzero(starts[high * CHUNK:(high + 1) * CHUNK])
            if len(at):
                self.high.append(high)
                self.containers.append(container(at))
                count.append(len(at))
        self.upto = np.cumsum(count)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """Offset of the k-th boundary, from 0."""
        c = int(np.searchsorted(self.upto, k, side="right"))
        return self.high[c] * CHUNK + self.containers[c].select(k - (int(self.upto[c - 1]) if c else 0))


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null
    if plain) and output of every row. ``plain`` and ``spm``: percent of texts left plain,
    and of the others those whose suffix stands first. Cuts and form come from the hash of the id."""
    p, s, m = (x.encode() for x in MARKERS)

    def one(name: str, raw: bytes):
        h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
        at = Boundaries(raw)
        n = len(at) - 1
        if not raw or any(x in raw for x in (p, s, m)) or h3 % 100 >= 100 - plain:
            return n, "plain", None, None, raw
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = at.select(a), at.select(b)
        prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
        if h4 % 100 < spm:
            return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(2)
            rows, size, start = [], 0, 0
            for at, name in enumerate(names):
                raw = texts[at].as_buffer()
                rows.append(one(name, raw.to_pybytes() if raw else b""))
                size += len(rows[-1][4])
                if size > FLUSH or at == len(names) - 1:
                    n, form, a, b, out = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(start, len(rows)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                        pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.binary()).view(pa.string())],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    rows, size, start = [], 0, at + 1

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return d.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marker, and a marker's two
    ends differ, so each marker is found at its first place."""
    p, s, m = MARKERS
    after = lambda text, marker: F.substring_index(text, marker, -1)
    before = lambda text, marker: F.substring_index(text, marker, 1)
    middle = after(output, m)
    return F.when(form == "psm", F.concat(before(after(output, p), s), middle, before(after(output, s), m))).when(
        form == "spm", F.concat(before(after(output, p), m), middle, before(after(output, s), p))).otherwise(output)
