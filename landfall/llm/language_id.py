"""Language identification with bit-sliced Bloom filters.

Learning: character n-grams of a bounded sample of labelled documents (``per_language``
documents of each, chosen by a hash of the id) are counted per language. An n-gram
belongs to the languages in which it is about as frequent as in the language that uses
it most. The filter is one array of slots; a slot is a bitmask of languages, so one
lookup answers for all languages at once: an n-gram sets its languages' bits in its two
slots, and a lookup is the AND of two slots.

Prediction: the lookups of a document's n-grams are counted per language (popcounts),
each language's count is corrected for the share of its bits that are set (its false
positives), and the largest corrected count decides; the score is its share of the
n-grams, from 0 to 1. Documents are predicted where they are read; nothing is shuffled.
The filter has a fixed size (``1 << bits`` slots) and is sent to the tasks.

Defined cases: null text or text without a letter is ``und`` with score 0; so is any
text none of whose n-grams was learned; ties go to the language that sorts first; null languages
are not learned; repeated rows are predicted each; other columns are ignored by
:func:`predict` and kept by :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import id_crc

UNKNOWN = "und"
SIZES = (2, 3, 4)
ENOUGH = 20_000                      # n-grams of a language for each time that one must stand
CHUNK = 1 << 18                      # characters worked on at once


def letters_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts and the text each comes from.

    Letters are folded to lower case, anything else is a space, runs of spaces are one;
    an n-gram holds a letter and lies in one text, which begins and ends with a space.
    """
    codes, owner = [], []
    for i, t in enumerate(texts):
        codes.append(np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        owner.append(len(codes[-1]))
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    o = np.repeat(np.arange(len(texts), dtype=np.int32), owner)
    is_letter = letter[c]
    c = np.where(is_letter, c, np.uint32(32)).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (o[1:] != o[:-1])   # the first space after a letter or at a start
    if len(keep):
        keep[0] = True
    c, o, is_letter = c[keep], o[keep], is_letter[keep]
    hashes, owners = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k:k + m]
        # within one text, and no space inside: a piece of one word
        good = o[:m] == o[n - 1:n - 1 + m]
        for k in range(1, n - 1):
            good &= is_letter[k:k + m]
        if n == 2:
            good &= is_letter[:m] | is_letter[1:1 + m]
        hashes.append(mixed(h[good]))
        owners.append(o[:m][good])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owners)


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of about CHUNK characters: the places of their texts and the texts. A longer text
    is cut at white space, which no n-gram holds inside; a word is never cut."""
    owner, run, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = min(at + CHUNK, len(t))
            if end < len(t):
                cut = max(t.rfind(x, at + 1, end) for x in " \n")
                after = [x for x in (t.find(" ", end), t.find("\n", end)) if x >= 0]
                end = cut if cut > at else min(after, default=len(t))
            if size and size + end - at > CHUNK:
                yield owner, run
                owner, run, size = [], [], 0
            owner.append(i)
            run.append(t[at:end])
            size += end - at
            if end == len(t):
                break
            at = end
    if run:
        yield owner, run


class Filter:
    """Slots of language bitmasks with the languages' names and set shares."""

    def __init__(self, slots: np.ndarray, names: list[str]):
        self.slots, self.names = slots, names
        bits = np.arange(len(names))
        self.filled = np.array([((slots[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in bits]) \
            if names else np.zeros(0)

    def counts(self, h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits per text and language, and n-grams per text."""
        mask = np.uint64(len(self.slots) - 1)
        a, b = (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)
        found = self.slots[a] & self.slots[b]
        total = np.bincount(owner, minlength=n_texts)
        hits = np.empty((n_texts, len(self.names)))
        for l in range(len(self.names)):
            on = (found[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)
            hits[:, l] = np.bincount(owner, weights=on, minlength=n_texts)
        return hits, total

    def decide(self, texts: list[str | None], letter: np.ndarray) -> tuple[list[str], list[float]]:
        names, scores = [], []
        hits, total = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for of, run in chunks([t or "" for t in texts]):
            some, n = self.counts(*grams(run, letter), len(run))
            np.add.at(hits, of, some)
            np.add.at(total, of, n)
        false = self.filled ** 2                         # both slots set by other n-grams
        share = np.clip((hits / np.maximum(total, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1)
        for i in range(len(texts)):
            if not total[i] or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(np.argmax(share[i]))
                names.append(self.names[best] if share[i, best] > 0 else UNKNOWN)
                scores.append(float(share[i, best]))
        return names, scores


def learn(docs: DataFrame, per_language: int = 2000, bits: int = 20, common: float = 0.25,
          least: int = 5, seed: int = 0) -> Filter:
    """Learn from the labelled rows of ``docs`` (doc_id, text, lang).

    At most about ``per_language`` documents of each language are read. A language leaves
    out n-grams that the sample holds less than once in ``ENOUGH`` of the language's own, but
    none that stands ``least`` times; an n-gram belongs to a language whose rate is at least
    ``common`` times the highest.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Filter(np.zeros((1 << bits, 1), np.uint64), [])
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    wanted = F.lit(False)
    for name in names:
        wanted = wanted | ((F.col("lang") == name) & (spot < int(min(1.0, per_language / sizes[name]) * (1 << 30))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters_table()
        place = {n: i for i, n in enumerate(names)}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, run in chunks(texts):
                h, owner = grams(run, letter)
                of = np.array([place[langs[i]] for i in at], dtype=np.int64)
                if not len(h):
                    continue
                for l in np.unique(of):
                    u, n = np.unique(h[of[owner] == l], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(np.full(len(u), l)), pa.array(n.astype(np.int64))],
                        names=["gram", "lang", "n"])

    counted = labelled.where(wanted).select("lang", "text").mapInArrow(
        count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.sum("n").alias("seen"),
                                    F.collect_list(F.struct("lang", "rate", "all")).alias("in"))
    used = top.select("gram", "top", "seen", F.explode("in").alias("x")).where(
        (F.col("seen") >= F.least(F.lit(least), F.greatest(F.lit(1), F.floor(F.col("x.all") / ENOUGH))))
        & (F.col("x.rate") >= F.lit(common) * F.col("top")))
    u = F.col("gram")
    low, high = u.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(u, 32).bitwiseAND(F.lit((1 << bits) - 1))
    slots = used.select(F.explode(F.array(low, high)).alias("slot"), F.col("x.lang").alias("lang")).groupBy(
        "slot", F.floor(F.col("lang") / 64).alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("lang", F.lit(64)).cast("int"))).alias("mask"))
    table = np.zeros((1 << bits, (len(names) + 63) // 64), np.uint64)
    got = slots.toPandas()                               # at most one row per slot: a fixed bound
    table[got["slot"].to_numpy(np.int64), got["part"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(table, names)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters_table()
        for b in batches:
            names, scores = model.decide(b.column(1).to_pylist(), letter)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Filter, least_score: float = 0.0) -> DataFrame:
    """The rows whose language is known (with at least ``least_score``), all columns kept:
    only texts without a letter or of no learnt language go."""
    # the rows travel as one struct, whatever their columns are called
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters_table()
        for b in batches:
            texts = b.column(1).to_pylist()
            names, scores = model.decide(texts, letter)
            yield b.select([0]).filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores)], pa.bool_()))

    return packed.mapInArrow(run, packed.select("row").schema).select("row.*")


def held_out(mod: int, rest: int):
    return id_crc(F.col("doc_id")) % mod == rest
