"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per context, all sharing one parent (the unigram restaurant), whose
base is uniform over the known words and one for all others. The context of a word is
the word before it (the end mark before the first); every distinct context has its own
restaurant, so their number grows with the corpus as the words do.

Seating: customers of one word in one restaurant sit at tables; each table sends one
customer to the parent. Gibbs sweeps draw a word's number of tables in a restaurant
from its conditional given the restaurant's other tables and the parent's present
prediction: proportional to S(c, t) a^t, S being the generalised Stirling numbers of
the discount, exactly for up to ``EXACT`` customers; more are seated one after another
by the restaurant's rule, beyond the first in growing blocks. All words are drawn at
once with the totals of the sweep before, as distributed samplers do. Sweeps after the
burn-in are samples; a token's probability is the mean of the samples' predictions.

Plan: texts become arrays of word hashes in the JVM. Tasks count (word, context) pairs
of their rows first, and pairs are then shuffled by word as packed arrays; a bucket
holds all of a word's counts. A sweep reads the buckets; each sends its sums of tables
by context to the contexts' ranges (one entry per bucket and context, so a frequent
context is no hot group), where they are added up and sent back to the buckets that
asked. These sums are stored by sweep; draws are seeded by bucket and sweep, so later
passes repeat them instead of storing states, and a lost task draws the same again.
Scoring shuffles the documents' tokens to the buckets (the task's distinct words and
contexts once) and sums of log probabilities back, a third of the documents at a time. Tokens whose context the bucket has
never met join the stored table of contexts. A bucket with very many tokens (a very
frequent word) is split by document range, its model being copied to the parts.

Defined cases: null text is empty: its end mark is its only token; an empty table gives
an empty result; without training rows every known count is 0; null ids are
texts like any other; repeated rows are counted and scored each; other columns are
ignored. The input is read twice and has to give the same rows in the same order, as a
stored table does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import lower_ascii, store, words

EXACT = 64
BUCKET_BYTES = 9 << 20               # text whose tokens make a bucket
PART_TOKENS = 2_500_000              # tokens of a bucket that are scored at once
RUN_TOKENS = 1_500_000               # tokens of a batch that are sorted at once
WAVES = 3                            # parts of the documents that are scored one after another


@dataclass
class Model:
    """Everything of fixed size that scoring needs."""
    tokens: int
    known: int
    customers: np.ndarray            # of the parent, by sweep
    tables: np.ndarray               # of the parent, by sweep
    discount: float
    parent_discount: float
    strength: float
    samples: int
    burn_in: int
    seed: int


@dataclass
class Places:
    """How many parts each bucket has, and the table of all contexts: ctx and, by sample,
    the share of its prediction that comes from the parent."""
    parts: np.ndarray
    contexts: DataFrame


def planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all of them, then the second ones, and so on:
    the high bytes of sorted or small numbers repeat, so shuffles and files compress them."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    """The ``n`` unsigned numbers of :func:`planes`."""
    if not n:
        return np.zeros(0, np.uint64)
    width = len(data) // n
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"u{width}").ravel()


def hashes(data: bytes) -> np.ndarray:
    return numbers(data, len(data) // 8)


def narrow(a: np.ndarray) -> bytes:
    """Counts as bytes, as wide as the largest needs."""
    return planes(a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)))


def widened(data: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of :func:`narrow`."""
    return numbers(data, n).astype(np.int64)


def token_hashes(text: Column) -> Column:
    """Hashes of a text's words and of its end mark."""
    return F.concat(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit("\n"))))


def tokens_of(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the texts of a batch: distinct words, the order of the tokens by word, tokens
    of each word, places of the tokens' contexts among the words, lengths of the texts."""
    offsets = np.asarray(lists.offsets)
    w = np.asarray(lists.values)[offsets[0]:offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    order = np.argsort(w, kind="stable").astype(np.int32)    # a batch's places fit in 32 bits
    ranked = w[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(w) else np.zeros(0, np.int64)
    u, per = ranked[start], np.diff(np.r_[start, len(w)])
    del ranked
    at = np.empty(len(w), np.int32)
    at[order] = np.repeat(np.arange(len(u), dtype=np.int32), per)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    if len(w):
        before[offsets[:-1]] = at[-1]                # every text ends with the end mark
    return u, order, per, before, np.diff(offsets)


def runs(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about RUN_TOKENS tokens and where they start; bounds the memory
    that sorting takes, whatever the batch."""
    offsets = np.asarray(lists.offsets)
    start = 0
    while start < len(lists):
        end = int(np.searchsorted(offsets, offsets[start] + RUN_TOKENS, "right")) - 1
        end = min(max(end, start + 1), len(lists))
        yield start, lists.slice(start, end - start)
        start = end


def bucket_of(w: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted words lie in sorted buckets."""
    return ((w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def summed(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums of ``n`` (or how often they stand)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    if n is None:
        return key[first], np.diff(np.r_[first, len(key)])
    return key[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def merged(w: list[np.ndarray], ctx: list[np.ndarray], n: list[np.ndarray]):
    """Distinct words, distinct contexts, and the distinct pairs (places of the word and of
    the context) with their counts. The lists are emptied: they are large."""
    u, at = np.unique(np.concatenate(w), return_inverse=True)
    w.clear()
    x, of = np.unique(np.concatenate(ctx), return_inverse=True)
    ctx.clear()
    at *= max(len(x), 1)
    at += of
    del of
    key, c = summed(at, np.concatenate(n))
    return u, x, *np.divmod(key, max(len(x), 1)), c


PACKED = ("w", "n", "x", "ctx", "c")


def pack(u: np.ndarray, x: np.ndarray, word: np.ndarray, ctx: np.ndarray, c: np.ndarray) -> dict[str, bytes]:
    """Words, pairs of each word, contexts, contexts' places and counts as bytes; ``word``
    is sorted."""
    words_in, per = np.unique(word, return_counts=True)
    contexts_in, ctx = np.unique(ctx, return_inverse=True)
    return {"w": planes(u[words_in]), "n": narrow(per), "x": planes(x[contexts_in]), "ctx": narrow(ctx),
            "c": narrow(c)}


def unpack(row) -> tuple[np.ndarray, ...]:
    """Words, contexts, and of each pair the place of its word and of its context and its
    count."""
    u, x = hashes(row["w"]), hashes(row["x"])
    word = np.repeat(np.arange(len(u)), widened(row["n"], len(u)))
    return u, x, word, widened(row["ctx"], len(word)), widened(row["c"], len(word))


def counts(train: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: packed pair counts and a few sums."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for _, part in runs(b.column(0))):
            u, order, per, before, _ = tokens_of(part)
            key, c = summed(np.repeat(np.arange(len(u)), per) * len(u) + before[order], None)
            word, ctx = np.divmod(key, len(u))
            of = bucket_of(u, buckets)
            present = np.unique(of)
            ends = np.searchsorted(word, np.searchsorted(of, present, "right"))
            rows = {k: [] for k in PACKED}
            a = 0
            for z in ends:
                for k, v in pack(u, u, word[a:z], ctx[a:z], c[a:z]).items():
                    rows[k].append(v)
                a = z
            yield pa.RecordBatch.from_arrays([pa.array(present), *[pa.array(rows[k], pa.binary()) for k in PACKED]],
                                             names=["bucket", *PACKED])

    def whole(key, rows: pd.DataFrame) -> pd.DataFrame:
        w, ctx, n = [], [], []
        for r in rows.to_dict("records"):
            u, x, word, of, c = unpack(r)
            w.append(u[word])
            ctx.append(x[of])
            n.append(c)
        u, x, word, ctx, c = merged(w, ctx, n)
        per = np.bincount(word, minlength=len(u))
        return pd.DataFrame([{"bucket": key[0], **pack(u, x, word, ctx, c), "tokens": int(c.sum()), "known": len(u),
                              "once": int((c == 1).sum()), "twice": int((c == 2).sum()),
                              "in_one": int((per == 1).sum()), "in_two": int((per == 2).sum())}])

    kinds = ", ".join(f"{k} binary" for k in PACKED)
    sums = ", ".join(f"{k} long" for k in ("tokens", "known", "once", "twice", "in_one", "in_two"))
    return train.select(token_hashes(F.col("text")).alias("t")).mapInArrow(local, f"bucket long, {kinds}").groupBy(
        "bucket").applyInPandas(whole, f"bucket long, {kinds}, {sums}")


def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) up to ``most`` customers."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        for t in range(1, c + 2):
            sit = s[c, t] + np.log(c - t * discount) if 0 < t <= c else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], sit)
    return s


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, stirling: np.ndarray, rng) -> np.ndarray:
    """Numbers of tables of c customers each, where ``a`` is the weight of a new table."""
    t = np.ones(len(c), np.int64)
    few = (c > 1) & (c <= EXACT)
    rows = np.flatnonzero(few)
    rows = rows[np.argsort(c[rows], kind="stable")]
    ends = np.searchsorted(c[rows], np.arange(2, EXACT + 2), "left")
    u = rng.random(len(rows))
    for n, (x, y) in zip(range(2, EXACT + 1), zip(ends[:-1], ends[1:])):
        if x == y:
            continue
        r = rows[x:y]
        # tables beyond 24 have no weight worth drawing unless a is large
        weight = stirling[n, 1:n + 1] + np.log(a[r])[:, None] * np.arange(1, n + 1)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
        t[r] = 1 + (weight < (u[x:y] * weight[:, -1])[:, None]).sum(axis=1)
    r = np.flatnonzero(c > EXACT)
    at = 1
    while len(r):
        size = max(1, at // 8)
        now = np.minimum(size, c[r] - at)
        new = a[r] / (a[r] + at + (size - 1) / 2 - discount * t[r])
        t[r] += rng.binomial(now, np.clip(new, 0, 1))
        at += size
        r = r[c[r] > at]
    return t


def shown(row) -> tuple[np.ndarray, list[np.ndarray]]:
    """What the restaurants of a bucket's contexts show: customers, and tables by sweep."""
    customers, tables = [np.zeros(0, np.int64)], {}
    for r in row["shown"]:                           # by sweep and range
        if r["sweep"] == 0 and "customers" in r:
            customers.append(widened(r["customers"], r["n"]))
        tables.setdefault(r["sweep"], []).append(widened(r["tables"], r["n"]))
    return np.concatenate(customers), [np.concatenate(tables[s]) for s in sorted(tables)]


def sweeps(row, model: Model, upto: int):
    """The states of one bucket: tables of each pair, customers and tables of each word
    in the parent, before any sweep and after each of ``upto``."""
    u, _, word, ctx, c = unpack(row)
    t = np.ones(len(c), np.int64)
    m = np.bincount(word, minlength=len(u))
    mt = np.ones(len(u), np.int64)
    yield t, m, mt
    if not upto:
        return
    small = log_stirling(model.discount, EXACT)
    parent_small = log_stirling(model.parent_discount, EXACT)
    more = np.flatnonzero(c > 1)
    tables = shown(row)[1]
    base = 1.0 / (model.known + 1)
    for s in range(1, upto + 1):
        rng = np.random.default_rng([model.seed, int(row["bucket"]), s])
        p = parent_probability(m, mt, s - 1, model)
        new_table = (model.strength + model.discount * (tables[s - 1][ctx[more]] - t[more])) * p[word[more]]
        t = t.copy()
        t[more] = draw_tables(c[more], new_table, model.discount, small, rng)
        m = np.bincount(word, weights=t, minlength=len(u)).astype(np.int64)
        a = np.full(len(u), (model.strength + model.parent_discount * model.tables[s - 1]) * base)
        mt = draw_tables(m, a, model.parent_discount, parent_small, rng)
        yield t, m, mt


def parent_probability(m, mt, sweep: int, model: Model):
    """The unigram restaurant's prediction of words with m customers at mt tables."""
    new = (model.strength + model.parent_discount * model.tables[sweep]) / (model.known + 1)
    return (m - model.parent_discount * mt + new) / (model.strength + model.customers[sweep])


def returned(rounds: list[DataFrame], columns=("tables",)) -> DataFrame:
    """What the buckets were sent back after each sweep so far."""
    return reduce(DataFrame.unionAll, [r.where("bucket >= 0").select("bucket", F.lit(s).alias("sweep"), "range", "n", *columns)
                                       for s, r in enumerate(rounds)])


def seated(table: DataFrame, rounds: list[DataFrame], parts: np.ndarray) -> DataFrame:
    """The buckets, once for each of their parts, with all that their contexts' restaurants
    show. Both sides are shuffled as scoring needs them, and not again."""
    copies = table.sparkSession.createDataFrame(pd.DataFrame({
        "bucket": np.repeat(np.arange(len(parts)), parts), "part": np.concatenate([np.arange(n) for n in parts])}))
    per = returned(rounds, ("tables", "customers")).join(copies, "bucket").groupBy("bucket", "part").agg(
        F.array_sort(F.collect_list(F.struct("sweep", "range", "n", "tables", "customers"))).alias("shown"))
    return table.join(copies, "bucket").join(per, ["bucket", "part"])


def sweep_totals(table: DataFrame, rounds: list[DataFrame], model: Model, buckets: int) -> DataFrame:
    """Stored sums after a sweep: for each bucket and range of contexts the tables (before
    the first sweep also the customers) of the bucket's contexts there, and as bucket -1 all
    contexts of the range with the range's share of the parent's sums."""
    sweep = len(rounds)

    def one(row) -> pd.DataFrame:
        for t, m, mt in sweeps(row, model, sweep):
            pass
        _, x, _, ctx, c = unpack(row)
        add = lambda v: np.bincount(ctx, weights=v, minlength=len(x)).astype(np.int64)
        tables, customers = add(t), add(c) if sweep == 0 else None
        of = bucket_of(x, buckets)
        present = np.unique(of)
        ends = np.searchsorted(of, present, "right")
        cut = list(zip(np.r_[0, ends[:-1]], ends))
        head = np.arange(len(present)) == 0
        return pd.DataFrame({
            "bucket": row["bucket"], "range": present, "x": [planes(x[a:z]) for a, z in cut],
            "tables": [narrow(tables[a:z]) for a, z in cut],
            "customers": [narrow(customers[a:z]) if sweep == 0 else None for a, z in cut],
            "parent": head * int(m.sum()), "parent_tables": head * int(mt.sum())})

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for b in batches for row in b.to_dict("records")):
            yield one(row)

    def again(key, known: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        back = back.sort_values(["sweep", "range"])
        return one(known.to_dict("records")[0] | {"shown": back.to_dict("records")})

    def add_up(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = [len(x) // 8 for x in rows["x"]]
        u, at = np.unique(np.concatenate([hashes(d) for d in rows["x"]]), return_inverse=True)
        ends = np.cumsum(n)
        back = {}
        for k in ("tables", "customers"):
            if k == "customers" and sweep:
                back[k] = [None] * (len(n) + 1)
                continue
            v = np.concatenate([widened(d, size) for d, size in zip(rows[k], n)])
            total = np.zeros(len(u), np.int64)
            np.add.at(total, at, v)
            back[k] = [narrow(total[at[z - size:z]]) for z, size in zip(ends, n)] + [narrow(total)]
        return pd.DataFrame({"bucket": [*rows["bucket"], -1], "range": key[0], "n": [*n, len(u)],
                             "x": [None] * len(n) + [planes(u)], **back,
                             "parent": [0] * len(n) + [int(rows["parent"].sum())],
                             "parent_tables": [0] * len(n) + [int(rows["parent_tables"].sum())]})

    values = "x binary, tables binary, customers binary, parent long, parent_tables long"
    sent, kind = table.select("bucket", *PACKED), f"bucket long, range long, {values}"
    if rounds:
        sent = sent.groupBy("bucket").cogroup(returned(rounds).groupBy("bucket")).applyInPandas(again, kind)
    else:
        sent = sent.mapInPandas(before, kind)
    return store(sent.groupBy("range").applyInPandas(add_up, f"bucket long, range long, n long, {values}"),
                 "lm-totals")


def all_contexts(rounds: list[DataFrame], model: Model) -> DataFrame:
    """ctx and back0, back1, ...: each context once."""
    whole = [r.where("bucket = -1") for r in rounds]
    d = whole[0].select("range", "x", "customers")
    for i in range(model.samples):
        d = d.join(whole[model.burn_in + 1 + i].select("range", F.col("tables").alias(f"t{i}")), "range")

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for b in batches for row in b.to_dict("records")):
            x = hashes(row["x"]).view(np.int64)
            room = model.strength + widened(row["customers"], len(x))
            yield pd.DataFrame({"ctx": x, **{
                f"back{i}": (model.strength + model.discount * widened(row[f"t{i}"], len(x))) / room
                for i in range(model.samples)}})

    return d.mapInPandas(flat, ", ".join(["ctx long", *[f"back{i} double" for i in range(model.samples)]]))


def fit(train: DataFrame, samples: int = 2, burn_in: int = 1, strength: float = 1.0,
        seed: int = 1) -> tuple[DataFrame, Model, Places]:
    """The counts by bucket with their contexts' totals, the model's totals, and the parts
    of each bucket with the table of contexts.

    Discounts follow from how many pairs (or words) stand once and twice. The driver holds
    one number per bucket (of 9 MB of text): how many parts it has."""
    size = train.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    table = store(counts(train, buckets), "lm-counts")
    a = table.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k)
                    for k in ("tokens", "known", "once", "twice", "in_one", "in_two")]).first()
    discount = lambda one, two: min(max(one / max(one + 2 * two, 1), 0.05), 0.95)
    model = Model(a["tokens"], a["known"], np.zeros(0), np.zeros(0), discount(a["once"], a["twice"]),
                  discount(a["in_one"], a["in_two"]), strength, samples, burn_in, seed)
    rounds: list[DataFrame] = []
    for _ in range(burn_in + samples + 1):
        rounds.append(sweep_totals(table, rounds, model, buckets))
        p = rounds[-1].where("bucket = -1").agg(F.sum("parent").alias("m"), F.sum("parent_tables").alias("mt")).first()
        model.customers = np.r_[model.customers, p["m"] or 0]
        model.tables = np.r_[model.tables, p["mt"] or 0]
    tokens = {r["bucket"]: r["tokens"] for r in table.select("bucket", "tokens").collect()}  # one number a bucket
    parts = np.array([max(1, -(-tokens.get(b, 0) // PART_TOKENS)) for b in range(buckets)])
    return seated(table, rounds, parts), model, Places(parts, all_contexts(rounds, model))


def place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of ``x`` stands in the sorted ``known``; its length if nowhere."""
    at = np.searchsorted(known, x)
    found = at < len(known)
    found[found] = known[at[found]] == x[found]
    return np.where(found, at, len(known))


def bucket_scores(row, model: Model, parts: pd.DataFrame, opened: list | None = None) -> Iterator[tuple]:
    """For each packed run of tokens: first row, texts, their sums of log10 probability
    and of log10(c + 0.1), and their numbers of known and of all tokens.

    Contexts are places in the run's list ``x``, without such a list hashes. Tokens whose
    context the bucket has not met count as those of a context without customers, or, if
    ``opened`` is given, are left out and added there: first row, text, context and the
    parent's predictions by sample."""
    after = range(model.burn_in + 1, model.burn_in + model.samples + 1)
    if row is None:
        u, x, none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word, ctx, c = none, none, none
        states, customers, tables = [(none, none, none)] * len(after), none, [none] * len(after)
    else:
        u, x, word, ctx, c = unpack(row)
        states = list(sweeps(row, model, model.burn_in + model.samples))[model.burn_in + 1:]
        customers, tables = shown(row)
        tables = tables[model.burn_in + 1:]
    room = model.strength + customers
    # the share of a context's prediction that comes from the parent, by sample
    back = np.array([np.r_[(model.strength + model.discount * t) / room, 1.0] for t in tables])
    parent = np.array([np.r_[parent_probability(m, mt, s, model), parent_probability(0, 0, s, model)]
                       for (_, m, mt), s in zip(states, after)])
    own = np.mean([(c - model.discount * t) for t, _, _ in states], axis=0) / room[ctx]
    count = np.r_[np.bincount(word, weights=c, minlength=len(u)), 0.0] if len(u) else np.zeros(1)
    base = np.log10(count + 0.1)
    key = word * (len(x) + 1) + ctx
    for part in parts.to_dict("records"):
        w = hashes(part["w"])
        n = widened(part["n"], len(w))
        size = int(n.sum())
        of, doc = widened(part["ctx"], size), widened(part["doc"], size)
        asked, of = (hashes(part["x"]), of) if "x" in part else (of.view(np.uint64), np.arange(size))
        at = np.repeat(place(u, w), n)
        spot = place(x, asked)[of]
        p = np.zeros(size)
        for s in range(len(back)):
            p += back[s][spot] * parent[s][at]
        p /= len(back)
        if len(key):
            pair = at * (len(x) + 1) + spot
            there = np.minimum(np.searchsorted(key, pair), len(key) - 1)
            p += np.where(key[there] == pair, own[there], 0.0)
        if opened is not None:
            new = np.flatnonzero(spot == len(x))
            p[new] = 1.0
            opened.append((part["first"], doc[new], asked[of[new]], parent[:, at[new]]))
        texts = int(doc.max()) + 1
        every = np.bincount(doc, minlength=texts)
        docs = np.flatnonzero(every)
        add = lambda v: np.bincount(doc, weights=v, minlength=texts)[docs]
        yield part["first"], docs, add(np.log10(p)), add(base[at]), (add(at < len(u)), every[docs])


def score(docs: DataFrame, held_out: Column, table: DataFrame, model: Model, places: Places,
          waves: int = WAVES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row.

    The rows are scored in ``waves`` of equal numbers of rows, whose scores are stored each,
    so that the tokens of one wave lie in shuffle files at a time."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text",
                           F.monotonically_increasing_id().alias("place"))
    done = [store(score_wave(numbered.where(F.col("place") % waves == w), table, model, places), "lm-scores")
            for w in range(waves)]
    return reduce(DataFrame.unionAll, done)


def score_wave(docs: DataFrame, table: DataFrame, model: Model, places: Places) -> DataFrame:
    """The scores of the rows of one wave: doc_id, held_out, text."""
    split, buckets = places.parts, len(places.parts)
    packed = ("w", "n", "x", "ctx", "doc")
    shares = [f"p{i}" for i in range(model.samples)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, start_at, part_lists in ((b, *r) for b in batches for r in runs(b.column(1))):
            u, order, per, before, n = tokens_of(part_lists)
            first = b.column(0)[start_at].as_py()
            before, doc = before[order], np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
            del order
            of = bucket_of(u, buckets)
            present = np.unique(of)
            ends = np.searchsorted(of, present, "right")
            token_ends = np.cumsum(per)[ends - 1]
            rows: dict[str, list] = {k: [] for k in packed}
            a = p = 0
            for z, y in zip(ends, token_ends):
                x, ctx = np.unique(before[p:y], return_inverse=True)
                for k, v in zip(packed, (planes(u[a:z]), narrow(per[a:z]), planes(u[x]), narrow(ctx),
                                         narrow(doc[p:y]))):
                    rows[k].append(v)
                a, p = z, y
            part = (first // 1009) % split[present]
            yield pa.RecordBatch.from_arrays(
                [pa.array(present), pa.array(part), pa.array(np.full(len(present), first)),
                 *[pa.array(rows[k], pa.binary()) for k in rows]], names=["bucket", "part", "first", *rows])

    def meet(key, known: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out, opened = [], []
        for first, d, s, b, (k, every) in bucket_scores(known.to_dict("records")[0] if len(known) else None, model, parts, opened):
            _, doc, ctx, p = opened.pop()
            out.append({"first": first, "n": len(d), "doc": narrow(d), "score": s.tobytes(), "base": b.tobytes(),
                        "known": narrow(k), "tokens": narrow(every), "new_n": len(doc), "new_doc": narrow(doc), "new_ctx": ctx.tobytes(),
                        "new_p": p.tobytes()})
        return pd.DataFrame(out, columns=["first", "n", "doc", "score", "base", "known", "tokens", "new_n", "new_doc", "new_ctx",
                                          "new_p"])

    def gather(key, parts: pd.DataFrame) -> pd.DataFrame:
        rows = parts.to_dict("records")
        docs = [widened(r["doc"], r["n"]) for r in rows]
        size = max(int(d.max()) for d in docs) + 1
        sums = np.zeros((4, size))
        for r, d in zip(rows, docs):
            sums[0, d] += np.frombuffer(r["score"])
            sums[1, d] += np.frombuffer(r["base"])
            sums[2, d] += widened(r["known"], r["n"])
            sums[3, d] += widened(r["tokens"], r["n"])
        whole = pd.DataFrame({"row": key[0] + np.arange(size), "new": False, "ctx": 0, **dict.fromkeys(shares, 0.0),
                              "score": sums[0], "base": sums[1], "n_known": sums[2].astype(np.int64),
                              "n_tokens": sums[3].astype(np.int64)})
        p = np.concatenate([np.frombuffer(r["new_p"]).reshape(len(shares), r["new_n"]) for r in rows], axis=1)
        new = pd.DataFrame({"row": key[0] + np.concatenate([widened(r["new_doc"], r["new_n"]) for r in rows]),
                            "new": True, "ctx": np.frombuffer(b"".join(r["new_ctx"] for r in rows), np.int64),
                            **dict(zip(shares, p)), "score": 0.0, "base": 0.0, "n_known": 0, "n_tokens": 0})
        return pd.concat([whole, new], ignore_index=True)

    numbered = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row"))
    sent = numbered.select("row", token_hashes(F.col("text")).alias("t")).mapInArrow(
        send, "bucket long, part long, first long, " + ", ".join(f"{k} binary" for k in packed))
    known = table.select("bucket", "part", *PACKED, "shown")
    sums = known.groupBy("bucket", "part").cogroup(sent.groupBy("bucket", "part")).applyInPandas(
        meet, "first long, n long, doc binary, score binary, base binary, known binary, tokens binary, "
              "new_n long, new_doc binary, new_ctx binary, new_p binary")
    found = sums.groupBy("first").applyInPandas(
        gather, "row long, new boolean, ctx long, " + ", ".join(f"{k} double" for k in shares)
                + ", score double, base double, n_known long, n_tokens long")
    # sums look for no context; their join key is spread, so that they make no hot group
    found = found.withColumn("ctx", F.when(F.col("new"), F.col("ctx")).otherwise(F.xxhash64("row")))
    met = found.join(places.contexts.withColumnRenamed("ctx", "known_ctx"),
                     F.col("new") & (F.col("ctx") == F.col("known_ctx")), "left")
    p = sum((F.col(k) * F.coalesce(f"back{i}", F.lit(1.0)) for i, k in enumerate(shares)), F.lit(0.0)) / len(shares)
    per_row = met.groupBy("row").agg(F.sum(F.when(F.col("new"), F.log10(p)).otherwise(F.col("score"))).alias("score"),
                                     F.sum("base").alias("base"), F.sum("n_known").alias("n_known"),
                                     F.sum("n_tokens").alias("n_tokens"))
    floor = float(np.log10(model.tokens + 0.1 * (model.known + 1)))
    return numbered.select("row", "doc_id", "held_out").join(per_row, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token of the held-out and of the training texts."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))
