"""Mixing, language model, language ID, packing and neighbours."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landfall.llm import language_id, mixing, neighbours, packing, pitman_yor
from landfall.llm.text import id_crc
from tests.llm.cases import TEXTS, by_row, frame, low, words
from tests.llm.rules import fair_queue

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fair_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """The rule as written: give by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, full = share * sum(sizes.values()), set()
    while rest > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        give, rest = rest, 0.0
        for s in open_:
            target[s] += give * w[s] / total
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("rows_per_range", [3, 4096])
def test_mix(spark, rows_per_range):
    r = random.Random(0)
    rows = TEXTS + [(i, "w " * r.randint(0, 60), "en", r.choice("abcdefgg")) for i in range(100, 400)]
    got = mixing.mix(frame(spark, rows), rows_per_range=rows_per_range).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = fair_targets(sizes)
    taken, largest = Counter(), Counter()
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(want[g["source"]])
        assert g["taken"] in (0, g["size"], 2 * g["size"])
        taken[g["source"]] += g["taken"]
        largest[g["source"]] = max(largest[g["source"]], g["size"])
    assert len(got) == len(rows)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(largest.values())
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), rows_per_range=50)
    columns = ["doc_id", "size", "taken"]
    assert by_row(again, columns) == sorted(((g["doc_id"], g["size"], g["taken"]) for g in got), key=repr)


def test_mix_is_the_fair_queue(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 40), "en", r.choice(["a", "b", "b", None])) for i in range(150)]
    got = {g["doc_id"]: g["taken"] for g in mixing.mix(frame(spark, rows), rows_per_range=11).collect()}
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    assert got == fair_queue([(i, t, s) for i, t, _, s in rows], fair_targets(sizes))


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_repeated_and_null_ids_keep_targets(spark, monkeypatch, chunk):
    """A third of the rows without an id, one id in another third, and one row many times."""
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    r = random.Random(3)
    text = lambda: "w " * r.randint(1, 30) + str(r.random())
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, text(), "en", f"s{i % 4 if i % 5 else 0}") for i in range(1200)]
    rows += [(77, "one row that stands very often", "en", "s2")] * 400 + [(None, None, "en", "s1")] * 3
    docs = frame(spark, rows).withColumn("n_chars", F.col("n_chars") + F.when(F.rand(1) < 0.5, 1).otherwise(0))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    mixed = mixing.mix(docs, rows_per_range=50)
    got, sizes, taken = mixed.collect(), Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    for g in got:
        taken[g["source"]] += g["taken"]
    want = fair_targets(sizes)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 70 for s in sizes)
    per = Counter()
    for g in got:
        per[g["doc_id"]] += g["taken"]
    assert per == Counter(fair_queue([(i, t, s) for i, t, _, s in rows], want))
    out = Counter((x["doc_id"], x["text"], x["source"]) for x in mixing.apply_mix(docs, mixed).collect())
    assert sum(n * len(words(t)) for (_, t, _), n in out.items()) == sum(taken.values())
    times = Counter()
    for g in got:
        times[g["place"]] += g["taken"] // g["size"] if g["size"] else 0
    assert sorted(out.values()) == sorted(v for v in times.values() if v)


def test_mixed_rows_stand_as_often_as_taken(spark):
    docs = frame(spark)
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for m in mixed.collect():
        if m["size"]:
            want[m["doc_id"]] += m["taken"] // m["size"]
    assert Counter(x["doc_id"] for x in out.collect()) == +want


@pytest.mark.parametrize("run_tokens", [1_500_000, 50])
def test_language_model(spark, monkeypatch, run_tokens):
    monkeypatch.setattr(pitman_yor, "RUN_TOKENS", run_tokens)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 16)      # several buckets
    r = random.Random(1)
    rows = TEXTS + [(i, " ".join(r.choice(["the", "of", "a", f"w{r.randint(0, 50)}"]) for _ in range(r.randint(0, 80))), "en", "a")
                    for i in range(100, 220)]
    docs = frame(spark, rows).coalesce(3)
    held = id_crc(F.col("doc_id")) % 10 == 0
    got = {}
    for g in pitman_yor.score(docs, held, *pitman_yor.fit(docs.where(~held))).collect():
        got.setdefault(g["doc_id"], []).append(g)
    c = Counter()
    tokens = [(i, words(low(t)) + ["\n"]) for i, t, *_ in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, w in tokens:
        if not out(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens:
        g = got[i].pop()
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out(i), len(w), sum(x in c for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert g["score"] < 0
    assert not any(got.values())
    scored = pitman_yor.score(docs, held, *pitman_yor.fit(docs.where(~held)))
    p = {x["held_out"]: x for x in pitman_yor.perplexity(scored).collect()}
    assert p[False]["perplexity"] < p[False]["base_perplexity"]


def test_counts_above_32_bits_keep_their_value():
    for c in ([1, (1 << 32) + 5, 7], [1, 2, (1 << 32) - 1]):
        u, x, word, ctx, n = pitman_yor.merged([np.array([9, 4, 4], np.uint64)], [np.array([3, 2, 1], np.uint64)], [np.array(c)])
        got = pitman_yor.unpack(pitman_yor.pack(u, x, word, ctx, n))
        assert [g.tolist() for g in got] == [u.tolist(), x.tolist(), word.tolist(), ctx.tolist(), n.tolist()]
        assert got[4].sum() == sum(c)


def test_every_context_has_its_own_restaurant(spark, monkeypatch):
    """Customers of 6,000 contexts are those of the texts, and a context's predictions over
    all words, met by their buckets or not, sum to one."""
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 15)
    r = random.Random(4)
    texts = [" ".join(f"v{r.randint(0, 6000)}" if r.random() < 0.7 else "the" for _ in range(400)) for _ in range(60)]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    table, model, places = pitman_yor.fit(docs)
    want = Counter(x for t in texts for x in ["\n", *words(t)])
    hashed = dict(spark.createDataFrame([(x,) for x in want], "w string").select("w", F.xxhash64("w")).collect())
    rows = [x.asDict() for x in table.collect()]
    assert len(places.parts) > 3 and len(want) > 4096
    customers = {}
    for row in rows:
        customers |= dict(zip(pitman_yor.unpack(row)[1].view(np.int64).tolist(), pitman_yor.shown(row)[0].tolist()))
    assert customers == {hashed[x]: n for x, n in want.items()}
    back = {x["ctx"]: (x["back0"], x["back1"]) for x in places.contexts.collect()}
    assert set(back) == set(customers)
    import pandas as pd
    for ctx in [hashed["the"], hashed["\n"], hashed["v1"], hashed["v77"]]:
        total = 0.0
        for row in [*rows, None]:
            w = pitman_yor.unpack(row)[0] if row else np.array([1], np.uint64)
            part = pd.DataFrame([{"first": 0, "w": pitman_yor.planes(w), "n": pitman_yor.narrow(np.ones(len(w), int)),
                                  "x": pitman_yor.planes(np.array([ctx])), "ctx": pitman_yor.narrow(np.zeros(len(w), int)),
                                  "doc": pitman_yor.narrow(np.arange(len(w)))}])
            opened = []
            (_, _, s, _, _), = pitman_yor.bucket_scores(row, model, part, opened)
            (_, doc, x, p), = opened
            assert set(x.view(np.int64).tolist()) <= {ctx}
            total += (10 ** np.delete(s, doc)).sum() + (np.array(back[ctx])[:, None] * p).mean(axis=0).sum()
        assert total == pytest.approx(1.0)


def test_table_draws_follow_the_exact_distribution():
    d, a, c = 0.6, 0.8, 6
    s = pitman_yor.log_stirling(d, 64)
    t = pitman_yor.draw_tables(np.full(40_000, c), np.full(40_000, a), d, s, np.random.default_rng(0))
    weight = np.exp(s[c, 1:c + 1]) * a ** np.arange(1, c + 1)
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / 40_000, weight / weight.sum(), atol=0.01)
    many = pitman_yor.draw_tables(np.array([1, 100, 10_000]), np.full(3, 2.0), d, s, np.random.default_rng(0))
    assert many[0] == 1 and 1 < many[1] <= 100 and many[1] < many[2] < 10_000


def test_language_id(spark):
    r = random.Random(2)
    words_of = {"en": ["the", "thing", "of", "shall"], "de": ["der", "übung", "nicht", "schön"], "fr": ["le", "été", "où", "chose"]}
    rows = [(i, " ".join(r.choices(words_of[k], k=30)), k, "a") for i, k in enumerate(random.Random(3).choices(list(words_of), k=300))]
    rows += [(1000, "der schön übung nicht", None, "a"), (1001, None, "en", "a"), (1002, "123 !? \n", "en", "a"), (1003, "", None, None)]
    docs = frame(spark, rows)
    model = language_id.learn(docs.where(F.col("doc_id") < 200))
    got = {x["doc_id"]: x for x in language_id.predict(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows[:300])
    assert got[1000]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1001, 1002, 1003)").count() == 0
    assert kept.count() == 301
    unknowing = language_id.learn(frame(spark, [(1, "abc", None, None)]))
    assert {x["lang_pred"] for x in language_id.predict(docs, unknowing).collect()} == {"und"}


def test_languages_of_few_documents(spark):
    three = [(1, "the cat sat here", "en", "a"), (2, "der hund schläft", "de", "a"), (3, "où est la clé", "fr", "a")]
    model = language_id.learn(frame(spark, three))
    got = {x["doc_id"]: x for x in language_id.predict(frame(spark, three), model).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.5 for i, _, k, _ in three)
    assert language_id.keep_known(frame(spark, three), model).count() == 3
    foreign = frame(spark, [(4, "Ж" * 9, "ru", "a")])
    assert language_id.predict(foreign, model).first()["lang_pred"] == "und"
    assert language_id.keep_known(foreign, model).count() == 0
    r = random.Random(6)
    many = [(i, " ".join(r.choices(["the", "thing", "of", "shall", "which"], k=4000)), "en", "a") for i in range(10, 40)]
    rare = (50, "þetta er íslenska og hún er falleg", "is", "a")
    model = language_id.learn(frame(spark, [*many, rare]))
    got = language_id.predict(frame(spark, [rare, (51, "hún er íslenska", None, "a")]), model).collect()
    assert {x["lang_pred"] for x in got} == {"is"}


def test_grams_stay_in_words_and_texts():
    letter = language_id.letters_table()
    assert len(language_id.grams(["", "1 2"], letter)[0]) == 0
    one, _ = language_id.grams(["ab cd"], letter)
    two, owner = language_id.grams(["ab", "cd"], letter)
    assert sorted(one) == sorted(two) and set(owner) == {0, 1}


def test_packing_round_trip(spark):
    rows = TEXTS + [(40, "<|endoftext|> is ordinary", "en", "a")]
    got = {}
    for p in packing.decompose(frame(spark, rows), PATH, 64).collect():
        got.setdefault(p["doc_id"], []).append(p)
    slow = Tokenizer.from_file(PATH)
    seen = set()
    for i, t, *_ in {(r[0], r[1]): r for r in rows}.values():
        want = slow.encode(t or "", add_special_tokens=False).ids + [0]
        p = sorted(got[i], key=lambda x: (x["start"], x["sequence_id"]))
        n = 2 if i == 11 else 1                            # a repeated row
        for copy in range(n):
            mine = p[copy::n]
            ids = [x for q in mine for x in q["ids"]]
            assert ids == want
            for q in mine:
                assert q["length"] & (q["length"] - 1) == 0 and q["length"] <= 64 and q["offset"] == 0
                assert q["doc_tokens"] == len(want)
                assert q["ids_crc32"] == zlib.crc32(np.array(q["ids"], "<u4").tobytes())
                seen.add(q["sequence_id"])
    assert len(seen) == sum(map(len, got.values()))


def test_pieces_of_one_length_lie_together(spark, scratch):
    """Batches come from one bucket; a bucket's folder holds its pieces, and none is lost."""
    docs = frame(spark, TEXTS + [(100 + i, "word " * (i % 90 + 1), "en", "a") for i in range(300)])
    pieces = packing.decompose(docs, PATH, 64)
    rows = lambda df: by_row(df, ["doc_id", "start", "length", "ids_crc32", "sequence_id"])
    assert rows(packing.bucketed(pieces)) == rows(pieces)
    parts = packing.bucketed(pieces).withColumn("p", F.spark_partition_id()).select("p", "bucket", "length").collect()
    order = [(r["p"], r["bucket"]) for r in parts]
    assert order == sorted(order) and all(r["length"] == 1 << r["bucket"] for r in parts)
    packing.write_buckets(pieces, f"{scratch}/pieces")
    back = spark.read.parquet(f"{scratch}/pieces")
    assert rows(back) == rows(pieces)
    assert back.where("bucket = 3").select("length").distinct().collect()[0]["length"] == 8


def test_vocabulary_is_the_file_s(tmp_path):
    encode, slow = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("", "a  b\n\n c'll 123 ĂéÜ 😀", "\x00\x1f\x7f", "日本語 テスト\r\n\t  x", "<|endoftext|>"):
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids
    assert json.load(open(PATH))["model"]["type"] == "BPE"


def brute(rows, k, every):
    """By row: every row with a fitting id asks, every other row of its length may answer."""
    out = []
    for length in sorted({len(v) for _, v in rows}):
        part = [(i, v) for i, v in rows if len(v) == length]
        ids = np.array([neighbours.NO_ID if i is None else i for i, _ in part])
        x = np.array([v for _, v in part], dtype=np.float64)
        for at in np.flatnonzero((ids % every == 0) & (ids != neighbours.NO_ID)):
            d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
            order = [o for o in np.lexsort((ids, d)) if o != at][:k]
            out += [(int(ids[at]), n + 1, None if ids[o] == neighbours.NO_ID else int(ids[o]), float(d[o])) for n, o in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_rows, block", [(8192, 4096), (64, 3)])
def test_neighbours(spark, cell_rows, block):
    r = np.random.default_rng(5)
    vectors = np.float32(r.standard_normal((600, 16)) + 3 * r.standard_normal((12, 16))[r.integers(0, 12, 600)])
    rows = [(i, vectors[i].tolist()) for i in range(600)] + [(1000 + i, vectors[5].tolist()) for i in range(60)]
    odd = [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [float("nan")] * 16), (2400, [1.0, None] * 8),
           (2500, [float("inf")] + [1.0] * 15), (2600, [1.0] * 3), (None, [1.0] * 16), (0, vectors[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df, 10, query_every=20, cell_rows=cell_rows, block=block, sample=300)
    got = sorted(((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got.collect()), key=repr)
    want = brute(rows + [o for o in odd if o[0] in (None, 0, 2600)], 10, 20)
    assert sorted((g[:2] for g in got), key=repr) == sorted((w[:2] for w in want), key=repr)
    recall = len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) / len(want)
    assert recall >= 0.9
    same = {(w[0], w[2]): w[3] for w in want}
    assert all(g[3] == same.get((g[0], g[2]), g[3]) for g in got)


def test_rows_count_and_not_ids(spark):
    """An id with two vectors is found by both; lengths are searched apart; equal rows stand for themselves."""
    rows = [(0, [9.0] * 8), (50, [-500.0] * 8), (50, [9.1] * 8), (7, [300.0] * 8), (100, [1.0, 2.0]), (3, [1.0, 2.5]), (None, [1.0, 2.0]),
            (200, [4.0] * 8), (200, [4.0] * 8), (200, [5.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in neighbours.nearest(df, 3).collect()), key=repr)
    want = brute(rows, 3, 100)
    assert got == [(*w[:3], pytest.approx(w[3])) for w in want] and (0, 1, 50, pytest.approx(0.08 ** 0.5)) in got
    assert [g[2] for g in got if g[0] == 100] == [None, 3]


def test_few_and_no_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], kind)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], kind)
    assert [(x["vec_id"], x["rank"]) for x in neighbours.nearest(three).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(empty, mixing.mix(empty)).count() == 0
    assert packing.decompose(empty, PATH).count() == 0
    table, model, buckets = pitman_yor.fit(empty)
    assert pitman_yor.score(empty, F.lit(True), table, model, buckets).count() == 0
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
    some = frame(spark)
    table, model, buckets = pitman_yor.fit(empty)
    assert pitman_yor.score(some, F.lit(True), table, model, buckets).where("n_known > 0").count() == 0


def test_long_texts_are_cut_without_changing_their_grams(monkeypatch):
    letter = language_id.letters_table()
    texts = ["", "one", "ab cd\nef  gh " * 40, "x" * 300 + " tail", "ΑΣ ΣΑΣ " * 50, " \n" * 100, "end " + "y" * 200]
    whole = [sorted(language_id.grams([t], letter)[0].tolist()) for t in texts]
    monkeypatch.setattr(language_id, "CHUNK", 50)
    got = [[] for _ in texts]
    for of, run in language_id.chunks(texts):
        h, owner = language_id.grams(run, letter)
        for x, o in zip(h.tolist(), owner.tolist()):
            got[of[o]].append(x)
    assert [sorted(x) for x in got] == whole


def test_texts_are_split_once_to_be_scored(spark):
    """The number of a text's tokens comes with its sums, not from splitting the text again;
    letters outside A-Z keep their case beside ASCII and other texts."""
    from landfall.llm import pitman_yor
    from landfall.llm.text import lower_ascii
    docs = spark.createDataFrame([(1, "A b A"), (2, None), (3, ""), (4, "İ Ä B"), (5, "b  b\n")], "doc_id long, text string")
    got = pitman_yor.score_wave(docs.withColumn("held_out", F.col("doc_id") == 1), *pitman_yor.fit(docs.where("doc_id > 1")))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: 4, 2: 1, 3: 1, 4: 4, 5: 3}
    assert [r[0] for r in docs.orderBy("doc_id").select(lower_ascii(F.col("text"))).collect()] == \
        ["a b a", None, "", "İ Ä b", "b  b\n"]
