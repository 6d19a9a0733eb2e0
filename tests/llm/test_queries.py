"""The registered queries over a whole small table, and the pipeline, against brute force
or their SQL. The spark fixture is the session's."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from landfall.llm.queries import QUERIES, SQL, tokenizer_path
from tests.llm.cases import TEXTS, frame, low, words
from tests.llm.rules import fair_queue
from tests.llm.test_dedup import cut, fingerprint, groups
from tests.llm.test_models import brute, fair_targets
from tests.llm.test_scans import secret_row

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def result(spark, name):
    return QUERIES[name](spark, SF).toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute("SET memory_limit = '2GB'")
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda df: sorted(
        [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)
               for v in row) for row in df[sorted(df.columns)].itertuples(index=False)], key=repr)
    assert norm(got) == norm(want)


def test_suffix_dedup(spark, docs):
    got = result(spark, "op3_suffix_dedup")
    for i, *want in cut(list(zip(docs.doc_id, docs.text)), 400):
        assert list(got.loc[i][["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == want


def test_pitman_yor(spark, docs):
    got = result(spark, "op6_pitman_yor")
    tokens = {i: words(low(t)) + ["\n"] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()           # better on unseen texts than unigrams


def test_simhash(spark, docs):
    got = result(spark, "op7_simhash")
    f = [fingerprint(t) for t in docs.text]
    label = groups(f, 3)
    least = {}
    for i, g in zip(docs.doc_id, label):
        least[g] = min(i, least.get(g, i))
    for i, x, g in zip(docs.doc_id, f, label):
        assert tuple(got.loc[i]) == (f"{x:016x}", least[g])


def test_language_id(spark, docs):
    got = result(spark, "op8_language_id").join(docs.set_index("doc_id")[["lang"]])
    out = got[got.held_out]
    assert len(got) == len(docs) and (out.lang == out.lang_pred).mean() >= 0.95


def test_packing(spark, docs):
    got = QUERIES["op9_packing"](spark, SF).toPandas()
    slow = Tokenizer.from_file(tokenizer_path())
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array(slow.encode(t, add_special_tokens=False).ids + [0], "<u4")
        p = got[got.doc_id == i].sort_values("start")
        assert p.start.iloc[0] == 0 and list(p.start)[1:] == list(p.start + p.length)[:-1]
        assert p.length.sum() == len(ids) and (p.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(p.start, p.length)] == list(p.ids_crc32)


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute(list(zip(e.vec_id, e.embedding)), 10, 100)
    got = [tuple(r) for r in QUERIES["op10_neighbours"](spark, SF).collect()]
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)


def test_pipeline_stages(spark, scratch):
    """Each stage on what its predecessor kept, awkward rows included."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    rows = [r for r in TEXTS if r[0] != 11] + [(i + 1000, *r) for i, r in enumerate(
        some.select("text", "lang", "source").collect())]
    d = frame(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, scratch)
        if name != "pack":
            assert out.columns == d.columns
        path = f"{scratch}/{name}"
        out.write.parquet(path)
        d = spark.read.parquet(path)
        kept[name] = d.toPandas()
    rows_of = lambda name: [(None if i != i else int(i), t) for i, t in zip(kept[name].doc_id, kept[name].text)]
    given = {(i, t) for i, t, *_ in rows}
    first = set(rows_of("language"))
    assert first <= given and all(any(c.isalpha() for c in t or "") for _, t in first)
    texts = [t for _, t in rows_of("language")]
    label = groups([fingerprint(t) for t in texts], 3)
    least = {}
    for (i, t), g in zip(rows_of("language"), label):
        key = (i is None, i or 0)
        least[g] = min(least.get(g, (key, t)), (key, t), key=lambda x: x[0])
    assert {t for _, t in least.values()} == {t for _, t in rows_of("near_dedup")} and len(least) == len(kept["near_dedup"])
    clean = [(i, t) for i, t in rows_of("near_dedup") if not secret_row(i, t)[4]]
    assert sorted(rows_of("secrets"), key=repr) == sorted(clean, key=repr)
    three = [(i, t, s) for (i, t), s in zip(rows_of("secrets"), kept["secrets"].source)]
    sizes = Counter()
    for _, t, s in three:
        sizes[s] += len(words(t))
    taken = fair_queue(three, fair_targets(sizes))
    want = Counter({i: taken[i] // len(words(t)) for i, t, _ in three if words(t)})
    assert Counter(i for i, _ in rows_of("mix")) == +want
    slow = Tokenizer.from_file(tokenizer_path())
    total = sum(len(slow.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of("mix"))
    assert kept["pack"].length.sum() == total and set(kept["pack"].doc_id.dropna().astype(int)) == {i for i, _ in rows_of("mix") if i is not None}


def test_stages_keep_any_column(spark, scratch):
    """Names with dots, blanks and the operators' own names come through every stage."""
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("a.b", "row", "copies", "x y", "_row"):
        d = d.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, scratch)
        if name != "pack":
            assert out.columns == d.columns
        out.write.parquet(f"{scratch}/{at}")
        d = spark.read.parquet(f"{scratch}/{at}")
        if name != "pack":
            assert d.where("`a.b` <> concat('a.b', doc_id) or `x y` <> concat('x y', doc_id)").count() == 0 < d.count()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.sum("length")).first()[0] > 0 and not corpus_pipeline.ORACLE_SQL

