"""Urls, vectors and tool calls; registered SQL; the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planewatch.llm import queries, tool_calls, url_filters, vector_search
from tests.llm.test_documents import shingles, words
from tests.test_queries import TABLES, as_text


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert as_text(df.select(columns).collect()) == as_text(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org/x?y://z", "http://example.org/es/1", "http://www.Example.org/en/17#a", "https://b.com/fr/", "https://com/de/x", "http://xcom/de/", "x://bad.example/p", "http://a.org"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[4], "x", "y")], "page_id long, url string, key string, listed string")
    listed = spark.createDataFrame([("bad.example",), (None,), ("elsewhere",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(pages, url_filters.RULES, listed).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == got[None] == ("a.org", "/x", "org/", "allow")
    assert got[5] == ("example.org", "/es/1", "example.org/es/", "block") and got[6] == ("www.example.org", "/en/17", "example.org/en/1", "block")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10][2:] == (None, "block") and got[11] == ("a.org", "", None, "allow")
    assert url_filters.judged(pages.limit(0), [], listed).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 26, 2000])
def test_cascade_is_exact(spark, most_bits, monkeypatch):
    monkeypatch.setattr(url_filters, "FIRST_BITS", 3)  # many false positives: several levels
    monkeypatch.setattr(url_filters, "LATER_BITS", 2)
    rows = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("host"), (F.col("id") % 3 == 0).alias("want"))
    listed = rows.where("want").select(F.col("host").alias("key"))
    assert url_filters.with_listed(rows, listed, "host", most_bits).where("listed <> want").count() == 0
    assert url_filters.with_listed(rows, listed.limit(0), "host").where("listed").count() == 0


def vectors(spark, array, more=()):
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(array)] + list(more)
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, vector int")


def check_search(got, x, recall=1.0):
    x = np.asarray(x, np.float32).astype(float)
    hit = total = 0
    for q in range(0, len(x), 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[: min(20, len(x) - 1)]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(want) + 1))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(want.tolist()))
        total += len(want)
    assert hit >= recall * total


def test_search_small_ties_and_bad_vectors(spark):
    x = np.r_[np.random.default_rng(0).normal(size=(30, 4)), np.ones((40, 4))]
    bad = [(900, None), (901, [0.0] * 4), (902, [float("nan"), 1.0, 1.0, 1.0]), (903, [None, 1.0, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0, 1.0]), (905, [9.0]), (None, [9.0] * 4), (3, [float(v) for v in x[3].astype(np.float32)])]
    rows = vectors(spark, x, bad)
    check_search(vector_search.nearest(rows, F.col("vec_id") % 20 == 0).collect(), x)
    check_search(vector_search.nearest(vectors(spark, x[:5]), F.col("vec_id") % 20 == 0).collect(), x[:5])
    assert vector_search.nearest(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall_and_hot_list(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector_search, "LIST_ROWS", 100)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 7)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16))
    x = np.r_[centres[draw.integers(0, 30, 4000)] + 0.3 * draw.normal(size=(4000, 16)), np.tile(centres[:1], (1000, 1))]
    check_search(vector_search.nearest(vectors(spark, x), F.col("vec_id") % 20 == 0).collect(), x, 0.9)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "search", '{"query": "x", "limit": 2}', None), (1, 3, "b", "search", '{"limit": "2", "z": {"b":1,"a":2}}', "a"),
            (1, 5, "c", "nope", "{}", "b"), (1, 6, "c", "nope", "{}", "b"), (2, 1, "a", "search", "[1]", "b"), (2, 2, "b", "search", None, "a"),
            (2, 3, "d", "translate", '{"text": null, "language": "en"}', "zz"), (None, 1, "a", "search", "{}", None), (3, None, None, "search", "{}", None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after string",
    ).withColumn("level", F.lit("x"))
    results = spark.createDataFrame([(1, 2, "a", "r"), (1, 4, "b", None), (1, 4, "b", "r2"), (9, 1, "q", "lone")], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(calls, results, tool_calls.SCHEMAS).collect()}
    say = {k: (r.level, r.errors) for k, r in got.items()}
    assert say == {
        (1, "a"): (0, None), (1, "b"): (1, "duplicate_result,type:limit,missing:query,extra:z"), (1, "c"): (2, "duplicate_call,no_result,unknown_tool"),
        (2, "a"): (None, "no_result,cycle,not_json"), (2, "b"): (None, "no_result,cycle,not_json"), (2, "d"): (0, "no_result,unknown_after,type:text"),
        (9, "q"): (None, "no_call"),
    }
    assert got[1, "a"].json == '{"after":null,"arguments":{"limit":2,"query":"x"},"call_id":"a","content":"r","errors":null,"level":0,"name":"search"}'
    assert '"arguments":{"limit":"2","z":{"a":2,"b":1}}' in got[1, "b"].json
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), tool_calls.SCHEMAS).count() == 0


def test_pipeline(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == columns and {i for i, _ in after} <= set(before)
        if name == "near_dedup":
            sets = [shingles(t, 2) for _, t in after]
            assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
        if name == "substring_dedup":
            own = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, t in after for w in [words(t)]}
            earlier = set()
            for i in sorted(before):
                w = words(before[i])
                spans = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
                assert not spans & earlier or own.get(i, set()) != spans
                earlier |= spans
        if name == "mixing":
            assert all(before[i] == t for i, t in after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    for given in (odd, empty):
        docs = given
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()
