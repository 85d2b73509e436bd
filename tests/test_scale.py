"""Batches and searches send and hold no more than they need."""

import os

import numpy as np
import pytest

from quern.functions.text import STOP_WORDS, Analyzer
from quern.operators import lexical, vector
from quern.operators.ann import IvfIndex
from quern.operators.lexical import Index
from quern.operators.stored import StoredIndex
from quern.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hits(df):
    return sorted((r.query_id, r.rank, r.ord, r.score) for r in df.collect())


def some_vectors(spark, n=700, dim=8):
    v = np.random.default_rng(5).integers(-2, 3, (n, dim)).astype(float)  # many ties, some zero vectors
    v[: n // 4] = v[0]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord bigint, vector array<double>").repartition(3)


def brute(v, k, metric, within=None):
    u = v / np.where((s := np.sqrt((v * v).sum(1, keepdims=True))) > 0, s, np.nan) if metric == "cosine" else v
    s = np.round(-((u[:, None] - u) ** 2).sum(2) if metric == "l2" else u @ u.T, 6) + 0.0
    s[np.isnan(s)] = -np.inf
    if within is not None:
        s[~within] = -np.inf
    return [(q, n + 1, int(o), x[o]) for q, x in enumerate(s) for n, o in enumerate(np.lexsort((np.arange(len(x)), -x))[:k]) if x[o] > -np.inf]


def test_cells_meet_groups_of_queries_without_a_join(spark, tmp_path, monkeypatch):
    """a query isn't sent once for each cell, and blocks aren't joined."""
    monkeypatch.setattr(vector, "BLOCK", 100)
    monkeypatch.setattr(vector, "GROUP", 100)  # several groups and shares
    v, df = some_vectors(spark)
    index = IvfIndex.write(df, str(tmp_path / "v"))
    out = index.search_batch(df.withColumnRenamed("ord", "query_id"), 7)
    assert "Join" not in plan(out)
    cell = {r.ord: r.cell for r in index.rows.collect()}
    near = index.probed(v)
    within = np.array([[cell.get(j) in set(c) for j in range(len(v))] for c in near])
    assert hits(out) == brute(v, 7, "cosine", within)


def test_exact_batches_in_groups(spark, monkeypatch):
    """no join of blocks, and the same rows as by brute force, for each metric."""
    monkeypatch.setattr(vector, "BLOCK", 100)
    monkeypatch.setattr(vector, "GROUP", 100)
    v, df = some_vectors(spark, 400)
    for metric in vector.METRICS:
        out = vector.search_vector_batch(df, df.withColumnRenamed("ord", "query_id"), 7, metric)
        assert "Join" not in plan(out)
        assert hits(out) == brute(v, 7, metric)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", "search_text_synonym search_text_batch hybrid_batch search_wildcard_infix search_text_ngram bool_mixed search_fuzzy_1 stemmed_search".split())
def test_one_search_stores_no_index(spark, tmp_path, monkeypatch, name):
    """F1, F3 to F5, F7 to F10: a search reads the documents instead of storing all of their postings first."""
    monkeypatch.setattr(catalogue, "shared_folder", lambda _: str(tmp_path))
    found = catalogue.QUERIES[name](spark, DIR)
    assert found.count() and not list(tmp_path.iterdir())


def test_stems_within_rows(spark):
    """stemming joins and gathers nothing."""
    texts = ["running dogs RUNNING", None, "", "straße hopeful nationalities x"]
    tokens = Index.of(spark.createDataFrame(list(enumerate(texts)), "ord bigint, text string"), Analyzer("whitespace", stemming=True)).tokens
    assert "Join" not in plan(tokens) and "Aggregate" not in plan(tokens)
    got = {r.ord: ([tuple(t) for t in r.tokens], r.dl) for r in tokens.collect()}
    want = {i: Analyzer("whitespace", stemming=True)(t or "") for i, t in enumerate(texts)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_batch_of_queries_keeps_the_best_of_each(spark, tmp_path):
    """matches are scored where the documents are; ties, many hits and unknown words as in the index by term."""
    docs = spark.createDataFrame([(i, "a b c d"[: 1 + 2 * (i % 4)] + " x" * (i % 3)) for i in range(500)] + [(500, None), (501, "")], "ord bigint, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "d x x"), (3, "nowhere"), (4, ""), (5, "a b c d x")], "query_id bigint, text string")
    index = Index.of(docs, Analyzer("whitespace"))
    out = lexical.search_text(index, queries, 7)
    assert "Join" not in plan(out)
    want = hits(lexical.search_text(StoredIndex.write(index, str(tmp_path / "i")), queries, 7))
    assert hits(out) == want and len(want) == 21


@pytest.mark.parametrize("what", ["positions", "postings"])
def test_postings_are_counted_within_rows(spark, what):
    """nothing is shuffled where every document has one row; rows of one ord still count as one."""
    once = spark.createDataFrame([(0, "b a b"), (1, None), (2, "a")], "ord bigint, text string").coalesce(1)
    twice = once.union(spark.createDataFrame([(0, "c b a")], "ord bigint, text string"))
    index = lambda docs: Index(docs.select("ord", Analyzer("whitespace").tokens(docs.text).alias("tokens")).selectExpr("*", "cast(size(tokens) as bigint) as dl"), Analyzer("whitespace"))
    one, two = (getattr(index(d), what)() for d in (once, twice))
    assert "Exchange" not in plan(one)
    found = lambda df: {(r.ord, r.term): (r.tf, r.positions if what == "positions" else r.dl) for r in df.collect()}
    assert found(one) == {(0, "a"): (1, [1] if what == "positions" else 3), (0, "b"): (2, [0, 2] if what == "positions" else 3), (2, "a"): (1, [0] if what == "positions" else 1)}
    assert found(two)[0, "b"] == (3, [0, 1, 2] if what == "positions" else 3) and len(found(two)) == 4


def test_stop_words_are_a_set(spark):
    """a term is looked up, not held against every stop word."""
    texts = ["The cat and 天気予報 of the-hat", "no", None, "我 很 好 ok"]
    a = Analyzer("ngram", stop_words=STOP_WORDS)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = df.select("i", a.tokens(df.text).alias("t"))
    assert "array_contains" not in plan(out)
    assert {r.i: [tuple(t) for t in r.t] for r in out.collect()} == {i: a(t or "") for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_plain_texts_fold_in_the_jvm(spark):
    """only texts with other characters go to Python."""
    assert "RLIKE" in plan(catalogue.nfkc_fold(spark, DIR))
