"""The stored index, block pruning, approximate vectors, and what collections keep beside their log."""

import random
import sys
import types

import numpy as np
import pytest

from quern.functions.query import Condition, meta
from quern.functions.text import Analyzer, byte_offsets, fold_full
from quern.operators import lexical, stored, vector
from quern.operators.ann import IvfIndex
from quern.operators.lexical import Bm25, Index
from quern.operators.stored import StoredIndex, search_text_pruned
from quern.sources.collection import Collection, CollectionError, Kind, Options


def table(spark, n=300, seed=1):
    from pyspark.sql import functions as F

    r = random.Random(seed)
    rows = [(i * 37, " ".join(r.choice("alpha beta gamma delta eps alphb gamut zeta".split()) for _ in range(r.randint(0, 30))), r.choice(["en", "de"])) for i in range(n)]
    return spark.createDataFrame(rows, "ord bigint, text string, lang string").withColumn("meta", meta(lang=(F.col("lang"), "str"))).drop("lang")


def rows(df):
    return [tuple(r) for r in df.orderBy(*[c for c in ("query_id", "rank", "term") if c in df.columns]).collect()]


SEARCHES = {
    "text": lambda i: lexical.search_text(i, "alpha beta nowhere"), "batch": lambda i: lexical.search_text(i, {1: "alpha", 2: "zeta eps", 3: "nowhere"}, 5), "near": lambda i: lexical.search_near(i, "alpha beta", 2),
    "phrase": lambda i: lexical.search_phrase(i, "alpha beta"), "bool": lambda i: lexical.bool_search(i, "+alpha beta -zeta"), "fuzzy": lambda i: lexical.search_fuzzy(i, "alpha", 1),
    "wildcard": lambda i: lexical.search_wildcard(i, "ga*"), "explain": lambda i: lexical.explain(i, "alpha zeta nowhere", 37), "filter": lambda i: lexical.search_text(i, "alpha", where=Condition("lang", "eq", "de")),
    "plus": lambda i: lexical.search_text(i, "alpha beta", params=Bm25(delta=1.0)),
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    derived = Index.of(table(spark), Analyzer("whitespace"))
    path = str(tmp_path_factory.mktemp("index"))
    StoredIndex.write(derived, path)
    return derived, StoredIndex.open(spark, path, derived.analyzer)


@pytest.mark.parametrize("name", SEARCHES)
def test_stored_as_derived(both, name):
    want = rows(SEARCHES[name](both[0]))
    assert rows(SEARCHES[name](both[1])) == want and want


def test_a_table_of_queries(both, spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zeta")], "query_id bigint, text string")
    assert rows(lexical.search_text(both[1], queries)) == rows(lexical.search_text(both[0], queries))


def test_many_expansions_are_joined(both, monkeypatch):
    monkeypatch.setattr(lexical, "EXPANDED", 1)
    monkeypatch.setattr(stored, "FILTER_WORDS", 1)
    assert rows(lexical.search_wildcard(both[1], "*a*")) == rows(lexical.search_wildcard(both[0], "*a*"))


def test_block_pruning_keeps_the_result(spark, both, monkeypatch, tmp_path):
    monkeypatch.setattr(stored, "BLOCK", 256)
    monkeypatch.setattr(stored, "BUCKET_WORDS", 500)
    index = StoredIndex.write(both[0], str(tmp_path / "i"))
    assert index.stats["buckets"] > 1
    for q, k in (("alpha beta", 3), ("zeta", 10), ("alpha beta gamma delta eps", 1), ("nowhere", 4), ("alpha zeta", 1000)):
        assert rows(search_text_pruned(index, q, k)) == rows(lexical.search_text(both[0], q, k).drop("query_id"))


def test_versions(spark, both, tmp_path):
    path = str(tmp_path / "i")
    assert StoredIndex.open(spark, path, both[0].analyzer) is None
    StoredIndex.write(both[0], path)
    small = Index.of(table(spark, 5), both[0].analyzer)
    StoredIndex.write(small, path)
    assert StoredIndex.open(spark, path, both[0].analyzer).stats["n_docs"] == 5
    assert StoredIndex.drop_old(spark, path) == 1 and StoredIndex.open(spark, path, both[0].analyzer).term_stats().count() == small.term_stats().count()
    empty = StoredIndex.write(Index.of(table(spark, 0), both[0].analyzer), path)
    assert rows(lexical.search_text(empty, "alpha")) == [] == rows(search_text_pruned(empty, "alpha"))


def test_compaction(spark, both, tmp_path):
    docs = table(spark)
    live = docs.where("ord % 2 = 0")
    held = StoredIndex.write(both[0], str(tmp_path / "i"))
    assert held.compact(live, str(tmp_path / "i"), 0.9) is held
    now, want = held.compact(live, str(tmp_path / "i"), 0.2), Index.of(live, both[0].analyzer)
    for f in SEARCHES.values():
        assert rows(f(now)) == rows(f(want))


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_ivf(spark, tmp_path, metric):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * 4
    v = centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 16))
    data = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0])]
    vectors = spark.createDataFrame(data, "ord bigint, vector array<float>")
    IvfIndex.write(vectors, str(tmp_path / "v"), metric)
    index = IvfIndex.open(spark, str(tmp_path / "v"))
    queries = vectors.where("ord % 30 = 0 and ord < 1500").selectExpr("ord as query_id", "vector")
    gather = lambda df: {(x.query_id, x.ord) for x in df.collect()}
    exact = gather(vector.search_vector_batch(vectors, queries, 10, metric))
    assert gather(index.search_batch(queries, probes=10**6)) == exact
    assert len(gather(index.search_batch(queries)) & exact) >= 0.9 * len(exact) == 450
    q = data[7][1]
    assert rows(index.search(q, probes=10**6)) == rows(vector.search_vector(vectors, q, metric=metric)) and rows(index.search(q))[0][0] in range(1500)
    assert rows(index.search([1.0])) == []


def test_batch_has_no_cartesian_product(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "ord bigint, vector array<double>").repartition(3)
    out = vector.search_vector_batch(v, v.selectExpr("ord as query_id", "vector"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and out.count() == 150


def test_collection_keeps_an_index(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "c"), Options(enable_search=True, analyzer=Analyzer("whitespace"), cache_size=2))
    c.append(spark.createDataFrame([(f"k{i}", "apple pie" if i % 2 else "apple tart", i) for i in range(20)], "key string, text string, seq int"))
    want = rows(c.search_text("pie", 3))
    c.rebuild_index()
    assert isinstance(c._default(), StoredIndex) and rows(c.search_text("tart", 30)) and rows(c.search_text("pie", 3)) == want
    c.remove("k19")
    assert not isinstance(c._default(), StoredIndex) and "k19" not in {r.key for r in c.search_text("pie", 30).collect()}
    c.compact_index(0.01)
    assert isinstance(c._default(), StoredIndex) and {r.key for r in c.search_text("pie", 30).collect()} == {f"k{i}" for i in range(1, 19, 2)}
    assert list(c._results) and rows(c.search_text("pie", 30)) == rows(c.search_text("pie", 30))
    c.put("new", "pie pie")
    assert not c._results and "new" in {r.key for r in c.search_text("pie", 30).collect()}
    with pytest.raises(CollectionError) as e:
        c.append(spark.createDataFrame([("a", 1), ("b", 1)], "key string, seq int"))
    assert e.value.kind is Kind.INVALID_OPTION and c.get("a") is None
    assert c.parallel_scan(lambda it: next(it, None)) == 20


def test_iterators_may_be_a_little_behind(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "c"), Options())
    with pytest.raises(CollectionError):
        c.iterate()
    c.put("a", "1")
    c.put("b", "2")
    c.remove("b")
    c.materialize_view()
    assert {r.key for r in c.iterate(60, 0).collect()} == {"a"} and c.iterate(see_tombstones=True).count() == 2
    c.put("c", "3")
    assert {r.key for r in c.iterate(max_puts=1).collect()} == {"a"}
    for late in ({"max_puts": 0}, {"max_age": -1.0}):
        with pytest.raises(CollectionError) as e:
            c.iterate(**late)
        assert e.value.kind is Kind.OUT_OF_DATE


def test_hybrid_batch_answers_each_query(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "c"), Options(enable_search=True, analyzer=Analyzer("whitespace"), vector_dim=2))
    c.append(spark.createDataFrame([("a", "x y", [1.0, 0.1]), ("b", "x", [0.0, 1.0]), ("c", "z", [1.0, 1.0])], "key string, text string, vector array<float>"))
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "", None), (3, "x", [1.0]), (4, None, [0.0, 1.0]), (5, "z", None)], "query_id bigint, text string, vector array<float>")
    got = {}
    for r in c.search_hybrid_batch(q, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.error))
    assert got[2] == [(None, None, "empty query")] and got[3] == [(None, None, "dimension")] and [k for _, k, _ in sorted(got[5])] == ["c"]
    for i, text, v in ((1, "x", [1.0, 0.0]), (4, "", [0.0, 1.0])):
        assert [k for _, k, _ in sorted(got[i])] == [r.key for r in c.search_hybrid(text, v, 2).orderBy("rank").collect()]


def test_folding_is_full_by_default(spark):
    from pyspark.sql import functions as F

    texts = ["Straße ÄÖ", "ﬁne ＡＢＣ", "ΣΑΣ", "ⅷ ½ ㎏", "plain", None, "İstanbul", "“Quote” – dash", "a­b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for a in (Analyzer("whitespace"), Analyzer("ngram")):
        for r in df.select("t", a.tokens(F.col("t")).alias("k")).collect():
            assert [(x.term, x.pos) for x in r.k] == (a(r.t) if r.t else [])
    from quern.functions.text import fold

    assert all(r.a == r.b for r in df.select(fold(F.col("t")).alias("a"), fold_full("t").alias("b")).collect())


def test_jieba_with_fallback_and_filters(monkeypatch):
    a = Analyzer("jieba", stop_words=("的",), min_token_length=1, stemming=True)
    assert a("running 今日は") == [("run", 0), ("今日", 1), ("日は", 1), ("今日は", 1)]
    fake = types.SimpleNamespace(cut_for_search=lambda s: ["我", "的", s[2:]])
    monkeypatch.setitem(sys.modules, "jieba", fake)
    assert a("我的北京 runs, テスト") == [("我", 0), ("北京", 2), ("run", 3), ("テス", 4), ("スト", 4), ("テスト", 4)]


def test_byte_offsets():
    a, text = Analyzer("ngram"), "Äpfel, äpfel 北京人 x"
    folded = "äpfel, äpfel 北京人 x".encode()
    got = byte_offsets(text, a(text))
    assert all(folded[i:j].decode() == t for t, _, i, j in got) and [i for *_, i, _ in got][:2] == [0, 8] and len(got) == 6


def test_missing_dependencies_are_not_hidden(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(entry)
    assert "pipeline" not in entry.queries() and "search_text" in entry.queries()
    monkeypatch.undo()
    importlib.reload(entry)
