import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions.query import Condition, SynonymMap, meta
from quern.functions.text import Analyzer
from quern.operators import kv, lexical, vector
from quern.operators.lexical import Bm25, FieldIndex, Index
from quern.sources.collection import Collection, CollectionError, Kind, Options

W = Analyzer("whitespace")


def index(spark, *texts, analyzer=W):
    return Index.of(spark.createDataFrame(list(enumerate(texts)), "ord bigint, text string"), analyzer)


def ords(df):
    return [r.ord for r in df.orderBy("rank").collect()]


def test_ties_go_to_the_later_write(spark):
    i = index(spark, "hello world foo bar", "hello world baz qux", "foo bar baz qux")
    assert ords(lexical.search_text(i, "hello")) == [1, 0]
    assert ords(lexical.search_text(i, "")) == [] and ords(lexical.search_text(i, "absent")) == []


def naive(texts, query, params=Bm25()):
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for term in set(query.split()):
        df = sum(term in d for d in docs)
        for i, d in enumerate(docs):
            if tf := d.count(term):
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * (tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * len(d) / avg)) + params.delta)
    return sorted(((round(s, 6), i) for i, s in out.items()), reverse=True)


def test_bm25_is_the_naive_one_and_batches_are_serial(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(60)]
    i, queries = index(spark, *texts), {1: "a b", 2: "c", 3: "h g a"}
    for params in (Bm25(), Bm25(2.0, 0.1, 1.0)):
        batch = lexical.search_text(i, queries, 7, params).collect()
        for q, text in queries.items():
            want = naive(texts, text, params)[:7]
            assert [(x.score, x.ord) for x in sorted((b for b in batch if b.query_id == q), key=lambda x: x.rank)] == want
            assert [(x.score, x.ord) for x in lexical.search_text(i, text, 7, params).orderBy("rank").collect()] == want


def test_phrase_and_near(spark):
    i = index(spark, "quick brown fox", "fox brown quick", "a b a b", "a b")
    assert ords(lexical.search_near(i, "quick fox", 0)) == [] and ords(lexical.search_near(i, "quick fox", 1)) == [0]
    assert ords(lexical.search_near(i, "fox quick", 5)) == [1]
    assert ords(lexical.search_phrase(i, "a b")) == [2, 3] and ords(lexical.search_phrase(i, "b a b")) == [2]
    assert ords(lexical.search_phrase(i, "")) == []


def test_near_is_greedy_like_the_naive_one(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(1, 10))) for _ in range(80)]
    i = index(spark, *texts)

    def hit(words, query, slop):
        for s in [p for p, w in enumerate(words) if w == query[0]]:
            at = s
            for q in query[1:]:
                at = next((p for p in range(at + 1, min(len(words), at + 2 + slop)) if words[p] == q), None)
                if at is None:
                    break
            if at is not None:
                return True
        return False

    for query, slop in (("a b", 0), ("a b c", 1), ("a a", 2), ("c b a", 3)):
        assert set(ords(lexical.search_near(i, query, slop, 100))) == {n for n, t in enumerate(texts) if hit(t.split(), query.split(), slop)}


def test_boolean(spark):
    i = index(spark, "a b", "a c", "b c", "c d")
    assert set(ords(lexical.bool_search(i, "+a b"))) == {0, 1} and ords(lexical.bool_search(i, "+a b"))[0] == 0
    assert set(ords(lexical.bool_search(i, "a c -b"))) == {1, 3}
    assert ords(lexical.bool_search(i, "-a")) == [] and ords(lexical.bool_search(i, "+a +absent")) == [] and ords(lexical.bool_search(i, "+A")) == []


def test_fuzzy_wildcard_synonyms(spark):
    i = index(spark, "apple pie", "apply now", "banana", "ape")
    assert set(ords(lexical.search_fuzzy(i, "apple", 1))) == {0, 1} and set(ords(lexical.search_fuzzy(i, "apple", 2))) == {0, 1, 3}
    assert set(ords(lexical.search_wildcard(i, "ap*"))) == {0, 1, 3} and ords(lexical.search_wildcard(i, "?ie")) == [0] and ords(lexical.search_wildcard(i, "z*")) == []
    s = SynonymMap()
    s.add_group(["fruit", "banana"])
    assert ords(lexical.search_text(i, "fruit", synonyms=s)) == [2]


def test_fields(spark):
    rows = [(0, [("title", "apple fruit"), ("body", "banana split dessert")]), (1, [("title", "banana bread"), ("body", "apple pie recipe")])]
    f = FieldIndex(spark.createDataFrame(rows, "ord bigint, fields array<struct<name:string,value:string>>"), W)
    assert ords(f.search("title:apple")) == [0] and ords(f.search("title:banana")) == [1] and ords(f.search("nofield:apple")) == []
    assert set(ords(f.search("apple"))) == {0, 1}
    assert ords(f.search("title:apple^5 body:apple")) == [0, 1]
    assert ords(lexical.search_phrase(f.catch_all, "fruit banana")) == [0]


def test_explain_adds_up(spark):
    i = index(spark, "x x y", "x z", "q")
    parts = {r.term: r for r in lexical.explain(i, "x y absent", 0).collect()}
    score = lexical.search_text(i, "x y absent").where("ord = 0").first().score
    assert abs(sum(r.contribution for r in parts.values()) - score) < 1e-5 and parts["absent"].df == 0
    assert lexical.explain(i, "x", 99).count() == 0


def test_stemming(spark):
    i = index(spark, "running cats", "run cat", "dogs", analyzer=Analyzer("whitespace", stemming=True))
    assert set(ords(lexical.search_text(i, "runs"))) == {0, 1} and ords(lexical.search_phrase(i, "run cats")) == [1, 0]


def test_highlight():
    text = "aa bb " + "x " * 100 + "aa aa"
    got = lexical.highlight_text(text, ["aa"], W, fragment_size=20, max_fragments=2)
    assert [s for _, s in got] == [2.0, 1.0] and got[0][0] == "<em>aa</em> <em>aa</em>" and got[1][0] == "<em>aa</em>"
    assert lexical.highlight_text(text, ["zz"], W) == []
    assert lexical.highlight_text("ＳＰＡＲＫ plans", ["spark"], W) == [("<em>spark</em>", 1.0)]

@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_vectors(spark, metric):
    r = random.Random(1)
    v = [[r.gauss(0, 1) for _ in range(6)] for _ in range(40)] + [[0.0] * 6]
    df = spark.createDataFrame(list(enumerate(v)), "ord bigint, vector array<float>").unionByName(spark.createDataFrame([(99, [1.0]), (98, None)], "ord bigint, vector array<float>"))
    q = spark.createDataFrame([(0, v[0]), (5, v[5])], "query_id bigint, vector array<float>")
    batch = vector.search_vector_batch(df, q, 5, metric).collect()
    for n in (0, 5):
        one = [(x.ord, x.score) for x in vector.search_vector(df, v[n], 5, metric).orderBy("rank").collect()]
        many = [(x.ord, x.score) for x in sorted((b for b in batch if b.query_id == n), key=lambda b: b.rank)]
        assert [o for o, _ in one] == [o for o, _ in many] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(one, many))
    if metric != "dot":
        assert one[0][0] == 5


def test_int8(spark):
    df = spark.createDataFrame([(0, [1.0, -0.5, 0.25]), (1, [0.0, 0.0, 0.0])], "ord bigint, vector array<float>")
    q = df.select(vector.quantize(F.col("vector")).alias("q")).collect()
    assert q[0].q.codes == [127, -64, 32] and q[1].q.codes == [0, 0, 0]
    assert ords(vector.search_vector_int8(df, [1.0, 0.0, 0.0], 1)) == [0]


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    o = Options(enable_search=True, analyzer=W, vector_dim=4)
    c = Collection.open(spark, path, o)
    docs = [("d1", "x x x", [0.6, 0.8, 0.0, 0.0]), ("d2", "x x y", [0.8, 0.6, 0.0, 0.0]), ("d3", "x y y", [1.0, 0.0, 0.0, 0.0]), ("d4", "z z z", [0.0, 0.0, 0.0, 1.0])]
    c.append(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "seq int, key string, text string, vector array<float>"))
    near = lambda df: {r.key: r.score for r in df.collect()}
    got = near(c.search_hybrid("x", [1.0, 0.0, 0.0, 0.0]))
    assert got == pytest.approx({"d1": 1 / 61 + 1 / 63, "d3": 1 / 61 + 1 / 63, "d2": 2 / 62, "d4": 1 / 64}, abs=1e-8)
    assert [r.key for r in c.search_hybrid("x", [1.0, 0.0, 0.0, 0.0]).orderBy("rank").collect()] == ["d1", "d3", "d2", "d4"]
    assert [r.key for r in c.search_hybrid("", [1.0, 0.0, 0.0, 0.0]).orderBy("rank").collect()] == ["d3", "d2", "d1", "d4"]
    for bad in (lambda: c.search_hybrid(), lambda: c.search_vector([1.0]), lambda: c.put_doc("z", vector=[0.0] * 4), lambda: c.put_doc("z", vector=[1.0])):
        with pytest.raises(CollectionError) as e:
            bad()
        assert e.value.kind is Kind.INVALID_OPTION
    c.put_doc("d1", text="new words", vector=[0.0, 1.0, 0.0, 0.0], meta={"year": 2024})
    c.remove("d4")
    assert c.get("d4") is None and c.get("d1").text == "new words" and c.get("d1").ord > 3
    assert near(c.search_text("new")).keys() == {"d1"} and near(c.search_text("new", where=Condition("year", "eq", 2024))).keys() == {"d1"}
    assert c.search_text("x", where=Condition("year", "exists")).count() == 0
    assert c.search_phrase("new words").count() == 1 and c.search_text_highlight("new").first().highlights[0].text == "<em>new</em>"
    assert c.explain("new", "nobody") is None and c.scan(snapshot=3).count() == 4
    assert c.merge() == {"records_in": 6, "records_out": 3, "dropped": 3} and {r.key for r in c.scan().collect()} == {"d1", "d2", "d3"}
    with pytest.raises(CollectionError):
        Collection.open(spark, path, Options())
    assert Collection.open(spark, path, o).status().first().live_keys == 3
    c.close()
    with pytest.raises(CollectionError):
        c.get("d1")


def test_key_value_mode_and_upgrade(spark, tmp_path):
    path = str(tmp_path / "kv")
    c = Collection.open(spark, path, Options(expiry_secs=10))
    c.put("a", "one fish", 100)
    c.put("b", "two fish", 105)
    assert c.get("a", now=109).text == "one fish" and c.get("a", now=110) is None and c.scan(now=112).count() == 1
    with pytest.raises(CollectionError) as e:
        c.search_text("fish")
    assert e.value.kind is Kind.NO_INDEX
    assert Collection.upgrade(spark, path, Options(enable_search=True, analyzer=W)).search_text("fish").count() == 2


def test_policy(spark):
    stats = spark.createDataFrame([(1, 70, 10, 100, 5, 9), (2, 10, 0, 100 << 20, 5, 99), (3, 45, 0, 100 << 20, 5, 99)], "file_id long, fragmented long, dead_bytes long, total_bytes long, oldest long, newest long")
    pick = lambda **p: {r.file_id: r.reasons for r in kv.merge_candidates(stats, kv.Policy(**p.pop("policy", {})), **p).collect()}
    assert pick() == {1: ["fragmented", "small_file"], 3: ["fragmented"]}
    assert pick(policy={"frag_merge_trigger": 90}) == {}
    assert pick(policy={"frag_merge_trigger": 90, "deletion_rate_trigger": 30}, dead_doc_rate=40) == {1: ["fragmented", "small_file"], 3: ["fragmented"]}
    assert pick(policy={"frag_merge_trigger": 90, "expiry_secs": 10}, now=50)[1] == ["fragmented", "small_file", "expired"]
    assert {r.file_id for r in kv.cap_size(stats, (100 << 20) + 100).collect()} == {1, 2}


def test_metadata_is_needed(spark):
    docs = spark.createDataFrame([(0, "a", "t"), (1, "a", None)], "ord bigint, text string, c string").withColumn("meta", F.when(F.col("c").isNotNull(), meta(c=(F.col("c"), "str"))))
    assert ords(lexical.search_text(Index.of(docs, W), "a", where=Condition("d", "neq", "x"))) == [0]


def test_streaming(spark, tmp_path):
    from quern.streaming import ingest

    schema = "key string, ord bigint, tstamp bigint, is_tombstone boolean, text string"
    rows = [("a", 0, 1, False, "x"), ("b", 2, 1, False, "y"), ("a", 3, 1, False, "z"), ("b", 1, 1, False, "old"), ("c", 4, 1, True, None)]
    for i in (0, 1):
        spark.createDataFrame(rows[i::2], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.stream_log(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {(r.key, r.text) for r in ingest.latest_view(spark, str(tmp_path / "log")).collect()} == {("a", "z"), ("b", "y")}
