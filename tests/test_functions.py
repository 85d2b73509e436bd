import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.query import Condition, Filter, SynonymMap, Term, meta, parse_query, passes
from quern.functions.text import Analyzer, edit_distance_within, fold_full, fold_string, porter_stem, wildcard_match


@pytest.mark.parametrize("word, stem", [("running", "run"), ("cats", "cat"), ("ponies", "poni"), ("happy", "happi"), ("of", "of"), ("eding", "ed"), ("date", "date"), ("beautiful", "beauti"), ("bottles", "bottl"), ("Über", "Über")])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def terms(spark, analyzer, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(t.term, t.pos) for t in df.select(analyzer.tokens(F.col("text"))).first()[0]]


@pytest.mark.parametrize("text", ["你好，世界", "北京hello上海", "Hello, World! foo-bar", "中", "", "a b  c", "Straße Ärger", "x你y"])
@pytest.mark.parametrize("analyzer", [Analyzer("ngram"), Analyzer("ngram", 2, 2), Analyzer("whitespace"), Analyzer("whitespace", min_token_length=2), Analyzer("ngram", stop_words=("hello", "a"))])
def test_analyzer_on_columns_is_the_one_on_strings(spark, analyzer, text):
    assert terms(spark, analyzer, text) == analyzer(text)


def test_analyzers(spark):
    assert {t for t, _ in terms(spark, Analyzer("ngram", 2, 2), "你好，世界")} == {"你好", "世界"}
    assert {t for t, _ in terms(spark, Analyzer("ngram", 2, 2), "北京hello上海")} == {"北京", "hello", "上海"}
    assert terms(spark, Analyzer("ngram"), "中") == []
    assert terms(spark, Analyzer("ngram", 2, 3), "你好吗")[0][1] == terms(spark, Analyzer("ngram", 2, 3), "你好吗")[-1][1] == 0
    assert terms(spark, Analyzer("whitespace", min_token_length=3), "ab cde f ghi") == [("cde", 1), ("ghi", 3)]
    assert terms(spark, Analyzer("whitespace"), None) == []
    with pytest.raises(ValueError):
        Analyzer("ngram", 3, 2)
    with pytest.raises(ValueError):
        Analyzer("nothing")


def test_fold(spark):
    assert fold_string("ＡＢＣ ﬁ Straße") == "abc fi strasse"
    assert spark.createDataFrame([("ＡＢＣ",), (None,)], "t string").select(fold_full("t")).collect()[1][0] is None


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abé中", max_size=6), st.text("abé中", max_size=6)), min_size=1, max_size=20))
def test_edit_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[edit_distance_within(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (0, 1, 2)])
    for r in df.collect():
        d = distance(r.a.encode(), r.b.encode())
        assert [r.k0, r.k1, r.k2] == [d <= k for k in (0, 1, 2)]


def test_wildcards(spark):
    cases = [("ab*", "abc", True), ("ab*", "ab", True), ("a?c", "abc", True), ("a?c", "ac", False), ("*", "", True), ("?", "中", False), ("???", "中", True), ("a.c", "abc", False), ("*b*d", "abcd", True), ("a[b", "a[b", True)]
    for pattern, term, want in cases:
        assert spark.createDataFrame([(term,)], "t string").select(wildcard_match(F.col("t"), pattern)).first()[0] is want, (pattern, term)


def test_parser():
    assert parse_query("+a -b c") == [Term("a", "must"), Term("b", "must_not"), Term("c")]
    assert parse_query("title:foo^2.5 x^0 http://a + ti-tle:x") == [Term("foo", field="title", boost=2.5), Term("x"), Term("http://a"), Term("+"), Term("ti-tle:x")]


def test_synonyms(tmp_path):
    s = SynonymMap()
    s.add_group(["a", "b"])
    s.add_group(["b", "c"])
    s.add_group(["z"])
    assert s.expand("c") == ["c", "a", "b"] and s.expand("z") == ["z"] and s.expand_terms(["a", "x"]) == ["a", "b", "c", "x"]
    (tmp_path / "s.csv").write_text("# no\nu, v\n")
    assert SynonymMap.load(str(tmp_path / "s.csv")).expand("u") == ["u", "v"]


def test_metadata_filters(spark):
    df = spark.createDataFrame([(1, "tech", 2024, 1.5), (2, "sport", 2023, 2.0), (3, None, 2023, None)], "id int, c string, y bigint, f double")
    rows = df.withColumn("m", meta(c=(F.col("c"), "str"), y=(F.col("y"), "int"), f=(F.col("f"), "float")))
    none = spark.createDataFrame([(4,)], "id int").withColumn("m", F.lit(None).cast(rows.schema["m"].dataType))
    rows = rows.select("id", "m").unionByName(none)
    find = lambda f: [r.id for r in rows.where(passes(f, F.col("m"))).orderBy("id").collect()]
    assert find(Condition("c", "eq", "tech")) == [1]
    assert find(Condition("c", "neq", "tech")) == [2, 3]
    assert find(Condition("missing", "neq", 1)) == [1, 2, 3]
    assert find(Condition("missing", "eq", None)) == [1, 2, 3]
    assert find(Condition("c", "exists")) == [1, 2]
    assert find(Condition("y", "gte", 2024)) == [1]
    assert find(Condition("y", "gte", 2024.0)) == []
    assert find(Condition("f", "lt", 2.0)) == [1]
    assert find(Condition("y", "in", (2023, "2024"))) == [2, 3]
    assert find(Condition("missing", "in", (None,))) == []
    assert find(Filter((Condition("c", "eq", "tech"), Condition("y", "eq", 2023)), "or")) == [1, 2, 3]
    assert find(Filter(())) == [1, 2, 3]
