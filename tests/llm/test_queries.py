"""Registered queries and the pipeline over whole tables."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from quern.llm import ngram_join, registry
from quern.llm.shared import table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    assert got.columns and "localCheckpoint" not in str(got)
    rows = got.collect()
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
        want = c.sql(registry.ORACLE_SQL[name])
        names = sorted(got.columns)
        at = [want.columns.index(x) for x in names]
        assert sorted(tuple(r[x] for x in names) for r in rows) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    else:
        assert rows


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = table(spark, DIR, "documents")
    first = corpus_pipeline.quality(spark, docs, DIR)
    second = corpus_pipeline.near_duplicates(spark, first, DIR)
    third = corpus_pipeline.decontamination(spark, second, DIR)
    fourth = corpus_pipeline.private_data(spark, third, DIR)
    a, b, c, d = ({r.doc_id: r.text for r in x.collect()} for x in (first, second, third, fourth))
    assert fourth.columns == docs.columns and set(d) == set(c) < set(b) < set(a)
    # one of each group stays: brute force over the first stage's rows
    w = {i: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for i, t in a.items()}
    s = {i: frozenset(zip(*[x[k:] for k in range(3)])) if len(x) > 2 else frozenset([tuple(x)]) for i, x in w.items()}
    gone = set()
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and len(s[i] & s[j]) >= ngram_join.THRESHOLD * len(s[i] | s[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    gone = {i for i in ids if find(i) != i}
    assert set(b) == set(a) - gone
    assert not any(re.search(r"\w@mail\d|\+1 \(\d{3}\)", t) for t in d.values()) and any("<EMAIL>" in t for t in d.values())
    packed = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in packed} == set(d)


def fixture(spark, rows):
    """Rows with the columns of documents and others whose names the operators use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, bin long, node long, hash string, rank int, spans string, class_id long, key string"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "h", 3, "x", 4, "k") for i, t in rows], kinds)


PROSE = "the quick river ran past an old stone mill while seven tall herons watched from reeds near its far bank and nobody else came by until dusk when lamps were lit"
OTHER = "every autumn our village bakes long loaves of dark bread which travellers carry over high passes toward towns whose markets open before any sun has risen at all"
ROWS = [(1, PROSE), (1, PROSE), (2, PROSE + " again"), (3, OTHER), (None, OTHER), (4, None), (5, ""), (6, "  \n "), (7, "mail me at jo.do1@mail.example.com please"), (8, "word " * 20_000), (None, None), (9, OTHER.replace("bread", "rye"))]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    empty = fixture(spark, [])
    assert stage(spark, empty, DIR).collect() == []
    nulls = stage(spark, fixture(spark, [(None, None), (4, None)]), DIR).collect()
    assert len(nulls) == (0 if name == "quality" else 2)
    docs = fixture(spark, ROWS)
    out = stage(spark, docs, DIR)
    if name != "packing":
        assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text) if name != "packing" else (r.doc_id, r.piece) for r in out.collect()), key=repr)
    want = {
        "quality": lambda i, t: bool(t) and i != 8, "near_duplicates": lambda i, t: i not in (2, 9), "decontamination": lambda i, t: True, "private_data": lambda i, t: True, "packing": lambda i, t: True,
    }[name]
    if name == "packing":
        assert {i for i, _ in got} == {i for i, _ in ROWS} and sum(p == 0 for _, p in got) == len(ROWS)
    else:
        clean = [(i, t if i != 7 or name != "private_data" else "mail me at <EMAIL> please") for i, t in ROWS if want(i, t)]
        assert got == sorted(clean, key=repr)


def test_stages_do_their_work(spark):
    item = table(spark, DIR, "benchmark").orderBy("item_id").first().text
    docs = fixture(spark, [(1, f"{OTHER} {item} {PROSE}"), (2, PROSE)])
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, DIR).collect()] == [2]
    assert [r.doc_id for r in corpus_pipeline.quality(spark, fixture(spark, [(1, "spam ham " * 400), (2, PROSE)]), DIR).collect()] == [2]
