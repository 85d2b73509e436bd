"""Lexical search: postings, BM25, phrases, boolean, fuzzy, wildcard, fielded search, explanations, highlights."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.query import SynonymMap, parse_query, passes
from quern.functions.text import Analyzer, edit_distance_within, fold_string, porter_stem, stem, unstemmed, wildcard_match
from quern.operators.top import Top

#: Query terms up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Words up to this many are looked for within the rows of tokens.
INLINE_TERMS = 20_000
#: Tokens of an Arrow batch that are handled at once, and cells of a matrix of scores.
SLICE, CELLS = 500_000, 2_000_000
#: Words whose stems a worker remembers.
STEMS = 200_000
DIGITS = 6


@dataclass(frozen=True)
class Bm25:
    """Parameters of the score; delta above 0 is BM25+."""

    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.0

    def idf(self, n: Column, df: Column) -> Column:
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    def norm(self, tf: Column, dl: Column, avgdl: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))

    def score(self, n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
        return self.idf(n, df) * (self.norm(tf, dl, avgdl) + self.delta)


def ranked(hits: DataFrame, k: int, by: list[str] | None = None, ascending_ord: bool = False) -> DataFrame:
    """The k best of each query, ranked from 1: score descending, then ord descending (or ascending)."""
    order = [F.col("score").desc(), F.col("ord").asc() if ascending_ord else F.col("ord").desc()]
    if by:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    top = hits.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, such as one small file, over all cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Index:
    """An inverted index over documents with the columns ord and text, and optionally meta.

    `tokens` holds a row for each document: ord, terms with positions, and dl, the number of terms.  It is
    derived from the documents as they are; `stored.StoredIndex` keeps it by term.
    """

    def __init__(self, tokens: DataFrame, analyzer: Analyzer, metadata: DataFrame | None = None):
        self.tokens, self.analyzer, self.metadata = tokens, analyzer, metadata

    @classmethod
    def of(cls, docs: DataFrame, analyzer: Analyzer | None = None) -> Index:
        analyzer = analyzer or Analyzer()
        docs = spread(docs)
        tokens = docs.select("ord", analyzer.tokens(F.col("text")).alias("tokens"))
        if analyzer.stemming:
            tokens = _stemmed(tokens)
        return cls(tokens.withColumn("dl", F.size("tokens").cast("bigint")), analyzer, docs.select("ord", "meta") if "meta" in docs.columns else None)

    def field_stats(self) -> DataFrame:
        """One row: documents and total length."""
        return self.tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"))

    #: whether postings are found by their term
    by_term = False

    @cached_property
    def unique(self) -> bool:
        """Whether no two rows have the same ord, so that each document lies within its row."""
        return not self.tokens.groupBy("ord").count().where("count > 1").head(1)

    def exploded(self, words: list[str] | None = None) -> DataFrame:
        """(ord, dl, term, pos) of these words or of all."""
        return self._tokens_of(self.tokens if words is None else self._with(lambda t: t.isin(words)))

    def _with(self, match: Callable[[Column], Column]) -> DataFrame:
        """The rows with those tokens only whose term matches."""
        return self.tokens.select("ord", "dl", F.filter("tokens", lambda t: match(t.term)).alias("tokens"))

    @staticmethod
    def _tokens_of(rows: DataFrame) -> DataFrame:
        # the outer form, since for the inner one the planner tests the tokens' number first, and makes them twice
        return rows.select("ord", "dl", F.explode_outer("tokens").alias("t")).where("t is not null").select("ord", "dl", "t.term", "t.pos")

    def postings(self, terms: Terms | None = None) -> DataFrame:
        """(term, ord, dl, tf), of these terms or of all.

        All of them are counted within rows, without a shuffle, where every document has one row; known words are kept
        within rows before anything is sent; a table of words is joined.
        """
        if terms is None and self.unique:
            return gathered(self.tokens).select("term", "ord", "dl", "tf")
        if terms is not None and terms.names is not None and len(terms.names) <= INLINE_TERMS:
            return self.matching(lambda t: t.isin(terms.names))
        rows = self.exploded()
        if terms is not None:
            rows = rows.join(_small(terms.distinct(), terms.n), "term")
        return rows.groupBy("term", "ord", "dl").agg(F.count("*").alias("tf"))

    def matching(self, match: Callable[[Column], Column]) -> DataFrame:
        """(term, ord, dl, tf) of the terms that match."""
        return self._tokens_of(self._with(match)).groupBy("term", "ord", "dl").agg(F.count("*").alias("tf"))

    def positions(self) -> DataFrame:
        """(term, ord, tf, positions), sorted; within rows where every document has one."""
        if self.unique:
            return gathered(self.tokens).select("term", "ord", "tf", "positions")
        return self.exploded().groupBy("term", "ord").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))

    def term_stats(self) -> DataFrame:
        """(term, df): the vocabulary."""
        return self.tokens.select(F.explode(F.array_distinct(F.transform("tokens", lambda t: t.term))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def with_stats(self, df: DataFrame) -> DataFrame:
        stats = self.field_stats().select(F.col("n_docs").alias("n"), F.when(F.col("n_docs") > 0, F.col("sum_dl") / F.col("n_docs")).otherwise(1.0).alias("avgdl"))
        return df.crossJoin(F.broadcast(stats))  # one row


def _small(df: DataFrame, n: int | None = None) -> DataFrame:
    """Broadcast a table of known size if that is within bounds; of unknown size, the engine decides by what it measures."""
    return F.broadcast(df) if n is not None and n <= BROADCAST_TERMS else df


#: Rows up to this many become literals of the plan; more are sent as a table.  Terms that a pattern expands to, up to so
#: many, are looked up once and held by the driver.
LITERAL_ROWS, EXPANDED = 256, 20_000


def local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, without Python workers on the way."""
    if not rows or len(rows) > LITERAL_ROWS:
        return spark.createDataFrame(rows, schema)
    fields = [f.split() for f in schema.split(", ")]
    one = lambda r: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, fields)])
    return spark.range(1).select(F.explode(F.array(*map(one, rows))).alias("r")).select("r.*")


def _documents() -> Column:
    """Rows of postings, counted by a column, so that both uses of the postings read the same shuffle."""
    return F.sum(F.when(F.col("tf") > 0, F.lit(1).cast("bigint")))


@dataclass(frozen=True)
class Terms:
    """Query terms (query_id, term), and how many there are if that is known."""

    table: DataFrame
    n: int | None = None
    words: DataFrame | None = None
    names: list[str] | None = None

    @classmethod
    def of(cls, spark, rows: list[tuple]) -> Terms:
        names = list(dict.fromkeys(t for _, t in rows))
        return cls(local(spark, rows, "query_id bigint, term string"), len(rows), local(spark, [(t,) for t in names], "term string"), names)

    def distinct(self) -> DataFrame:
        return self.table.select("term").distinct() if self.words is None else self.words


def _slices(batch: pa.RecordBatch, at: int) -> Iterable[pa.RecordBatch]:
    """The rows of a batch, in parts of about SLICE tokens of the list at this place; a longer document is a part."""
    before = np.append(0, np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0), np.int64)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(before, before[start] + SLICE, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _lists(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and how many each row has."""
    return col.flatten(), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0), np.int64)


def gathered(tokens: DataFrame) -> DataFrame:
    """(term, ord, dl, tf, positions) of (ord, tokens, dl), each document within its row, so without a shuffle."""

    def work(it):
        for b in (part for batch in it for part in _slices(batch, 1)):
            flat, size = _lists(b.column(1))
            if not len(flat):
                continue
            word = pa.compute.struct_field(flat, 0).dictionary_encode()
            code, pos, doc = np.asarray(word.indices), np.asarray(pa.compute.struct_field(flat, 1)), np.repeat(np.arange(size.size), size)
            order = np.lexsort((pos, code, doc))
            code, pos, doc = code[order], pos[order], doc[order]
            head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
            ends = np.append(head, code.size).astype(np.int32)
            of = pa.array(doc[head])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([word.dictionary.take(pa.array(code[head])), b.column(0).take(of), b.column(2).take(of), pa.array(np.diff(ends).astype(np.int64)), lists], names=["term", "ord", "dl", "tf", "positions"])

    return tokens.select(F.col("ord").cast("bigint"), "tokens", F.col("dl").cast("bigint")).mapInArrow(work, "term string, ord long, dl long, tf long, positions array<int>")


def _stemmed(tokens: DataFrame) -> DataFrame:
    """Terms replaced by their stems within their rows; a worker stems a word once, as long as it remembers it."""

    def work(it):
        known: dict[str, str] = {}
        for b in (part for batch in it for part in _slices(batch, 1)):
            flat, size = _lists(b.column(1))
            word = pa.compute.struct_field(flat, 0).dictionary_encode()
            if len(known) > STEMS:
                known.clear()
            stems = []
            for w in word.dictionary.to_pylist():
                if (s := known.get(w)) is None:
                    s = known[w] = porter_stem(w)
                stems.append(s)
            own = pa.StructArray.from_arrays([pa.array(stems, pa.string()).take(word.indices), pa.compute.struct_field(flat, 1)], ["term", "pos"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), own)], names=["ord", "tokens"])

    kind = tokens.schema["ord"].dataType.simpleString()
    return tokens.select("ord", "tokens").mapInArrow(work, f"ord {kind}, tokens array<struct<term:string,pos:int>>")


def query_terms(index: Index, queries: dict | str | DataFrame, synonyms: SynonymMap | None = None) -> Terms:
    """(query_id, term), distinct, of one query (id 0), a dict of queries, or a table (query_id, text)."""
    spark = index.tokens.sparkSession
    if isinstance(queries, DataFrame):
        rows = queries.select("query_id", F.explode(unstemmed(index.analyzer).tokens(F.col("text"))).alias("t")).select("query_id", "t.term").distinct()
        return Terms(rows.select("query_id", stem("term").alias("term")).distinct() if index.analyzer.stemming else rows)
    queries = {0: queries} if isinstance(queries, str) else queries
    rows = []
    for q, text in queries.items():
        terms = list(dict.fromkeys(t for t, _ in index.analyzer(text)))
        rows += [(q, t) for t in (synonyms.expand_terms(terms) if synonyms else terms)]
    return Terms.of(spark, rows)


def contributions(index: Index, terms: Terms, params: Bm25) -> DataFrame:
    """(query_id, term, ord, tf, df, n, dl, avgdl, contribution) of every match."""
    postings = index.postings(terms)
    rows = _scored(index, postings, params, terms.n)
    return rows.join(_small(terms.table, terms.n), "term")


def _scored(index: Index, postings: DataFrame, params: Bm25, words: int | None = None) -> DataFrame:
    """Postings with their contributions; words: how many there are at most, if that is known."""
    df = postings.groupBy("term").agg(_documents().alias("df"))
    return index.with_stats(postings.join(_small(df, words), "term")).withColumn("contribution", params.score(*map(F.col, ("n", "df", "tf", "dl", "avgdl"))))


def score_terms(index: Index, terms: Terms, params: Bm25 | None = None) -> DataFrame:
    """(query_id, ord, score): sums of contributions, to six digits."""
    return contributions(index, terms, params or Bm25()).groupBy("query_id", "ord").agg(F.round(F.sum("contribution"), DIGITS).alias("score"))


def search_text(index: Index, queries, k: int = 10, params: Bm25 | None = None, synonyms: SynonymMap | None = None, where=None, filter_mode: str = "pre") -> DataFrame:
    """The k best documents of each query: (query_id, ord, score, rank).

    where: a metadata filter.  'pre' applies it to all matches; 'post' to the best max(4k, 64), which may
    leave fewer than k.  Tables of queries are scored document by document (`_best_of_each`) where that can be.
    """
    terms = query_terms(index, queries, synonyms)
    if isinstance(queries, DataFrame) and where is None and not index.by_term and index.unique:
        asked = terms.table.limit(BROADCAST_TERMS + 1).collect()
        if len(asked) <= BROADCAST_TERMS:
            return _best_of_each(index, [tuple(r) for r in asked], k, params or Bm25())
    hits = score_terms(index, terms, params)
    if where is not None and filter_mode == "pre":
        return ranked(_filtered(index, hits, where), k, ["query_id"])
    if where is not None:
        hits = _filtered(index, ranked(hits, max(4 * k, 64), ["query_id"]).drop("rank"), where)
    return ranked(hits, k, ["query_id"])


def _best_of_each(index: Index, asked: list[tuple], k: int, params: Bm25) -> DataFrame:
    """The k best documents of each of many queries, (query_id, term) in all, over an index of one row a document.

    The tokens are read once for statistics and once for scores.  A task scores its documents against all queries, slice by
    slice, and keeps the k best of each, so that neither matches nor scores are sent, but k rows a query and task.
    """
    spark = index.tokens.sparkSession
    asked = [(q, t) for q, t in asked if q is not None]
    ids, words = sorted({q for q, _ in asked}), sorted({t for _, t in asked})
    place, code = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(words)}
    pairs = np.array(sorted((code[t], place[q]) for q, t in asked), np.int64).reshape(-1, 2)
    of, first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    ids = np.array(ids, np.int64)
    known = F.filter("tokens", lambda t: t.term.isin(words)) if len(words) <= INLINE_TERMS else F.col("tokens")
    rows = index.tokens.select(F.col("ord").cast("bigint"), F.col("dl").cast("bigint"), F.transform(known, lambda t: t.term).alias("words"))

    def counted(batch, known):
        """(document, word, tf) of what is asked for, and the slice that they are of."""
        for b in _slices(batch, 2):
            flat, size = _lists(b.column(2))
            own = np.asarray(pa.compute.fill_null(pa.compute.index_in(flat, value_set=known), -1), np.int64)
            key, tf = np.unique((np.repeat(np.arange(size.size), size) * len(words) + own)[own >= 0], return_counts=True)
            yield b, *np.divmod(key, max(1, len(words))), tf

    def count(it):
        known = pa.array(words, pa.string())
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for batch in it:
            n, total = n + batch.num_rows, total + (pa.compute.sum(batch.column(1)).as_py() or 0)
            for _, _, word, _ in counted(batch, known):
                df += np.bincount(word, minlength=len(words))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], there)), pa.array(np.append([n, total], df[there]))], names=["word", "n"])

    found = dict(rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.array([found.get(i, 0) for i in range(len(words))], np.float64)
    idf, avgdl = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / n if n else 1.0

    def score(it):
        known, top = pa.array(words, pa.string()), Top(len(ids), k, descending=True)
        every = np.arange(len(ids))
        for batch in it:
            for b, doc, word, tf in counted(batch, known):
                order, dl = np.asarray(b.column(0)), np.asarray(b.column(1))
                part = idf[word] * (tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl[doc] / avgdl)) + params.delta)
                fan = first[word + 1] - first[word]
                step = max(1, CELLS // max(1, len(ids)))
                for at in range(0, b.num_rows, step):
                    here = slice(*np.searchsorted(doc, (at, at + step)))
                    docs, cut = min(step, b.num_rows - at), fan[here]
                    s, hit = np.zeros(docs * len(ids)), np.zeros(docs * len(ids), bool)
                    # of the matches so many at once
                    ends = np.cumsum(cut)
                    lo = 0
                    while lo < cut.size:
                        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
                        own = cut[lo:hi]
                        turn = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                        to = np.repeat((doc[here][lo:hi] - at) * len(ids), own) + of[np.repeat(first[word[here][lo:hi]], own) + turn]
                        s += np.bincount(to, np.repeat(part[here][lo:hi], own), minlength=s.size)
                        hit[to] = True
                        lo = hi
                    s = np.where(hit, np.round(s, DIGITS), -np.inf).reshape(docs, -1).T
                    top.offer(every, np.ascontiguousarray(s), order[at : at + docs])
        at, doc, best = top.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(doc), pa.array(best)], names=["query_id", "ord", "score"])

    if not asked:
        return ranked(spark.createDataFrame([], "query_id bigint, ord bigint, score double"), k, ["query_id"])
    return ranked(rows.mapInArrow(score, "query_id long, ord long, score double"), k, ["query_id"])


def _filtered(index: Index, hits: DataFrame, where) -> DataFrame:
    return hits.join(index.metadata.where(passes(where, F.col("meta"))).select("ord"), "ord", "left_semi")


def search_near(index: Index, query: str, slop: int = 0, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """Documents that hold the query's terms in order, each within slop + 1 positions of the one before.

    The score takes the number of starts that match for its term frequency and the first term's document
    frequency.  Only the query's terms are gathered by document; matching happens inside its row.
    """
    params = params or Bm25()
    terms = [t for t, _ in index.analyzer(query)]
    if not terms:
        return index.tokens.limit(0).select("ord", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    own = list(dict.fromkeys(terms))
    rows = index.exploded(own).groupBy("ord", "dl").agg(*[F.sort_array(F.collect_list(F.when(F.col("term") == t, F.col("pos")))).alias(f"p{i}") for i, t in enumerate(own)])
    lists = [F.col(f"p{own.index(t)}") for t in terms]

    def follows(start: Column) -> Column:
        at = start
        for later in lists[1:]:
            at = F.array_min(F.filter(later, after(at)))
        return at.isNotNull()

    def after(at: Column):
        return lambda x: (x > at) & (x <= at + 1 + slop)

    counted = rows.withColumn("first", F.size(lists[0]) > 0).withColumn("tf", F.size(F.filter(lists[0], follows)).cast("bigint"))
    df = counted.agg(F.sum(F.col("first").cast("bigint")).alias("df"))
    hits = index.with_stats(counted.where("tf > 0").crossJoin(F.broadcast(df)))
    scored = hits.select("ord", F.round(params.score(*map(F.col, ("n", "df", "tf", "dl", "avgdl"))), DIGITS).alias("score"))
    return ranked(scored, k)


def search_phrase(index: Index, query: str, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """Documents that hold the terms side by side."""
    return search_near(index, query, 0, k, params)


def bool_search(index: Index, query: str, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """+must, -must_not and should words, taken as they are.  With must words all of them are needed and should words
    only add to the score; without, one should word is; must_not alone finds nothing."""
    words = parse_query(query)
    by = {occur: sorted({w.text for w in words if w.occur == occur}) for occur in ("must", "should", "must_not")}
    spark = index.tokens.sparkSession
    words = [(0, t) for t in sorted({*by["must"], *by["should"], *by["must_not"]})]
    terms = Terms.of(spark, words)
    rows = contributions(index, terms, params or Bm25())
    one_of = lambda names: F.col("term").isin(names) if names else F.lit(False)
    scored = rows.groupBy("ord").agg(
        F.sum(one_of(by["must"]).cast("int")).alias("n_must"), F.sum(one_of(by["must_not"]).cast("int")).alias("n_not"), F.sum(one_of(by["should"]).cast("int")).alias("n_should"),
        F.round(F.sum(F.when(one_of(by["must"] + by["should"]), F.col("contribution")).otherwise(0.0)), DIGITS).alias("score"),
    )
    wanted = F.col("n_must") == len(by["must"]) if by["must"] else F.col("n_should") > 0
    return ranked(scored.where(wanted & (F.col("n_not") == 0)).select("ord", "score"), k)


def _expanded(index: Index, match: Callable[[Column], Column], k: int, params: Bm25 | None) -> DataFrame:
    """Every term that matches counts once.  Of an index by term the vocabulary is looked through once: up to EXPANDED matches
    are held by the driver, more are joined as a table.  Otherwise they are found within the rows of tokens."""
    if not index.by_term:
        rows = _scored(index, index.matching(match), params or Bm25())
        return ranked(rows.groupBy("ord").agg(F.round(F.sum("contribution"), DIGITS).alias("score")), k)
    matching = index.term_stats().where(match(F.col("term")))
    some = [r.term for r in matching.select("term").distinct().limit(EXPANDED + 1).collect()]
    if len(some) <= EXPANDED:
        terms = Terms.of(index.tokens.sparkSession, [(0, t) for t in some])
    else:
        terms = Terms(matching.select(F.lit(0).cast("bigint").alias("query_id"), "term").distinct(), BROADCAST_TERMS + 1)
    return ranked(score_terms(index, terms, params).drop("query_id"), k)


def search_fuzzy(index: Index, query: str, max_edit: int = 1, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """Every term of the vocabulary within so many byte edits of a query term counts once."""
    terms = sorted({t for t, _ in index.analyzer(query)})

    def near(term: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | edit_distance_within(term, F.lit(t), max_edit)
        return out

    return _expanded(index, near, k, params)


def search_wildcard(index: Index, pattern: str, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """Every term of the vocabulary that matches the pattern as it stands counts once."""
    return _expanded(index, lambda term: wildcard_match(term, pattern), k, params)


def explain(index: Index, query: str, ord_: int, params: Bm25 | None = None) -> DataFrame:
    """(term, df, idf, tf, tf_norm, contribution) of each query term for one document; zeros for absent terms, no row if there is no such document."""
    params = params or Bm25()
    terms = query_terms(index, query)
    rows = index.postings(terms)
    df = rows.groupBy("term").agg(_documents().alias("df"))
    doc = index.tokens.where(F.col("ord") == ord_).select("dl")
    own = rows.where(F.col("ord") == ord_).select("term", "tf")
    out = index.with_stats(terms.table.select("term").join(df, "term", "left").join(own, "term", "left").crossJoin(doc)).fillna({"df": 0, "tf": 0})
    there = F.col("df") > 0
    idf, norm = F.when(there, params.idf(F.col("n"), F.col("df"))).otherwise(0.0), F.when(F.col("tf") > 0, params.norm(F.col("tf"), F.col("dl"), F.col("avgdl"))).otherwise(0.0)
    part = F.when(F.col("tf") > 0, idf * (norm + params.delta)).otherwise(0.0)
    return out.select("term", "df", F.round(idf, DIGITS).alias("idf"), "tf", F.round(norm, DIGITS).alias("tf_norm"), F.round(part, DIGITS).alias("contribution"))


# -- fields -----------------------------------------------------------------------------------------------


class FieldIndex:
    """An index of documents with fields: array<struct<name, value>>; lengths are of whole documents, averages of fields.

    `catch_all` is the index over the fields in order, as one text: positions of each field follow those of
    the one before, and the default field itself is not gathered if it is written.
    """

    def __init__(self, docs: DataFrame, analyzer: Analyzer | None = None, default: str = "default"):
        self.analyzer, self.default = analyzer or Analyzer(), default
        each = docs.select("ord", F.posexplode("fields").alias("i", "f")).select("ord", "i", F.col("f.name").alias("field"), self.analyzer.tokens(F.col("f.value")).alias("tokens"))
        if self.analyzer.stemming:
            raise ValueError("stemming is for single-field indexes")
        total = Window.partitionBy("ord")
        own = each.withColumn("dl", F.sum(F.size("tokens").cast("bigint")).over(total))
        self.fields = own.withColumn("written", F.max((F.col("field") == default).cast("int")).over(total))
        width = F.coalesce(F.array_max(F.transform("tokens", lambda t: t.pos)) + 1, F.lit(0))
        before = F.coalesce(F.sum(width).over(Window.partitionBy("ord").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
        shifted = F.transform("tokens", lambda t: F.struct(t.term.alias("term"), (t.pos + F.col("base")).alias("pos")))
        part = self.fields.where((F.col("written") == 0) | (F.col("field") == default)).withColumn("base", before).select("ord", "i", "dl", shifted.alias("tokens"))
        merged = part.groupBy("ord", "dl").agg(F.array_sort(F.collect_list(F.struct("i", "tokens"))).alias("s"))
        self.catch_all = Index(merged.select("ord", F.flatten(F.transform("s", lambda x: x.tokens)).alias("tokens"), "dl"), self.analyzer)

    def search(self, query: str, k: int = 10, params: Bm25 | None = None, synonyms: SynonymMap | None = None) -> DataFrame:
        """field:term^boost words; a word without a field looks in all.  Each term's k best count, times the boost; +
        and - are passed over, and unknown fields find nothing."""
        params = params or Bm25()
        rows = []
        for i, w in enumerate(parse_query(query)):
            terms = list(dict.fromkeys(t for t, _ in self.analyzer(w.text)))
            rows += [(i, w.field or self.default, t, w.boost) for t in (synonyms.expand_terms(terms) if synonyms else terms)]
        wanted = local(self.fields.sparkSession, rows, "word int, field string, term string, boost double")
        every = self.fields.where(F.col("field") != self.default).select("ord", "field", "dl", "tokens")
        every = every.unionByName(self.catch_all.tokens.select("ord", F.lit(self.default).alias("field"), "dl", "tokens"))
        sums = every.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
        postings = every.select("ord", "field", "dl", F.explode("tokens").alias("t")).select("ord", "field", "dl", "t.term").join(_small(wanted.select("field", "term").distinct(), len(rows)), ["field", "term"]).groupBy("field", "term", "ord", "dl").agg(F.count("*").alias("tf"))
        df = postings.groupBy("field", "term").agg(_documents().alias("df"))
        scored = postings.join(df, ["field", "term"]).join(sums, "field").join(_small(wanted, len(rows)), ["field", "term"])
        scored = scored.select("word", "field", "term", "boost", "ord", params.score(*map(F.col, ("n", "df", "tf", "dl", "avgdl"))).alias("score"))
        top = ranked(scored, k, ["word", "field", "term"])
        return ranked(top.groupBy("ord").agg(F.round(F.sum(F.col("score") * F.col("boost")), DIGITS).alias("score")), k)


# -- highlights -------------------------------------------------------------------------------------------


def highlight_text(text: str, terms: Iterable[str], analyzer: Analyzer, pre: str = "<em>", post: str = "</em>", fragment_size: int = 120, max_fragments: int = 3) -> list[tuple[str, float]]:
    """Fragments of a folded text around its matches, marked, with the number of matches in each.

    The window of `fragment_size` bytes that begins at a match and holds the most is taken first; matches
    in it are used up, and so on.
    """
    import re

    terms, folded = set(terms), (fold_string(text) if analyzer.full_fold else text.lower().replace("ß", "ss")).encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\s]+", folded) if m[0].decode("utf-8", "replace") in terms]
    out: list[tuple[str, float]] = []
    left = found
    while left and len(out) < max_fragments:
        count = lambda s, left=left: sum(s <= a < s + fragment_size for a, _ in left)
        start = max((a for a, _ in left), key=lambda s: (count(s), -s))
        end = min(start + fragment_size, left[-1][1], len(folded))
        inside = [(a, b) for a, b in found if a >= start and b <= end]
        parts, at = [], start
        for a, b in inside:
            parts += [folded[at:a].decode("utf-8", "replace"), pre, folded[a:b].decode("utf-8", "replace"), post]
            at = b
        out.append(("".join([*parts, folded[at:end].decode("utf-8", "replace")]), float(len(inside))))
        left = [(a, b) for a, b in left if not start <= a < end]
    return out


def search_text_highlight(index: Index, docs: DataFrame, query: str, k: int = 10, params: Bm25 | None = None, **options) -> DataFrame:
    """`search_text` with snippets: (ord, score, rank, highlights array<struct<text, score>>).  Only the k hits' texts are read in Python."""
    terms, analyzer = [t for t, _ in index.analyzer(query)], index.analyzer
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(kind)
    def snippets(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"text": t, "score": s} for t, s in highlight_text(x or "", terms, analyzer, **options)])

    hits = search_text(index, query, k, params).drop("query_id")
    return docs.select("ord", "text").join(_small(hits, k), "ord").select("ord", "score", "rank", snippets("text").alias("highlights"))
