"""Substring dedup: hashing of lines and of passages inside them, earliest occurrence kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import ragged
from quern.llm.shared import map_arrow, materialize, need, table

#: A run of repeated units goes if it has this many words; shorter lines repeat in most corpora without being copied.
MIN_WORDS = 20
#: Besides lines, so many words from each anchor on are a unit: passages that begin and end in mid-line have no whole
#: lines of their own.  Anchors are the first words of lines and one in EVERY words, by the lengths of the next four.
WINDOW, EVERY, WEIGHTS = 16, 6, (1, 3, 5, 11)
UNITS = "h long, rank long, at long, again boolean"

_LAST = (1 << 63) - 1


def _sums(w: ragged.Words) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any sequence of words follows, and the powers that bring it to its place."""
    pw, inv = ragged.powers(w.hash.size + 1)
    acc = np.zeros(w.hash.size + 1, np.uint64)
    np.cumsum(ragged.mix(w.hash ^ np.uint64(0x1D8E4E27C47D124F)) * pw[: w.hash.size], out=acc[1:])
    return acc, inv


def unit_ranges(w: ragged.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and kind (0 line, 1 window) of the units of a slice."""
    n = w.hash.size
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    feeds = np.zeros(w.raw.size + 1, np.int64)
    np.cumsum(w.raw == 10, out=feeds[1:])
    begins = np.ones(n, bool)
    begins[1:] = (w.doc[1:] != w.doc[:-1]) | (feeds[w.start[1:]] > feeds[w.end[:-1]])
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], n)
    size, m = w.end - w.start, n - len(WEIGHTS) + 1
    anchor = begins.copy()
    if m > 0:
        anchor[:m] |= sum(k * size[j : m + j] for j, k in enumerate(WEIGHTS)) % EVERY == 0
    at = np.flatnonzero(anchor[: max(0, n - WINDOW + 1)])
    at = at[w.doc[at] == w.doc[at + WINDOW - 1]]
    return np.concatenate([head, at]), np.concatenate([tail, at + WINDOW]), np.repeat([0, 1], [head.size, at.size])


def units(docs: DataFrame) -> DataFrame:
    """Units of (rank, print, text): (h, rank, at, again).

    A unit is a line or WINDOW words from an anchor on, normalised to its words (runs of letters, digits
    and non-ASCII characters, in lower case); h is its digest, and `at` holds the text's print (32 bits), the
    unit's first word (31) and its kind.  `again` marks what stands earlier in the same text.
    """

    def work(it):
        for batch, col in ragged.batches(it, "text"):
            rank, prints = (np.asarray(batch.column(i)) for i in (0, 1))
            for lo, hi in ragged.slices(col):
                w = ragged.words(col, lo, hi)
                a, b, kind = unit_ranges(w)
                acc, inv = _sums(w)
                h = ragged.mix((acc[b] - acc[a]) * inv[a] + ((b - a) * 2 + kind).astype(np.uint64))
                doc = w.doc[a]
                order = np.lexsort((a, h, doc))
                again = np.zeros(h.size, bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                at = prints[lo + doc].astype(np.int64) << 32 | (a - w.first[doc]) << 1 | kind
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rank[lo + doc]), pa.array(at), pa.array(again)], names=["h", "rank", "at", "again"])

    return map_arrow(docs, work, UNITS)


def _keyed(key: Column, text: Column) -> list[Column]:
    """What tells texts apart and orders them: a null key is last; rows of one key and text are one."""
    return [F.coalesce(key.cast("long"), F.lit(_LAST)).alias("rank"), F.hash(text).alias("print")]


def repeated(docs: DataFrame) -> DataFrame:
    """(rank, print, spans) of the texts with units that stand earlier; a span is the unit's first word and kind.

    Digests are grouped over the whole table: units are written once to the shared folder, counted per
    digest with map-side aggregation, and only digests of two texts or more are joined back.
    """
    every = materialize(units(docs), "line-units")
    own = every.where("not again").drop("again")
    twice = own.groupBy("h").agg(F.count("*").alias("n"), F.min("rank").alias("keep")).where("n > 1").drop("n")
    later = own.join(twice, "h").where("rank > keep").select("rank", "at").unionByName(every.where("again").select("rank", "at"))
    # as many spans as a text has units, at most
    return later.groupBy("rank", F.shiftright("at", 32).cast("int").alias("print")).agg(F.collect_set(F.expr("cast(at & 4294967295 as int)")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document without what an earlier one holds: (doc_id, text, n_removed, removed, pieces).

    Lines and passages that repeat are found by the digests of `units`; of each the occurrence of the least
    doc_id, and the first in it, stays.  Units that overlap or stand side by side make a run, and a run goes
    if it has `min_words` words, from its first word up to the next word that stays.  Text that is wrapped
    otherwise repeats all the same.  `n_removed` counts words, `removed` has the runs as (start, stop) in
    code points of the original text, and `pieces` those of what stays, in the order of the new text.

    At each end of a passage that begins and ends in mid-line about EVERY words stay, since units begin
    at anchors; passages of under WINDOW + EVERY words or so may stay as a whole, and so do shorter lines that
    stand alone.  A null text stays null and an empty one empty; a null doc_id ranks last; rows that repeat a
    doc_id have equal rank, so that what they share stays in all of them; equal rows are treated alike; an empty
    table gives an empty result; other columns are ignored.
    """
    own = need(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.select("doc_id", "text", *_keyed(F.col("doc_id"), F.col("text")))
    found = repeated(own.select("rank", "print", "text").where("text is not null"))
    joined = own.join(found, ["rank", "print"], "left").select("doc_id", "text", "spans")
    span = "array<struct<start:int,stop:int>>"

    def work(it):
        for batch, col in ragged.batches(it, "text"):
            spans = batch.column(2)
            count = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0)).astype(np.int64)
            at = np.asarray(spans.flatten()).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(count)])
            for lo, hi in ragged.slices(col):
                w = ragged.words(col, lo, hi)
                doc = np.repeat(np.arange(hi - lo), count[lo:hi])
                own = at[before[lo] : before[hi]]
                new, gone, runs, pieces = _without(w, doc, own >> 1, own & 1, min_words)
                new = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, *map(pa.py_buffer, new)])
                new = pa.compute.if_else(pa.compute.is_valid(col.slice(lo, hi - lo)), new, None).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), new, pa.array(gone), runs, pieces], names=["doc_id", "text", "n_removed", "removed", "pieces"])

    return map_arrow(joined, work, f"doc_id long, text string, n_removed long, removed {span}, pieces {span}")


def _without(w: ragged.Words, doc: np.ndarray, at: np.ndarray, kind: np.ndarray, min_words: int):
    """The texts of a slice without runs of the units that begin at these words of text `doc`: (offsets, bytes), words gone, runs, pieces."""
    n, texts = w.hash.size, w.text_at.size - 1
    a, b, of = unit_ranges(w)
    lines = of == 0
    begin = w.first[doc] + at
    end = np.where(kind == 1, begin + WINDOW, np.append(b[lines], n)[np.searchsorted(a[lines], begin)])
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end, -1)
    hit = np.cumsum(mark)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = (hit[1:] != hit[:-1]) | (w.doc[1:] != w.doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], n)
    gone = hit[head] & (tail - head >= min_words) if n else np.zeros(0, bool)
    head, tail = head[gone], tail[gone]
    of = w.doc[head]
    # up to the next word of the text, or its end; from its beginning if no word stands before
    a = np.where(head == w.first[of], w.text_at[of], w.start[head])
    b = np.where(tail == w.first[of + 1], w.text_at[of + 1], w.start[np.minimum(tail, max(n - 1, 0))] if n else tail)
    edge = np.zeros(w.raw.size + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    keep = np.cumsum(edge)[: w.raw.size] == 0
    size = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    chars = w.chars()
    place = lambda x, d: (chars[x] - chars[w.text_at[d]]).astype(np.int32)
    # pieces lie between the runs
    left = np.concatenate([w.text_at[:-1], b])
    right = np.concatenate([w.text_at[1:], a])
    d = np.concatenate([np.arange(texts), of])
    first = np.argsort(d, kind="stable")
    left, d = left[first], d[first]
    right = right[np.lexsort((right, np.concatenate([np.arange(texts), of])))]
    some = right > left
    return (size[w.text_at], w.raw[keep]), np.bincount(of, tail - head, minlength=texts).astype(np.int64), _lists(of, place(a, of), place(b, of), texts), _lists(d[some], place(left, d)[some], place(right, d)[some], texts)


def _lists(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, texts: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "stop"]))


def spelled(spans: Column) -> Column:
    """Spans as text, such as 0-12,40-77."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s.start.cast("string"), s.stop.cast("string"))), ",")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_removed", spelled(F.col("removed")).alias("removed"), spelled(F.col("pieces")).alias("pieces"))


QUERIES = {"op2_line_dedup": op2_line_dedup}

_NOT_WORD = "[\\x00-/:-@\\[-`{-\\x7f]"
_WORDS = f"[^{_NOT_WORD[1:]}"
_ANCHOR = " + ".join(f"{k} * l[i + {j}]" for j, k in enumerate(WEIGHTS))
ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}+') AS w, string_split_regex(text, '{_WORDS}+') AS gaps FROM documents
), cut AS (
  SELECT doc_id, text, w, gaps, len(w) AS n, list_transform(w, lambda x: strlen(x)) AS l, list_transform(w, lambda x: lower(x)) AS low FROM split
), word AS (
  SELECT *, i = 1 OR contains(gaps[i], chr(10)) AS begins FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM cut)
), placed AS (
  SELECT doc_id, i, begins, sum(length(gaps[i])) OVER o + coalesce(sum(length(w[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), lines AS (
  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n + 1) AS j, low FROM word WHERE begins
), unit AS (
  SELECT doc_id, i, j, 'line ' || array_to_string(low[i : j - 1], ' ') AS h FROM lines
  UNION ALL
  SELECT doc_id, i, i + {WINDOW}, 'window ' || array_to_string(low[i : i + {WINDOW - 1}], ' ') FROM word
  WHERE i + {WINDOW - 1} <= n AND (begins OR (i + {len(WEIGHTS) - 1} <= n AND ({_ANCHOR}) % {EVERY} = 0))
), later AS (
  SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, unnest(range(i, j)) AS i FROM later) GROUP BY ALL
), run AS (
  SELECT doc_id, min(i) AS i, max(i) + 1 AS j FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM hit) GROUP BY doc_id, island HAVING count(*) >= {MIN_WORDS}
), gone AS (
  SELECT run.doc_id, run.j - run.i AS words, CASE WHEN run.i = 1 THEN 0 ELSE a.start END AS lo, coalesce(b.start, length(c.text)) AS hi
  FROM run JOIN placed a ON a.doc_id = run.doc_id AND a.i = run.i LEFT JOIN placed b ON b.doc_id = run.doc_id AND b.i = run.j JOIN cut c ON c.doc_id = run.doc_id
), edge AS (
  SELECT doc_id, lo AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM gone UNION ALL SELECT doc_id, length(text), 1 + (SELECT count(*) FROM gone g WHERE g.doc_id = cut.doc_id) FROM cut
), start AS (
  SELECT doc_id, hi AS start, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM gone UNION ALL SELECT doc_id, 0, 1 FROM cut
), piece AS (
  SELECT doc_id, start, stop, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS part FROM start JOIN edge USING (doc_id, k) JOIN cut USING (doc_id) WHERE stop > start
), kept AS (
  SELECT doc_id, string_agg(part, '' ORDER BY start) AS text, string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start) AS pieces FROM piece GROUP BY 1
), removed AS (
  SELECT doc_id, CAST(sum(words) AS BIGINT) AS n_removed, string_agg(CAST(CAST(lo AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(hi AS BIGINT) AS VARCHAR), ',' ORDER BY lo) AS removed FROM gone GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(pieces, '') AS pieces
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""
}
