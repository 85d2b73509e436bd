"""License scans: diagonal voting of rolling word k-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import ragged
from quern.llm.licenses import TEMPLATES
from quern.llm.shared import map_arrow, materialize, need, table

K = 3
#: An alignment is tried if it has this share of its template's k-grams, and kept if its longest common
#: subsequence has this share of the template's words.
LEAST_VOTES, LEAST_SIMILARITY = 0.3, 0.8
REGIONS = "doc_id long, first int, words array<long>, starts array<int>, stops array<int>, at array<int>, hashes array<long>"


def _grams(w: ragged.Words) -> tuple[np.ndarray, np.ndarray]:
    return w.ngrams(K)


def template_grams(templates) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of the templates."""
    out = []
    for i, (_, text) in enumerate(templates):
        h, at = _grams(ragged.hash_words([text]))
        out += [(int(x), i, int(p)) for x, p in zip(h.view(np.int64), at)]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not a.size or not b.size:
        return 0
    row = np.zeros(b.size + 1, np.int64)
    for x in a:
        take = np.where(b == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], take))
    return int(row[-1])


def license_spans(docs: DataFrame, templates=TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of documents that are licence notices: (doc_id, license, start, stop, votes, similarity).

    Offsets are in code points.  One pass finds the regions of each text with k-grams of any template
    (a template list is a constant of the program, so its hashes travel with it); their k-grams are joined
    with template positions, votes are summed by offset diagonal, and diagonals are merged that are nearer to each
    other than the template is long: so many words may be added or missing between the parts of one copy.
    Each copy in a band, which ends where positions fall back, is verified by its longest common subsequence.
    Regions end where no template's words follow within the longest template's length.  Of spans that overlap in a region, the
    one with the most common words stays, then the most similar, then the template listed first.

    Null or empty texts, and templates of fewer than 3 words, give nothing; a null doc_id is kept;
    repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    grams = template_grams(templates)
    wanted = np.unique(np.array([g[0] for g in grams], np.int64).view(np.uint64))
    sizes = [len(ragged.hash_words([t]).hash) for _, t in templates]
    reach = max(sizes, default=0)

    def scan(it):
        for batch, col in ragged.batches(it, "text"):
            ids = batch.column(0)
            rows = []
            for lo, hi in ragged.slices(col):
                w = ragged.words(col, lo, hi)
                h, at = _grams(w)
                hit = ragged.member(wanted, h)
                h, at = h[hit], at[hit]
                if not at.size:
                    continue
                chars = w.chars()
                cut = np.flatnonzero((np.diff(at) > reach) | (np.diff(w.doc[at]) != 0)) + 1
                for a, b in zip(np.append(0, cut), np.append(cut, at.size)):
                    i, j, d = at[a], at[b - 1] + K, w.doc[at[a]]
                    base = chars[w.text_at[d]]
                    rows.append((ids[lo + int(d)].as_py(), int(i - w.first[d]), w.hash[i:j].view(np.int64), (chars[w.start[i:j]] - base).astype(np.int32), (chars[w.end[i:j]] - base).astype(np.int32), (at[a:b] - i).astype(np.int32), h[a:b].view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "first", "words", "starts", "stops", "at", "hashes"])

    found = map_arrow(need(docs, key, text).toDF("doc_id", "text"), scan, REGIONS)
    regions = materialize(found.withColumn("region", F.monotonically_increasing_id()), "license-regions")
    positions = spark.createDataFrame(grams, "hash long, template int, position int")
    votes = regions.select("region", F.explode(F.arrays_zip("at", "hashes")).alias("g")).select("region", "g.at", F.col("g.hashes").alias("hash")).join(positions, "hash")
    by_diagonal = votes.withColumn("diagonal", F.col("at") - F.col("position")).groupBy("region", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    least = spark.createDataFrame([(i, n, max(1.0, LEAST_VOTES * (n - K + 1))) for i, n in enumerate(sizes)], "template int, size int, least double")  # a row for each template
    along = Window.partitionBy("region", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) >= F.col("size")).cast("int"), F.lit(1))
    merged = by_diagonal.join(F.broadcast(least), "template").withColumn("apart", apart).withColumn("band", F.sum("apart").over(along))
    merged = merged.groupBy("region", "template", "least", "band").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), (F.max("hi") + K).alias("hi"))
    tried = merged.where("votes >= least").groupBy("region").agg(F.collect_list(F.struct("template", "votes", "lo", "hi")).alias("spans"))

    kept = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("votes", T.LongType()), T.StructField("similarity", T.DoubleType())]))

    @F.pandas_udf(kept)
    def verify(words: pd.Series, spans: pd.Series) -> pd.Series:
        known = [ragged.hash_words([t]).hash.view(np.int64) for _, t in templates]
        return pd.Series([_verified(np.asarray(w), list(s), known, templates) for w, s in zip(words, spans)])

    checked = regions.join(tried, "region").select("doc_id", "starts", "stops", F.explode(verify("words", "spans")).alias("s"))
    return checked.select("doc_id", "s.license", F.get("starts", F.col("s.lo")).alias("start"), F.get("stops", F.col("s.hi") - 1).alias("stop"), "s.votes", "s.similarity")


def copies(words: np.ndarray, want: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end word, votes) of the copies of a template among the words of a band, in which positions rise."""
    where: dict[bytes, list[int]] = {}
    for p in range(want.size - K + 1):
        where.setdefault(want[p : p + K].tobytes(), []).append(p)
    out: list[list[int]] = []
    for at in range(words.size - K + 1):
        if not (places := where.get(words[at : at + K].tobytes())):
            continue
        if out:
            hi, top = out[-1][1] - K, out[-1][3]
            # the place that goes on best, if one does
            p = min(places, key=lambda x: (x < top - want.size // 2, abs(x - top - (at - hi))))
            if p >= top - want.size // 2 and at - hi < top + want.size:
                out[-1] = [out[-1][0], at + K, out[-1][2] + 1, max(top, p)]
                continue
        out.append([at, at + K, 1, places[0]])
    return [tuple(c[:3]) for c in out]


def _verified(words: np.ndarray, spans: list, known: list[np.ndarray], templates) -> list[tuple]:
    """Spans of a region that agree with their templates, without overlaps."""
    good = []
    for s in spans:
        want = known[s["template"]]
        for lo, hi, votes in copies(words[s["lo"] : s["hi"]], want):
            if votes < LEAST_VOTES * (want.size - K + 1):
                continue
            common = _common(want, words[s["lo"] + lo : s["lo"] + hi])
            if common >= LEAST_SIMILARITY * want.size:
                good.append((-common, -common / want.size, s["template"], s["lo"] + lo, s["lo"] + hi, votes))
    out: list[tuple] = []
    for common, share, i, lo, hi, votes in sorted(good):
        if all(hi <= o[1] or lo >= o[2] for o in out):
            out.append((templates[i][0], int(lo), int(hi), int(votes), float(-share)))
    return sorted(out, key=lambda o: o[1])


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
