"""A stored index: postings by term with block maxima, vocabulary, lengths and metadata as Parquet.

An index lives in a folder of versions; the file `current` names the one that readers see and is replaced by a rename,
so that a search never meets half an index.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import Analyzer
from quern.operators.lexical import DIGITS, Bm25, Index, Terms, gathered, local, query_terms, ranked

#: Postings are divided among folders by a hash of the term, one for so many words of text, up to BUCKETS; documents of
#: a block, the unit of pruning; blocks that are scored first to find how good a hit has to be.
BUCKET_WORDS, BUCKETS, BLOCK, FIRST_BLOCKS = 4_000_000, 4096, 4096, 4
#: Words up to this many become a filter of the scan; more are joined.
FILTER_WORDS = 256
POSTINGS = "term string, ord bigint, dl bigint, tf bigint, positions array<int>, block bigint, bucket int"
BLOCKS = "term string, block bigint, n bigint, tf bigint, dl bigint, bucket int"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file as a whole: written beside it, then renamed over it."""
    fs, p = _files(spark, path)
    aside = _files(spark, f"{path}-{uuid.uuid4().hex}")[1]
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(p), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _files(spark, path)
    return spark.read.text(p.toString(), wholetext=True).first()[0] if fs.exists(p) else None


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class StoredIndex(Index):
    """An index that reads its postings by term; all searches of `lexical` take it in place of a derived one."""

    by_term = True

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer):
        self.spark, self.path, self.analyzer = spark, path, analyzer
        docs = spark.read.parquet(f"{path}/docs")
        self.metadata = docs.select("ord", "meta") if "meta" in docs.columns else None
        self.tokens = docs.select("ord", "dl")
        self.stats = json.loads(read_text(spark, f"{path}/stats.json"))
        self.stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")

    @classmethod
    def write(cls, index: Index, path: str) -> StoredIndex:
        """Store an index as a new version that becomes current when it is whole; the one before stays until `drop_old`."""
        spark, path = index.tokens.sparkSession, path.rstrip("/")
        name = f"v-{uuid.uuid4().hex}"
        where = f"{path}/{name}"
        docs = index.tokens.select("ord", "dl")
        if index.metadata is not None:
            docs = docs.join(index.metadata, "ord", "left")
        docs.write.parquet(f"{where}/docs")
        n, total = spark.read.parquet(f"{where}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        buckets = min(BUCKETS, 1 + total // BUCKET_WORDS)
        postings = gathered(index.tokens)
        placed = postings.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("block", F.floor(F.col("ord") / BLOCK))
        # salted by block, so that a word of every document is not one task's
        placed.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "term", "ord").write.partitionBy("bucket").parquet(f"{where}/postings")
        blocks = spark.read.schema(POSTINGS).parquet(f"{where}/postings").groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        blocks.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{where}/blocks")
        spark.read.schema(BLOCKS).parquet(f"{where}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{where}/terms")
        write_text(spark, f"{where}/stats.json", json.dumps({"n_docs": n, "sum_dl": total, "buckets": buckets}))
        write_text(spark, f"{path}/current", name)
        return cls(spark, where, index.analyzer)

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyzer: Analyzer) -> StoredIndex | None:
        """The current version, or none."""
        name = read_text(spark, f"{path.rstrip('/')}/current")
        return None if name is None else cls(spark, f"{path.rstrip('/')}/{name.strip()}", analyzer)

    @staticmethod
    def drop_old(spark: SparkSession, path: str) -> int:
        """Delete the versions that are not current, once no search reads them; how many there were."""
        name, gone = (read_text(spark, f"{path.rstrip('/')}/current") or "").strip(), 0
        fs, p = _files(spark, path)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.isDirectory() and s.getPath().getName() not in ("", name):
                fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # -- what searches read

    def _of(self, rows: DataFrame, words: list[str] | None) -> DataFrame:
        """Rows of these words: their folders and row groups only."""
        if words is None or len(words) > FILTER_WORDS:
            return rows
        here = local(self.spark, [(w,) for w in words], "term string").select(_bucket(F.col("term"), self.stats["buckets"])).distinct().collect() if words and self.stats["buckets"] > 1 else [(0,)]
        return rows.where(F.col("bucket").isin([r[0] for r in here]) & F.col("term").isin(words))

    def field_stats(self) -> DataFrame:
        return local(self.spark, [(self.stats["n_docs"], self.stats["sum_dl"])], "n_docs bigint, sum_dl bigint")

    def exploded(self, words: list[str] | None = None) -> DataFrame:
        return self._of(self.stored, words).select("ord", "dl", "term", F.explode("positions").alias("pos"))

    def positions(self) -> DataFrame:
        return self.stored.select("term", "ord", "tf", "positions")

    def postings(self, terms: Terms | None = None) -> DataFrame:
        rows = self.stored
        if terms is not None:
            rows = self._of(rows, terms.names)
            if terms.names is None or len(terms.names) > FILTER_WORDS:
                rows = rows.join(terms.distinct(), "term")
        return rows.select("term", "ord", "dl", "tf")

    def term_stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def compact(self, live: DataFrame, path: str, dead_ratio: float = 0.2) -> StoredIndex:
        """Without the documents that are not in `live` (ord), as a new version, if they are at least this share."""
        kept = self.tokens.join(live.select("ord"), "ord", "left_semi").count()
        n = self.stats["n_docs"]
        if not n or (n - kept) / n < dead_ratio:
            return self
        rows = self.stored.join(live.select("ord"), "ord", "left_semi")
        tokens = F.transform("positions", lambda p: F.struct(F.col("term").alias("term"), p.alias("pos")))
        gathered = rows.groupBy("ord").agg(F.array_sort(F.flatten(F.collect_list(tokens)), lambda a, b: a.pos - b.pos).alias("tokens"))
        docs = self.tokens.join(live.select("ord"), "ord", "left_semi").join(gathered, "ord", "left")
        whole = docs.select("ord", F.coalesce("tokens", F.expr("cast(array() as array<struct<term:string,pos:int>>)")).alias("tokens"), "dl")
        return StoredIndex.write(Index(whole, self.analyzer, self.metadata), path)


def search_text_pruned(index: StoredIndex, query: str, k: int = 10, params: Bm25 | None = None) -> DataFrame:
    """`search_text` with dynamic pruning by block maxima: (ord, score, rank), the same rows.

    A block's bound is the sum of what its largest tf and shortest document could give for each word.  The
    blocks of the highest bounds are scored first; their k-th score is what a hit needs, and of the rest only
    blocks whose bound reaches it are read.
    """
    params, spark = params or Bm25(), index.spark
    terms = query_terms(index, query)
    n, avgdl = index.stats["n_docs"], index.stats["sum_dl"] / index.stats["n_docs"] if index.stats["n_docs"] else 1.0
    blocks = index._of(spark.read.schema(BLOCKS).parquet(f"{index.path}/blocks"), terms.names)
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    found = {r.term: r.df for r in df.collect()}  # a row for each word of the query
    if not found:
        return ranked(spark.createDataFrame([], "ord bigint, score double"), k)
    known = local(spark, list(found.items()), "term string, df bigint")
    score = lambda: params.score(F.lit(n), F.col("df"), F.col("tf"), F.col("dl"), F.lit(avgdl))
    bounds = blocks.join(F.broadcast(known), "term").groupBy("block").agg(F.sum(score()).alias("bound"))
    postings = index.postings(terms).join(F.broadcast(known), "term").withColumn("block", F.floor(F.col("ord") / BLOCK))
    total = lambda rows: rows.groupBy("ord").agg(F.round(F.sum(score()), DIGITS).alias("score"))
    first = [r.block for r in bounds.orderBy(F.desc("bound")).limit(FIRST_BLOCKS).collect()]
    within = postings.where(" or ".join(f"ord between {b * BLOCK} and {b * BLOCK + BLOCK - 1}" for b in first))
    best = [r.score for r in total(within).orderBy(F.desc("score")).limit(k).collect()]
    least = best[-1] if len(best) == k else 0.0
    rest = bounds.where(F.col("bound") >= least - 10.0**-DIGITS).select("block")
    return ranked(total(postings.join(rest, "block", "left_semi")), k)
