"""A collection: a log of documents in Parquet with its configuration, and every search over its latest view."""

from __future__ import annotations

import enum
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.query import VALUE, SynonymMap
from quern.functions.text import Analyzer
from quern.operators import kv, lexical, vector
from quern.operators.lexical import Bm25, FieldIndex, Index
from quern.operators.stored import StoredIndex, read_text, write_text


class Kind(enum.Enum):
    NOT_FOUND = "not found"
    KEY_TOO_LARGE = "key too large"
    VALUE_TOO_LARGE = "value too large"
    ALREADY_EXISTS = "already exists"
    READ_ONLY = "read only"
    INVALID_OPTION = "invalid option"
    NO_INDEX = "no index"
    MODE_MISMATCH = "mode mismatch"
    OUT_OF_DATE = "out of date"


class CollectionError(Exception):
    def __init__(self, kind: Kind, text: str = ""):
        super().__init__(f"{kind.value}: {text}" if text else kind.value)
        self.kind = kind


@dataclass(frozen=True)
class Options:
    """What a collection is, fixed when it is made, and how it is read."""

    enable_search: bool = False
    analyzer: Analyzer = field(default_factory=Analyzer)
    bm25: Bm25 = field(default_factory=Bm25)
    index_positions: bool = True
    vector_dim: int = 0
    vector_metric: str = "cosine"
    expiry_secs: int = 0
    policy: kv.Policy = field(default_factory=kv.Policy)
    read_write: bool = True
    synonyms: SynonymMap | None = None
    cache_size: int = 0

    def mode(self) -> dict:
        """What can't change."""
        return {"enable_search": self.enable_search, "vector_dim": self.vector_dim, "vector_metric": self.vector_metric if self.vector_dim else None, "analyzer": asdict(self.analyzer) if self.enable_search else None}


LOG = f"key string, ord bigint, tstamp bigint, is_tombstone boolean, file_id bigint, text string, fields array<struct<name:string,value:string>>, vector array<float>, meta map<string,{VALUE}>"
MAX_KEY, MAX_VALUE = 64 << 10, (4 << 30) - 1
#: Hits of a query that are remembered, at most.
MAX_CACHED = 1_000


class Collection:
    """Documents by key; the last write of a key counts.

    Writes append to the log, one file number for each batch; there is one writer at a time.  Everything that is read
    is derived from the log, so an index can't fall behind it.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options, self.closed = spark, path.rstrip("/"), options, False
        self._results: dict[tuple, tuple] = {}

    # -- life cycle

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Collection:
        """The collection at a path, made if there is none; another mode than it was made with is an error."""
        options = options or Options()
        if options.vector_dim and not options.enable_search:
            raise CollectionError(Kind.INVALID_OPTION, "vectors need search")
        out = cls(spark, path, options)
        there = out._config()
        if there is None:
            if not options.read_write:
                raise CollectionError(Kind.NOT_FOUND, path)
            out._write_config(options.mode())
        elif there != json.loads(json.dumps(options.mode())):
            raise CollectionError(Kind.MODE_MISMATCH, path)
        return out

    @classmethod
    def upgrade(cls, spark: SparkSession, path: str, options: Options) -> Collection:
        """A key-value collection becomes a searchable one; its values are its texts."""
        old = cls(spark, path, Options())._config()
        if old is None:
            raise CollectionError(Kind.NOT_FOUND, path)
        if old["enable_search"]:
            raise CollectionError(Kind.ALREADY_EXISTS, "already searchable")
        out = cls(spark, path, options)
        out._write_config(options.mode())
        return out

    def close(self) -> None:
        self.closed = True

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _config(self) -> dict | None:
        fs, p = self._fs(f"{self.path}/collection.json")
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else None

    def _write_config(self, mode: dict) -> None:
        write_text(self.spark, f"{self.path}/collection.json", json.dumps(mode))

    def _open(self, write: bool = False, index: bool = False) -> None:
        if self.closed:
            raise CollectionError(Kind.INVALID_OPTION, "closed")
        if write and not self.options.read_write:
            raise CollectionError(Kind.READ_ONLY)
        if index and not self.options.enable_search:
            raise CollectionError(Kind.NO_INDEX)

    # -- writes

    @property
    def log(self) -> DataFrame:
        """Every write."""
        self._open()
        version = self._version()
        fs, p = self._fs(version)
        return self.spark.read.schema(LOG).parquet(version) if fs.exists(p) else self.spark.createDataFrame([], LOG)

    def _version(self) -> str:
        fs, p = self._fs(f"{self.path}/current")
        name = self.spark.read.text(p.toString(), wholetext=True).first()[0].strip() if fs.exists(p) else "log"
        return f"{self.path}/{name}"

    def append(self, rows: DataFrame) -> None:
        """Write a batch: rows with key and any of tstamp, is_tombstone, text, fields, vector, meta, in the order of `seq` if there is one.

        Keys are checked for size and vectors for their dimension; under cosine they are stored at length 1, and a
        zero vector is an error.  Times of 0 or none are now.
        """
        self._open(write=True)
        names = rows.columns
        have = lambda c, kind: F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
        last = self.log.agg(F.coalesce(F.max("ord"), F.lit(-1)), F.coalesce(F.max("file_id"), F.lit(-1))).first()
        # numbers within the batch from its partitions' sizes, not from one sort
        placed = rows.withColumn("_at", F.col("seq").cast("bigint") if "seq" in names else F.monotonically_increasing_id())
        now = int(time.time())
        data = placed.select(
            F.col("key").cast("string").alias("key"), "_at", F.when(F.coalesce(have("tstamp", "bigint"), F.lit(0)) == 0, now).otherwise(have("tstamp", "bigint")).alias("tstamp"), F.coalesce(have("is_tombstone", "boolean"), F.lit(False)).alias("is_tombstone"),
            have("text", "string").alias("text"), have("fields", "array<struct<name:string,value:string>>").alias("fields"), have("vector", "array<float>").alias("vector"), have("meta", f"map<string,{VALUE}>").alias("meta"),
        )
        bad = F.when(F.octet_length("key") > MAX_KEY, "key").when(F.octet_length("text") > MAX_VALUE, "value")
        if self.options.vector_dim:
            bad = bad.when(F.size("vector") != self.options.vector_dim, "dim")
            if self.options.vector_metric == "cosine":
                data = data.withColumn("unit", vector.normalised(F.col("vector")))
                bad = bad.when(F.col("vector").isNotNull() & F.col("unit").isNull(), "zero")
        else:
            bad = bad.when(F.col("vector").isNotNull(), "dim")
        # the batch is written aside once, so that its rows are numbered and checked as they are stored
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        data.withColumn("bad", bad).write.parquet(aside)
        try:
            self._take(self.spark.read.parquet(aside), last, "seq" in names)
        finally:
            fs, p = self._fs(aside)
            fs.delete(p, True)

    def _take(self, data: DataFrame, last, placed: bool) -> None:
        """Append a batch that is stored aside, with numbers after the last one's."""
        wrong = data.select("bad").where("bad is not null").first()
        if wrong:
            raise CollectionError({"key": Kind.KEY_TOO_LARGE, "value": Kind.VALUE_TOO_LARGE}.get(wrong[0], Kind.INVALID_OPTION), f"vector: {wrong[0]}")
        if "unit" in data.columns:
            data = data.withColumn("vector", F.col("unit").cast("array<float>"))
        if placed and not data.groupBy("_at").count().where("count > 1").isEmpty():
            raise CollectionError(Kind.INVALID_OPTION, "seq repeats")
        numbered = data.withColumn("ord", F.col("_at") + F.lit(last[0] + 1)) if placed else _number(data, last[0] + 1)
        out = numbered.withColumn("file_id", F.lit(last[1] + 1).cast("bigint"))
        out.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(self._version())
        self._results.clear()

    def put(self, key: str, value: str, tstamp: int = 0) -> None:
        self.put_doc(key, text=value, tstamp=tstamp)

    def put_doc(self, key: str, text: str | None = None, fields: list[tuple[str, str]] | None = None, vector: list[float] | None = None, meta: dict | None = None, tstamp: int = 0) -> None:
        row = (key, tstamp, text, fields, vector, {k: _tagged(v) for k, v in meta.items()} if meta else None)
        self.append(self.spark.createDataFrame([row], f"key string, tstamp bigint, text string, fields array<struct<name:string,value:string>>, vector array<float>, meta map<string,{VALUE}>"))

    def remove(self, key: str) -> None:
        """A tombstone, whether or not the key is there."""
        self.append(self.spark.createDataFrame([(key, True)], "key string, is_tombstone boolean"))

    # -- reads

    def docs(self, snapshot: int | None = None) -> DataFrame:
        return kv.latest(self.log, snapshot)

    def get(self, key: str, now: int | None = None):
        """The record of a key, or none if it was never written, removed, or is expired."""
        return kv.get(self.log, [key], int(time.time()) if now is None else now, self.options.expiry_secs).first()

    def scan(self, snapshot: int | None = None, see_tombstones: bool = False, now: int | None = None) -> DataFrame:
        rows = kv.latest(self.log, snapshot, see_tombstones)
        return rows.where(kv.alive(int(time.time()) if now is None else now, self.options.expiry_secs))

    def parallel_scan(self, visit) -> int:
        """Call `visit` with an iterator of rows in every partition; the number of keys."""
        n = self.spark.sparkContext.accumulator(0)

        def each(it):
            seen = 0

            def counted():
                nonlocal seen
                for row in it:
                    seen += 1
                    yield row

            rows = counted()
            visit(rows)
            for _ in rows:
                pass
            n.add(seen)

        self.scan().foreachPartition(each)
        return n.value

    def materialize_view(self) -> None:
        """Store the latest view, tombstones included, for iterators that may be a little behind."""
        self._open()
        name, last = f"view-{uuid.uuid4().hex}", self._last()
        kv.latest(self.log, last, True).write.parquet(f"{self.path}/{name}")
        write_text(self.spark, f"{self.path}/view.json", json.dumps({"name": name, "last": last, "time": time.time()}))

    def _last(self) -> int:
        return self.log.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]

    def iterate(self, max_age: float | None = None, max_puts: int | None = None, see_tombstones: bool = False) -> DataFrame:
        """The stored view, if it is at most so many seconds old and so many writes behind; else it is out of date."""
        self._open()
        held = read_text(self.spark, f"{self.path}/view.json")
        held = json.loads(held) if held else None
        if held is None or (max_age is not None and time.time() - held["time"] > max_age) or (max_puts is not None and self._last() - held["last"] > max_puts):
            raise CollectionError(Kind.OUT_OF_DATE)
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/{held['name']}")
        return rows if see_tombstones else rows.where("not is_tombstone")

    def status(self) -> DataFrame:
        return kv.status(self.log)

    def is_empty(self) -> bool:
        return kv.is_empty(self.log)

    def key_length_histogram(self) -> DataFrame:
        return kv.key_length_histogram(self.log)

    # -- search

    def index(self) -> Index:
        """The index over texts; documents with fields are found through these alone."""
        self._open(index=True)
        own = self.docs().where(F.col("fields").isNull() | (F.size("fields") == 0))
        return Index.of(own.select("ord", F.coalesce("text", F.lit("")).alias("text"), "meta"), self.options.analyzer)

    def field_index(self) -> FieldIndex:
        self._open(index=True)
        whole = F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.array(F.struct(F.lit("default").alias("name"), F.coalesce("text", F.lit("")).alias("value"))))
        return FieldIndex(self.docs().select("ord", whole.alias("fields")), self.options.analyzer)

    def _derived(self) -> Index:
        if self.options.analyzer.stemming or self.docs().where("size(fields) > 0").isEmpty():
            return self.index()
        out = self.field_index().catch_all
        out.metadata = self.docs().select("ord", "meta")
        return out

    def _default(self) -> Index:
        """The default field of all documents, their texts or their fields one after the other: the stored index if it is up to
        date, else derived from the log."""
        self._open(index=True)
        held = read_text(self.spark, f"{self.path}/index.json")
        if held and json.loads(held) == self._state():
            return StoredIndex.open(self.spark, f"{self.path}/index", self.options.analyzer)
        return self._derived()

    def _state(self) -> dict:
        return {"last": self._last(), "log": self._version().rsplit("/", 1)[1]}

    def rebuild_index(self) -> None:
        """Store the index by term; searches read it until something is written."""
        self._open(write=True, index=True)
        state = self._state()
        StoredIndex.write(self._derived(), f"{self.path}/index")
        write_text(self.spark, f"{self.path}/index.json", json.dumps(state))
        StoredIndex.drop_old(self.spark, f"{self.path}/index")

    def compact_index(self, dead_ratio: float = 0.2) -> None:
        """Take removed documents out of the stored index, if they are at least this share of it; what was added is not in it."""
        self._open(write=True, index=True)
        held, state = StoredIndex.open(self.spark, f"{self.path}/index", self.options.analyzer), read_text(self.spark, f"{self.path}/index.json")
        if held is None or state is None:
            return
        live, now = self.docs().select("ord"), self._state()
        added = live.where(F.col("ord") > json.loads(state)["last"]).limit(1).count()
        if held.compact(live, f"{self.path}/index", dead_ratio) is not held and not added:
            write_text(self.spark, f"{self.path}/index.json", json.dumps(now))

    def _keys(self, hits: DataFrame) -> DataFrame:
        return self.docs().select("key", "ord").join(hits, "ord")

    def search_text(self, query, k: int = 10, params: Bm25 | None = None, where=None, filter_mode: str = "pre") -> DataFrame:
        """With `cache_size`, the hits of as many plain queries are remembered until the next write."""
        plain = self.options.cache_size and isinstance(query, str) and where is None
        key = (query, k, params or self.options.bm25)
        if plain and key in self._results:
            rows, schema = self._results[key] = self._results.pop(key)
            return self.spark.createDataFrame(rows, schema)
        hits = lexical.search_text(self._default(), query, k, params or self.options.bm25, self.options.synonyms, where, filter_mode)
        out = self._keys(hits.drop("query_id") if isinstance(query, str) else hits)
        if plain and k <= MAX_CACHED:
            self._results[key] = (out.collect(), out.schema)  # k rows
            if len(self._results) > self.options.cache_size:
                self._results.pop(next(iter(self._results)))
            return self.spark.createDataFrame(*self._results[key]) if key in self._results else out
        return out

    search_text_batch = search_text

    def search_phrase(self, query: str, k: int = 10) -> DataFrame:
        return self.search_near(query, 0, k)

    def search_near(self, query: str, slop: int = 0, k: int = 10) -> DataFrame:
        hits = lexical.search_near(self._default(), query, slop, k, self.options.bm25)
        return self._keys(hits if self.options.index_positions else hits.limit(0))

    def bool_search(self, query: str, k: int = 10) -> DataFrame:
        return self._keys(lexical.bool_search(self._default(), query, k, self.options.bm25))

    def search_fields(self, query: str, k: int = 10) -> DataFrame:
        return self._keys(self.field_index().search(query, k, self.options.bm25, self.options.synonyms))

    def search_fuzzy(self, query: str, max_edit: int = 1, k: int = 10) -> DataFrame:
        return self._keys(lexical.search_fuzzy(self._default(), query, max_edit, k, self.options.bm25))

    def search_wildcard(self, pattern: str, k: int = 10) -> DataFrame:
        return self._keys(lexical.search_wildcard(self._default(), pattern, k, self.options.bm25))

    def explain(self, query: str, key: str) -> DataFrame | None:
        row = self.docs().where(F.col("key") == key).select("ord").first()
        return None if row is None else lexical.explain(self._default(), query, row[0], self.options.bm25)

    def search_text_highlight(self, query: str, k: int = 10, **options) -> DataFrame:
        return self._keys(lexical.search_text_highlight(self._default(), self.docs().select("ord", "text"), query, k, self.options.bm25, **options))

    def _vectors(self, query) -> DataFrame:
        self._open(index=True)
        if not self.options.vector_dim or (query is not None and len(query) != self.options.vector_dim):
            raise CollectionError(Kind.INVALID_OPTION, "vector")
        return self.docs().where("vector is not null").select("ord", "vector", "meta")

    def search_vector(self, query: list[float], k: int = 10, ef: int = 0, where=None) -> DataFrame:
        return self._keys(vector.search_vector(self._vectors(query), query, k, self.options.vector_metric, where, ef))

    def search_vector_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self._keys(vector.search_vector_batch(self._vectors(None).select("ord", "vector"), queries, k, self.options.vector_metric))

    def search_hybrid(self, text: str = "", query: list[float] | None = None, k: int = 10, where=None) -> DataFrame:
        """Both legs fused by rank; one may be empty."""
        vectors = self._vectors(query)
        if not text and not query:
            raise CollectionError(Kind.INVALID_OPTION, "empty query")
        n, legs = vector.candidates(k), []
        if text:
            legs.append(lexical.search_text(self._default(), text, n, self.options.bm25, self.options.synonyms, where))
        if query:
            legs.append(vector.search_vector(vectors, query, n, self.options.vector_metric, where))
        return self._keys(vector.fuse(legs, k))

    def search_hybrid_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, key, ord, score, rank, error) for queries (query_id, text, vector), of which either may be null or empty.

        A query without both, or with a vector of another dimension, gives a row with its error; the others are answered.
        """
        vectors, n = self._vectors(None).select("ord", "vector"), vector.candidates(k)
        has = (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("t"), (F.coalesce(F.size("vector"), F.lit(0)) > 0).alias("v")
        asked = queries.select("query_id", "text", F.col("vector").cast("array<double>").alias("vector"), *has)
        error = F.when(~F.col("t") & ~F.col("v"), "empty query").when(F.col("v") & (F.size("vector") != self.options.vector_dim), "dimension")
        asked = asked.withColumn("error", error)
        good = asked.where("error is null")
        legs = [
            lexical.search_text(self._default(), good.where("t").select("query_id", "text"), n, self.options.bm25),
            vector.search_vector_batch(vectors, good.where("v").select("query_id", "vector"), n, self.options.vector_metric),
        ]
        hits = self._keys(vector.fuse(legs, k, ["query_id"])).select("query_id", "key", "ord", "score", "rank", F.lit(None).cast("string").alias("error"))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("ord", "bigint"), ("score", "double"), ("rank", "int"))]
        return hits.unionByName(asked.where("error is not null").select("query_id", *nothing, "error"))

    # -- compaction

    def file_stats(self) -> DataFrame:
        size = 23 + F.octet_length("key") + F.coalesce(F.octet_length("text"), F.lit(0)) + 4 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0))
        return kv.file_stats(self.log, size)

    def needs_merge(self, now: int = 0) -> DataFrame:
        rate = self.status().first()["dead_doc_rate"]
        last = self.log.agg(F.max("file_id")).first()[0]
        files = self.file_stats().where(F.col("file_id") < (last or 0))
        return kv.cap_size(kv.merge_candidates(files, self.options.policy, now, rate), self.options.policy.max_merge_size)

    def merge(self) -> dict:
        """Rewrite the log without dead records, as a new version that readers see at once."""
        self._open(write=True)
        before, name = self.log.count(), f"log-{uuid.uuid4().hex}"
        kv.merge(self.log).write.parquet(f"{self.path}/{name}")
        write_text(self.spark, f"{self.path}/current", name)
        after = self.log.count()
        return {"records_in": before, "records_out": after, "dropped": before - after}


def _number(data: DataFrame, first: int) -> DataFrame:
    """ord by place in the batch: offsets of the partitions, then ranks within them."""
    part = F.shiftright("_at", 33)
    sizes = data.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # one row for each partition
    return data.withColumn("part", part).join(F.broadcast(before), "part").withColumn("ord", F.lit(first) + F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def _tagged(v):
    t = 0 if v is None else {bool: 1, int: 2, float: 3, str: 4}[type(v)]
    return (t, *(v if t == i else None for i in (1, 2, 3, 4)))


__all__ = ["Collection", "CollectionError", "Kind", "LOG", "Options"]
