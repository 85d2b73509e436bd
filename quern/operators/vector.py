"""Vector and hybrid search: exact similarity in the JVM or in Arrow batches, int8 codes, rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.query import passes
from quern.operators.lexical import DIGITS, ranked
from quern.operators.top import Top

#: Constant of reciprocal rank fusion.
RRF = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """The vector of length 1; null for a zero vector."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """dot; cosine of normalised vectors; minus the squared distance (l2)."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return dot(normalised(a), normalised(b))
    if metric == "l2":
        d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return F.lit(0.0) - F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    raise ValueError(f"unknown metric {metric!r}")


def search_vector(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where=None, ef: int = 0) -> DataFrame:
    """The k most similar of (ord, vector[, meta]): exact, in one pass; each Arrow batch is one product and passes its k best on.

    `ef` is for approximate indexes (`ann`) and has no effect.  A zero query has no neighbours under cosine; neither
    has a zero vector, nor one of another dimension.
    """
    del ef
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if where is not None:
        vectors = vectors.where(passes(where, F.col("meta")))
    q = np.array([query], np.float64)

    def work(it):
        for ids, v in _matrices(it, q.shape[1]):
            _, top, score = best(np.zeros(1, np.int64), q, ids, v, k, metric)
            yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(score)], names=["ord", "score"])

    return ranked(vectors.select(F.col("ord").cast("bigint"), "vector").mapInArrow(work, "ord long, score double"), k, ascending_ord=True)


METRICS = ("dot", "cosine", "l2")


def _matrices(it, dim: int):
    """(ids, vectors of this dimension as a matrix) of batches (id, vector)."""
    for b in it:
        col = b.column(1)
        at = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)) == dim)
        if at.size and dim:
            yield np.asarray(b.column(0))[at], np.asarray(col.take(pa.array(at)).flatten()).astype(np.float64).reshape(-1, dim)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k most similar vectors of each query; ties by id."""
    if metric == "l2":
        s = 0.0 - np.stack([((v - x) ** 2).sum(1) for x in q])
    else:
        s = _unit(q) @ _unit(v).T if metric == "cosine" else q @ v.T
    s = np.round(s, DIGITS) + 0.0
    s[np.isnan(s)] = -np.inf
    top = np.stack([np.lexsort((ids, -x))[:k] for x in s])
    query, at, score = np.repeat(q_ids, top.shape[1]), top.ravel(), np.take_along_axis(s, top, 1).ravel()
    good = score > -np.inf
    return query[good], ids[at][good], score[good]


#: Vectors of a block and queries of a product, the units of batch search; queries that a task holds, and hits that it keeps
#: for them; tasks for each core, if there are few queries.
BLOCK, GROUP, KEPT, WAVES = 2048, 65_536, 4_000_000, 2


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, m / size, np.nan)


def _blocks(df: DataFrame, ids: str, cell: bool = False) -> DataFrame:
    """Rows (cell, dim, ids, data) of up to BLOCK vectors of one cell and dimension each, as packed 64-bit numbers."""

    def work(it):
        for b in it:
            key, col, of = np.asarray(b.column(0)), b.column(1), np.asarray(b.column(2))
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
            for c in np.unique(of):
                for d in np.unique(size[(of == c) & (size > 0)]):
                    at = np.flatnonzero((of == c) & (size == d))
                    v = np.asarray(col.take(pa.array(at)).flatten()).astype(np.float64).reshape(-1, d)
                    cut = range(0, at.size, BLOCK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c] * len(cut), pa.int32()), pa.array([d] * len(cut), pa.int32()), pa.array([key[at[i : i + BLOCK]].tobytes() for i in cut], pa.binary()), pa.array([v[i : i + BLOCK].tobytes() for i in cut], pa.binary())],
                        names=["cell", "dim", "ids", "data"],
                    )

    of = F.col("cell").cast("int") if cell else F.lit(0)
    return df.where(F.col(ids).isNotNull()).select(F.col(ids).cast("bigint"), "vector", of.alias("cell")).mapInArrow(work, "cell int, dim int, ids binary, data binary")


class _Asked:
    """Queries of one dimension, and the best of what they met."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, probed=None):
        if metric == "cosine":
            q = _unit(q)
            ids, q = ids[good := ~np.isnan(q).any(1)], q[good]
        self.ids, self.q, self.metric, self.top = ids, q, metric, Top(len(ids), k)
        # unit vectors are screened in 32 bits
        self.rough, self.size = (q.astype(np.float32), np.ones(len(q))) if metric == "cosine" else (q, np.sqrt((q * q).sum(1)))
        self.cells = None if probed is None else np.concatenate([probed(q[i : i + BLOCK]) for i in range(0, max(1, len(q)), BLOCK)])

    def meet(self, cell: int, ids: np.ndarray, v: np.ndarray) -> None:
        if self.metric == "cosine":
            v = _unit(v)
            ids, v = ids[good := ~np.isnan(v).any(1)], v[good]
        rough, size = v.astype(self.rough.dtype), np.sqrt((v * v).sum(1))
        rows = np.arange(len(self.ids)) if self.cells is None else np.flatnonzero(self.cells[:, cell])
        for i in range(0, len(rows) if len(ids) else 0, BLOCK):
            own = rows[i : i + BLOCK]
            s = self.rough[own] @ rough.T
            if self.metric == "l2":
                s = 2 * s - (self.size[own] ** 2)[:, None] - size**2
            span = (self.size[own].max() + size.max()) ** 2
            margin = (self.q.shape[1] + 8) * float(np.finfo(rough.dtype).eps) * (1 if self.metric == "cosine" else span) + 10.0**-DIGITS
            self.top.offer(own, s, ids, margin, lambda a, b, own=own: self._exact(self.q[own[a]], v[b]))

    def _exact(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        s = 0.0 - ((v - q) ** 2).sum(1) if self.metric == "l2" else np.einsum("ij,ij->i", q, v)
        return np.round(s, DIGITS) + 0.0


def met(queries: DataFrame, vectors: DataFrame, k: int, metric: str, probed=None, dim: int = 0) -> DataFrame:
    """(query_id, ord, score, rank): the k best of `vectors` (ord, vector[, cell]) for each of `queries` (query_id, vector).

    A task holds one group of queries and the best they have met so far, while blocks of one share of the vectors pass by;
    it gives k rows a query.  There are as many groups as the queries need, and as many shares as the cores need besides.
    So each vector is sent once a group and each query once a share; nothing passes through the driver or is broadcast, and
    a task's memory doesn't grow with the tables.  `probed` says, for queries of dimension `dim`, which cells each looks at.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-queries.count() // max(BLOCK, min(GROUP, KEPT // max(1, k)))))
    shares = max(1, -(-WAVES * cores // groups))
    place = F.monotonically_increasing_id()
    # blocks are numbered within their partitions, which begin at places of their own
    at = lambda n: F.pmod(F.xxhash64(place), F.lit(n)).cast("int")
    asked = _blocks(queries, "query_id").withColumn("kind", F.lit(0)).withColumn("own", at(groups))
    asked = asked.withColumn("task", F.explode(F.sequence(F.col("own") * shares, F.col("own") * shares + shares - 1)))
    held = _blocks(vectors, "ord", probed is not None).withColumn("kind", F.lit(1)).withColumn("own", at(shares))
    held = held.withColumn("task", F.explode(F.sequence(F.col("own"), F.col("own") + shares * (groups - 1), F.lit(shares))))
    cols = ["task", "kind", "cell", "dim", "ids", "data"]
    dealt = asked.select(cols).unionByName(held.select(cols)).repartitionById(groups * shares, F.col("task")).sortWithinPartitions("task", "kind", "dim", "cell")

    def work(it):
        asked: dict[int, list] = {}
        ready: dict[int, _Asked] = {}
        block: list = []
        now = None

        def out():
            for a in ready.values():
                at, top, score = a.top.rows()
                for i in range(0, at.size, 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)]) for c in (a.ids[at], top, score)], names=["query_id", "ord", "score"])

        def meet():
            if block:
                d, cell = block[0][:2]
                if d in asked:
                    ids, q = (np.concatenate(x) for x in zip(*asked.pop(d)))
                    ready[d] = _Asked(ids, q, k, metric, probed)
                if d in ready:
                    ready[d].meet(cell, *(np.concatenate(x) for x in zip(*(x[2:] for x in block))))
                block.clear()

        for b in it:
            for i in range(b.num_rows):
                task, kind, cell, d = (b.column(x)[i].as_py() for x in range(4))
                ids, data = (np.frombuffer(b.column(x)[i].as_buffer(), t) for x, t in ((4, np.int64), (5, np.float64)))
                data = data.reshape(-1, d)
                if task != now:
                    meet()
                    yield from out()
                    asked, ready, now = {}, {}, task
                if kind == 0:
                    if probed is None or d == dim:
                        asked.setdefault(d, []).append((ids, data))
                else:
                    if block and (block[0][:2] != (d, cell) or sum(len(x[2]) for x in block) + len(ids) > BLOCK):
                        meet()
                    block.append((d, cell, ids, data))
        meet()
        yield from out()

    return ranked(dealt.mapInArrow(work, "query_id long, ord long, score double"), k, ["query_id"], ascending_ord=True)


def search_vector_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, ord, score, rank) for queries (query_id, vector), exact: every query meets every vector, in blocks (`met`)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return met(queries, vectors, k, metric)


def quantize(vector: Column) -> Column:
    """struct<scale, codes>: eight-bit codes against the largest magnitude; a zero vector has zero codes."""
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    # halves are rounded away from zero
    code = lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale * 127))))
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: code(x).cast("int")).alias("codes"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c * q["scale"] / 127)


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`quantize` of the rows of a matrix: scales and eight-bit codes."""
    scale = np.abs(v).max(1, initial=0)
    x = v / np.where(scale == 0, 1, scale)[:, None] * 127
    return scale, np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int8)


def search_vector_int8(vectors: DataFrame, query: list[float], k: int = 10, over: int = 3, metric: str = "dot") -> DataFrame:
    """Two stages: the over * k best by eight-bit codes are scored again with their own numbers.

    Codes are compared in Arrow batches, each of which passes its over * k best on with their vectors.
    """
    q = np.array([query], np.float64)
    q_scale, q_codes = codes(q)
    coarse = q_codes * q_scale[:, None] / 127

    def work(it):
        for ids, v in _matrices(it, q.shape[1]):
            scale, code = codes(v)
            _, top, score = best(np.zeros(1, np.int64), coarse, ids, code * scale[:, None] / 127, k * over, metric)
            where = {int(x): i for i, x in enumerate(ids)}
            rows = v[[where[int(x)] for x in top]]
            yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(score), pa.array(list(rows), pa.list_(pa.float64()))], names=["ord", "score", "vector"])

    coded = vectors.select(F.col("ord").cast("bigint"), "vector").mapInArrow(work, "ord long, score double, vector array<double>")
    first = coded.orderBy(F.col("score").desc(), "ord").limit(k * over)
    want = F.array(*[F.lit(float(x)) for x in query])
    return ranked(first.select("ord", F.round(similarity(metric, F.col("vector"), want), DIGITS).alias("score")), k, ascending_ord=True)


def fuse(legs: list[DataFrame], k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (ord, rank, and the columns of `by`): ties by ord ascending."""
    by = by or []
    rows = legs[0].select(*by, "ord", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select(*by, "ord", "rank"))
    hits = rows.groupBy(*by, "ord").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return ranked(hits, k, by or None, ascending_ord=True)


def candidates(k: int) -> int:
    """How many hits of each leg go into a fusion."""
    return max(4 * k, 64)


__all__ = ["candidates", "dequantize", "dot", "fuse", "normalised", "quantize", "search_vector", "search_vector_batch", "search_vector_int8", "similarity"]
