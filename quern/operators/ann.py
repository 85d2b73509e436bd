"""Approximate vector search: an inverted file of cells around centroids, stored by cell, scored exactly within cells."""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.query import passes
from quern.operators.lexical import ranked
from quern.operators.stored import read_text, write_text
from quern.operators.vector import METRICS, _matrices, _unit, best, met

#: Centroids are fitted to a sample of at most so many vectors, the smallest by a hash of their ids; every vector is indexed.
SAMPLE, ROUNDS, SEED = 50_000, 15, 17
#: Vectors whose distances to all centroids are held at once.
SLICE = 2048
#: Share of the cells that a search looks at if nothing is asked for: evenly spread vectors, the worst case, need so many for a
#: recall of 0.9; clustered ones need few.
PROBE_SHARE = 0.6


def _fit(v: np.ndarray, cells: int, metric: str) -> np.ndarray:
    """Lloyd's k-means; under cosine on the unit sphere.  An empty cell takes the vector that is worst placed."""
    r = np.random.default_rng(SEED)
    centre = v[r.choice(len(v), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        cell, far = _placed(v, centre)
        for c in range(cells):
            own = v[cell == c]
            if len(own):
                centre[c] = own.mean(0)
            else:
                centre[c] = v[far.argmax()]
                far[far.argmax()] = 0
        if metric == "cosine":
            centre = np.nan_to_num(_unit(centre))
    return centre


def _distances(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (v * v).sum(1)[:, None] - 2 * v @ centre.T + (centre * centre).sum(1)


def _placed(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its distance, by slices of a bounded matrix."""
    parts = [(d.argmin(1), d.min(1)) for d in (_distances(v[i : i + SLICE], centre) for i in range(0, len(v), SLICE))]
    return np.concatenate([c for c, _ in parts]), np.concatenate([f for _, f in parts])


def _nearest(q: np.ndarray, centre: np.ndarray, metric: str, n: int) -> np.ndarray:
    """The n nearest cells of each query; of inner products those of the largest."""
    if metric == "cosine":
        q = np.nan_to_num(_unit(q))
    far = -(q @ centre.T) if metric == "dot" else _distances(q, centre)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


class IvfIndex:
    """Vectors (ord, vector[, meta]) by cell.  A search reads the cells nearest to its query and ranks what they hold exactly,
    so its recall rises with `probes` to 1 at all cells; `rebuild` after many writes keeps cells even."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = json.loads(read_text(spark, f"{path}/centroids.json"))
        self.metric, self.centre = held["metric"], np.array(held["centroids"], np.float64).reshape(len(held["centroids"]), -1) if held["centroids"] else np.zeros((0, 0))
        self.rows = spark.read.schema(held["schema"]).parquet(f"{path}/cells")

    @classmethod
    def write(cls, vectors: DataFrame, path: str, metric: str = "cosine", cells: int = 0) -> IvfIndex:
        """Fit centroids, assign every vector, and store the cells as a new version that becomes current when it is whole.

        cells: their number; about the square root of the number of vectors by default.  Vectors of another dimension
        than the first of the sample, null ones, and zero ones under cosine, have no cell.
        """
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        spark, name = vectors.sparkSession, f"v-{uuid.uuid4().hex}"
        good = vectors.where("vector is not null and size(vector) > 0")
        sample = [r.vector for r in good.orderBy(F.xxhash64("ord"), "ord").limit(SAMPLE).select("vector").collect()]  # at most SAMPLE
        dim = len(sample[0]) if sample else 0
        v = np.array([x for x in sample if len(x) == dim], np.float64).reshape(-1, dim)
        if metric == "cosine":
            v = _unit(v)
            v = v[~np.isnan(v).any(1)]
        n = min(len(v), cells or max(1, math.isqrt(good.count())))
        centre = _fit(v, n, metric) if n else np.zeros((0, dim))
        meta = [c for c in ("meta",) if c in vectors.columns]

        def work(it):
            for ids, m in _matrices(it, dim):
                u = _unit(m) if metric == "cosine" else m
                ok = ~np.isnan(u).any(1)
                if len(centre) and ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(_placed(u[ok], centre)[0].astype(np.int32))], names=["ord", "cell"])

        placed = good.select(F.col("ord").cast("bigint"), "vector").mapInArrow(work, "ord long, cell int")
        rows = good.select(F.col("ord").cast("bigint").alias("ord"), "vector", *meta).join(placed, "ord")
        # salted, so that a cell of very many vectors is not one task's
        rows.repartition("cell", F.pmod(F.xxhash64("ord"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/{name}/cells")
        write_text(spark, f"{path}/{name}/centroids.json", json.dumps({"metric": metric, "centroids": centre.tolist(), "schema": ", ".join(f"{c} {t}" for c, t in rows.select("ord", "vector", *meta, "cell").dtypes)}))
        write_text(spark, f"{path}/current", name)
        return cls(spark, f"{path}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfIndex | None:
        name = read_text(spark, f"{path.rstrip('/')}/current")
        return None if name is None else cls(spark, f"{path.rstrip('/')}/{name.strip()}")

    def probed(self, q: np.ndarray, probes: int = 0) -> np.ndarray:
        """The nearest cells of each query; of inner products those of the largest."""
        return _nearest(q, self.centre, self.metric, self._probes(probes))

    def _probes(self, probes: int) -> int:
        return min(len(self.centre), probes or math.ceil(PROBE_SHARE * len(self.centre)))

    def search(self, query: list[float], k: int = 10, probes: int = 0, where=None) -> DataFrame:
        """(ord, score, rank): the k most similar of the probed cells, whose folders alone are read."""
        q = np.array([query], np.float64)
        if len(self.centre) == 0 or q.shape[1] != self.centre.shape[1]:
            return ranked(self.spark.createDataFrame([], "ord bigint, score double"), k, ascending_ord=True)
        rows = self.rows.where(F.col("cell").isin(self.probed(q, probes)[0].tolist()))
        if where is not None:
            rows = rows.where(passes(where, F.col("meta")))
        metric = self.metric

        def work(it):
            for ids, v in _matrices(it, q.shape[1]):
                _, top, score = best(np.zeros(1, np.int64), q, ids, v, k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(score)], names=["ord", "score"])

        return ranked(rows.select("ord", "vector").mapInArrow(work, "ord long, score double"), k, ascending_ord=True)

    def search_batch(self, queries: DataFrame, k: int = 10, probes: int = 0) -> DataFrame:
        """(query_id, ord, score, rank): each query meets the vectors of its cells, in blocks (`vector.met`)."""
        centre, metric = self.centre, self.metric
        n = self._probes(probes)

        def probed(q: np.ndarray) -> np.ndarray:
            own = np.zeros((len(q), len(centre)), bool)
            np.put_along_axis(own, _nearest(q, centre, metric, n), True, 1)
            return own

        return met(queries, self.rows.select("ord", "vector", "cell"), k, metric, probed, centre.shape[1])
