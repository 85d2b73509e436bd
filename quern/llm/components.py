"""Connected components of an edge table, by local union and alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import map_arrow, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges, without the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    root = np.arange(nodes.size)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(nodes.size)
    return nodes[moved], nodes[root[moved]]


#: Edges that a worker unites at once.
_EDGES = 1 << 20


def _local(it):
    def united(batches):
        t = pa.Table.from_batches(batches)
        v, u = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])

    held, n = [], 0
    for batch in it:
        held.append(batch)
        n += batch.num_rows
        if n >= _EDGES:
            yield united(held)
            held, n = [], 0
    if held:
        yield united(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (first two columns, 64-bit); the component is its
    smallest node.

    Each partition first unites its own edges, part by part.  Then large and small stars alternate until nothing
    changes, a number of rounds that grows with the logarithm of the longest path; each round is written
    to the shared folder.
    """
    a, b = edges.columns[:2]
    e = materialize(map_arrow(edges.select(a, b).where(F.col(a) != F.col(b)), _local, "v long, u long").dropDuplicates(), "star")
    # v > u in every row; a sum of whole hashes tells tables apart
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        e = materialize(small.where("v != u").dropDuplicates(), "star")
        now = mark(e)
        if now == seen:
            break
        seen = now
    # stars: every node but the centre points at the centre
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).dropDuplicates())
