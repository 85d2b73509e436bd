"""Best-fit packing: pattern packing by non-negative least squares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import map_arrow, materialize, need, table
from quern.llm.token_counts import count_tokens

#: A bin holds so many tokens; lengths are counted in classes of STEP tokens, rounded up.
CAPACITY, STEP = 2048, 32
#: Documents are numbered within their class bucket by bucket; a bucket holds one document in so many, whatever their number.
BUCKET_ROWS = 50_000
SCHEMA = "doc_id long, piece int, start long, length int, bin long, slot int"


def patterns(classes: int) -> np.ndarray:
    """Multisets of classes 1..n that fill a bin of n steps exactly: up to two documents of any class and
    repeats of a third; a row for each, with counts by class."""
    out = set()
    for a in range(classes + 1):
        for b in range(a + 1):
            rest = classes - a - b
            if rest < 0:
                continue
            for c in [0] if rest == 0 else [c for c in range(1, rest + 1) if rest % c == 0]:
                row = [0] * (classes + 1)
                for x in (a, b):
                    row[x] += 1
                if c:
                    row[c] += rest // c
                out.add(tuple(row[1:]))
    return np.array(sorted(out), np.int64)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 30):
        grad = a.T @ (b - a @ x)
        grad[used] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            drop = at[(x[at] <= 1e-12) & bad]
            used[drop if drop.size else at[bad][:1]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(repeats, counts by class) of the bins that hold `histogram`: fitted patterns, then best fit.

    The repeats that least squares finds are rounded down and held to what is left of each class.  The
    rest is packed by best fit decreasing on class counts: the longest class left opens a bin, which takes
    the longest that still fits until none does, and such a bin is repeated as long as its classes last.
    """
    classes = histogram.size
    left, out = histogram.astype(np.int64).copy(), []
    rows = patterns(classes)
    scale = max(1.0, float(left.max(initial=0)))
    fit = nnls(rows.T.astype(float), left / scale) * scale
    for i in np.argsort(-fit, kind="stable"):
        need_of = rows[i] > 0
        n = int(min(np.floor(fit[i] + 1e-6), (left[need_of] // rows[i][need_of]).min()))
        if n > 0:
            out.append((n, rows[i]))
            left -= n * rows[i]
    while left.any():
        free, row = classes, np.zeros(classes, np.int64)
        while free:
            ok = np.flatnonzero(left[:free] - row[:free] > 0)
            if not ok.size:
                break
            c = int(ok[-1])
            row[c] += min(int(left[c] - row[c]), free // (c + 1))
            free = classes - int((row * np.arange(1, classes + 1)).sum())
        has = row > 0
        n = int((left[has] // row[has]).min())
        out.append((n, row))
        left -= n * row
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, step: int = STEP, text: str = "text", key: str = "doc_id", unit: str = "tokens") -> DataFrame:
    """A bin and slot for every document: (doc_id, piece, start, length, bin, slot), in tokens (`token_counts`) or words.

    A document longer than a bin is cut into pieces of `capacity` tokens and a rest, which are packed like
    documents; `start` is the piece's first token.  Lengths go into classes of `step` tokens.  The histogram
    of classes, counted over all documents, is fitted by patterns on the driver (its size is that of the
    classes, not of the corpus), which gives every class a list of runs of slots.  Documents are numbered
    within their class by bucket offsets and ranks inside hash buckets, so no task sees a whole class, and
    take the slots of their number.

    A text that is null or without tokens takes no room: its bin and slot are null.  Null keys and
    repeated rows are packed like others, each on its own; an empty table gives an empty result; other
    columns are ignored.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark, classes = docs.sparkSession, capacity // step
    own = need(docs, key, text).toDF("doc_id", "text")
    if unit == "tokens":
        sized = count_tokens(own).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"))
    else:
        words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
        sized = own.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(words).alias("n"))
    full = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / capacity).cast("int")
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), full)).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))
    cut = cut.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counted = pieces.groupBy("class").count().collect()  # one row for each class
    histogram = np.zeros(classes, np.int64)
    for c, n in counted:
        if c:
            histogram[c - 1] = n
    runs = _runs(plan(histogram), classes)
    buckets = max(1, int(sum(r[1] for r in counted)) // BUCKET_ROWS)
    bucketed = pieces.where("class > 0").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("class", "bucket").count()
    before = sizes.select("class", "bucket", (F.sum("count").over(Window.partitionBy("class").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("row")) - 1
    numbered = bucketed.withColumn("within", within).join(before, ["class", "bucket"]).withColumn("number", F.col("before") + F.col("within"))
    columns = ["doc_id", "piece", "start", "length", "class", "number"]

    def place(it):
        for batch in it:
            col = {n: batch.column(i) for i, n in enumerate(columns)}
            c, number = np.asarray(col["class"]), np.asarray(col["number"])
            out_bin, slot = np.zeros(c.size, np.int64), np.zeros(c.size, np.int32)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                first, base, each, offset = runs[k]
                i = np.searchsorted(first, number[at], side="right") - 1
                within = number[at] - first[i]
                out_bin[at], slot[at] = base[i] + within // each[i], offset[i] + within % each[i]
            yield pa.RecordBatch.from_arrays([col[n] for n in columns[:4]] + [pa.array(out_bin), pa.array(slot)], names=["doc_id", "piece", "start", "length", "bin", "slot"])

    placed = map_arrow(numbered.select(*columns), place, SCHEMA)
    none = pieces.where("class = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("slot"))
    return placed.unionByName(none)


def _runs(bins: list[tuple[int, np.ndarray]], classes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first number, first bin, documents in a bin and first slot of each run of equal bins."""
    runs = {c: ([], [], [], []) for c in range(1, classes + 1)}
    used, base = np.zeros(classes + 1, np.int64), 0
    for repeats, row in bins:
        offset = 0
        for c in np.flatnonzero(row)[::-1] + 1:
            for to, x in zip(runs[c], (used[c], base, row[c - 1], offset)):
                to.append(int(x))
            used[c] += repeats * row[c - 1]
            offset += int(row[c - 1])
        base += repeats
    return {c: tuple(np.array(x, np.int64) for x in r) for c, r in runs.items()}


def sequences(packed: DataFrame) -> DataFrame:
    """The bins of `pack` as sequences: (bin, length, parts array<struct<slot, doc_id, piece, start, length>>), in the
    order of slots.  A bin has no more parts than tokens; documents without any are in none."""
    part = F.struct("slot", "doc_id", "piece", "start", "length")
    return packed.where("bin is not null").groupBy("bin").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("parts"))


def op9_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pattern_packing": op9_pattern_packing}
ORACLE_SQL: dict[str, str] = {}
