"""Keyed records: latest view, snapshots, expiry, statistics and compaction of an append-only log.

A log has the columns key, ord (the write's number), tstamp (seconds) and is_tombstone, and any others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, snapshot: int | None = None, see_tombstones: bool = False) -> DataFrame:
    """The last write of each key, as of a snapshot; keys whose last write is a tombstone are left out.

    One aggregation with map-side combining, whatever the number of versions.
    """
    if snapshot is not None:
        log = log.where(F.col("ord") <= snapshot)
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), "ord").alias("r"))
    out = last.select("key", "r.*").select(*log.columns)
    return out if see_tombstones else out.where(~F.col("is_tombstone"))


def alive(now: int, expiry_secs: int, tstamp: Column | None = None) -> Column:
    """Whether a record has not expired; 0 seconds is never."""
    tstamp = F.col("tstamp") if tstamp is None else tstamp
    return F.lit(True) if not expiry_secs else tstamp + F.lit(expiry_secs) > F.lit(now)


def get(log: DataFrame, keys: list, now: int = 0, expiry_secs: int = 0) -> DataFrame:
    """Records of some keys; the keys reach the scan as a filter."""
    return latest(log.where(F.col("key").isin(keys))).where(alive(now, expiry_secs))


def key_length_histogram(log: DataFrame) -> DataFrame:
    """(key_length in bytes, n_keys) of live keys."""
    return latest(log).groupBy(F.octet_length(F.col("key").cast("string")).cast("bigint").alias("key_length")).agg(F.count("*").alias("n_keys"))


def status(log: DataFrame) -> DataFrame:
    """One row: live keys, writes, tombstones, last ord, dead_doc_rate."""
    live = latest(log).agg(F.count("*").alias("live_keys"))
    total = log.agg(F.count("*").alias("n_writes"), F.coalesce(F.sum(F.col("is_tombstone").cast("bigint")), F.lit(0)).alias("n_tombstones"), F.max("ord").alias("last_ord"))
    return total.crossJoin(live).withColumn("dead_doc_rate", F.when(F.col("n_writes") == 0, F.lit(0)).otherwise(F.expr("(n_writes - live_keys) * 100 div n_writes")))


def is_empty(log: DataFrame) -> bool:
    return latest(log).isEmpty()


def file_stats(log: DataFrame, size: Column) -> DataFrame:
    """Per file_id: keys and bytes, in all and live, dead bytes, fragmentation in percent, oldest and newest time."""
    sized = log.withColumn("_size", size.cast("bigint"))
    last = sized.groupBy("key").agg(F.max("ord").alias("ord")).select("key", "ord", F.lit(True).alias("_last"))
    marked = sized.join(last, ["key", "ord"], "left").withColumn("_live", F.coalesce("_last", F.lit(False)) & ~F.col("is_tombstone"))
    live = F.col("_live")
    out = marked.groupBy("file_id").agg(
        F.count("*").alias("total_keys"), F.sum(live.cast("bigint")).alias("live_keys"), F.sum("_size").alias("total_bytes"), F.sum(F.when(live, F.col("_size")).otherwise(0)).alias("live_bytes"), F.min("tstamp").alias("oldest"), F.max("tstamp").alias("newest"),
    )
    return out.withColumns({"dead_bytes": F.col("total_bytes") - F.col("live_bytes"), "fragmented": F.expr("100 - live_keys * 100 div total_keys")})


@dataclass(frozen=True)
class Policy:
    """When to merge and which files; 0 turns a rule off."""

    frag_merge_trigger: int = 60
    dead_bytes_merge_trigger: int = 512 << 20
    deletion_rate_trigger: int = 0
    frag_threshold: int = 40
    dead_bytes_threshold: int = 128 << 20
    small_file_threshold: int = 10 << 20
    expiry_secs: int = 0
    expiry_grace_time: int = 0
    max_merge_size: int = 0


def merge_candidates(stats: DataFrame, policy: Policy, now: int = 0, dead_doc_rate: int = 0) -> DataFrame:
    """Files to merge, with reasons, and `expired`; none unless some file, or the deletion rate, asks for a merge."""
    p = policy
    cut = max(0, now - p.expiry_secs) if p.expiry_secs and now else 0
    trigger_cut = max(0, now - p.expiry_secs - p.expiry_grace_time) if p.expiry_secs and now else 0
    old = (F.col("newest") < trigger_cut) & (F.col("oldest") > 0) if trigger_cut else F.lit(False)
    asks = (F.col("fragmented") >= p.frag_merge_trigger) | (F.col("dead_bytes") >= p.dead_bytes_merge_trigger) | old
    by_rate = bool(p.deletion_rate_trigger and dead_doc_rate >= p.deletion_rate_trigger)
    expired = F.col("newest") < cut if cut else F.lit(False)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("fragmented") >= p.frag_threshold, "fragmented"), F.when(F.col("dead_bytes") >= p.dead_bytes_threshold, "dead_bytes"),
            F.when((F.col("total_bytes") < p.small_file_threshold) & F.lit(p.small_file_threshold > 0), "small_file"), F.when(expired, "expired"),
        )
    )
    anyone = stats.agg(F.coalesce(F.max(asks.cast("int")), F.lit(0)).alias("_any"), F.coalesce(F.max((F.size(reasons) > 0).cast("int")), F.lit(0)).alias("_some"))
    marked = stats.withColumns({"reasons": reasons, "expired": expired}).crossJoin(anyone)
    chosen = ((F.col("_any") == 1) | F.lit(by_rate)) & ((F.size("reasons") > 0) | (F.lit(by_rate) & (F.col("_some") == 0)))
    return marked.where(chosen).drop("_any", "_some")


def needs_merge(stats: DataFrame, policy: Policy, now: int = 0, dead_doc_rate: int = 0) -> bool:
    return not merge_candidates(stats, policy, now, dead_doc_rate).isEmpty()


def cap_size(files: DataFrame, max_merge_size: int, size: str = "total_bytes", order: str = "file_id") -> DataFrame:
    """The first files whose sizes add up to no more than the cap; the one that would exceed it ends the list.

    The list is of files, not of records; it is ordered as a whole.
    """
    if not max_merge_size:
        return files
    so_far = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("_sum", so_far).where(F.col("_sum") <= max_merge_size).drop("_sum")


def merge(log: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The log without superseded records and tombstones, in these files or in all; ord and tstamp stay."""
    last = log.groupBy("key").agg(F.max("ord").alias("ord"))
    chosen = log if files is None else log.join(files.select("file_id"), "file_id", "left_semi")
    kept = chosen.where(~F.col("is_tombstone")).join(last, ["key", "ord"], "left_semi").select(*log.columns)
    return kept if files is None else kept.unionByName(log.join(files.select("file_id"), "file_id", "left_anti").select(*log.columns))
