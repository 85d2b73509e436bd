"""Streaming ingestion of a log: files of writes become part of a collection as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import kv


def stream_log(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Writes from Parquet files as they arrive; `max_files` a batch holds back what comes faster."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest(writes: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of writes (key, ord, tstamp, is_tombstone, ...) to a log.

    A batch that is run again overwrites its own part of the log, and the latest view goes by ord, so neither
    replays nor writes out of order change what is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("file_id", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return writes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.option("basePath", log_path).parquet(f"{log_path}/batch=*").drop("batch")


def latest_view(spark: SparkSession, log_path: str) -> DataFrame:
    return kv.latest(read_log(spark, log_path))
