"""Incremental ingestion: what is new by a ledger, or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unseen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose path, size and time (to the second) are not in the ledger."""
    near = F.abs(files.modificationTime.cast("timestamp").cast("double") - ledger.mtime) < 1
    return files.join(ledger, (files.path == ledger.path) & (files.length == ledger.size) & near, "left_anti")


def remember(ledger: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """The ledger with these files' size, time and kind in place of what it had."""
    from levylens.operators.catalog import upsert

    new = files.select("path", F.lit(kind).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp").cast("double").alias("mtime"))
    return upsert(ledger.select("path", "kind", "size", "mtime"), new, ["path"])


def replace_slice(rows: DataFrame, path: str, partition: list[str]) -> None:
    """K2: writes rows over the partitions that they belong to, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append(rows: DataFrame, path: str, partition: list[str]) -> None:
    """K1, K8."""
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def stream_files(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.parquet") -> None:
    """Every new file once, then an end; a batch that fails is tried again by the next run."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals_by_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums by day and type, for batches and streams alike; rows later than `late` are left out of streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")
