"""Incremental indexing as streams of micro-batches over the batch functions, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(batch: DataFrame, *known: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key is in none of the known tables, each key once (its first row by all columns)."""
    rest = [c for c in batch.columns if c != key]
    once = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, "__r.*")
    for k in known:
        once = once.join(k.select(key).distinct(), key, "left_anti")
    return once.select(*batch.columns)


def add(primary: DataFrame, secondary: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The secondary table with a batch's new keys."""
    return secondary.unionByName(fresh(batch, secondary, primary, key=key))


def compact_due(n_primary: int, n_secondary: int, threshold: float = 0.05) -> bool:
    return n_secondary / max(n_primary, 1) > threshold


def compacted(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Both tables as one; the primary's rows win."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti"))


def start_incremental(stream: DataFrame, path: str, key: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """A query that appends each micro-batch's new keys to the Parquet table at ``path``."""
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        try:
            known = spark.read.schema(schema).parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        out = fresh(batch, known, key=key)
        out.write.mode("append").parquet(path)
        if on_batch:
            on_batch(out, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window and kind; the same function for a table and for a stream with a watermark."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = e.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, *, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """A user's events with gaps shorter than ``gap``."""
    out = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
