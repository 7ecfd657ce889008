"""File streams: sources, windows, enrichment and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, snapshots


def stream_source(spark: SparkSession, path: str, schema, max_files: int = 100, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def stream_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fmt: str = "parquet"):
    """Append to files; ``trigger`` is {'availableNow': True} or {'processingTime': '1 minute'}."""
    return df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def tumbling(df: DataFrame, ts: str, width: str, delay: str | None, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per window and key; in append mode a window comes out once the watermark has passed it, later rows are dropped.  The same function serves batch tables."""
    if delay and df.isStreaming:
        df = df.withWatermark(ts, delay)
    x = df.groupBy(F.window(ts, width), *keys).agg(*aggs)
    return x.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(c for c in x.columns if c not in ("window", *keys)))


def enrich(stream: DataFrame, static: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return stream.join(static, key, how)


def stream_upsert(df: DataFrame, root: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Upsert each micro-batch into a table of buckets, saved at the time it is applied; a batch rewrites the buckets of its keys.

    A batch that comes again is recognised by its number and skipped; a row that comes later but
    is older, by ``order``, than what the table has of its key changes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        started = bool(incremental.versions(spark, root))
        if started and snapshots.manifest(spark, root).batch >= number:
            return
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in batch.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        if not started:
            snapshots.create(last, root, keys, buckets, f"BATCH {number}", batch=number)
            return

        def newer(current: DataFrame, rows: DataFrame) -> DataFrame:
            before = current.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(order).alias("_before"))
            late = rows.join(before, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
            return incremental.upsert(current, late.where(F.col("_before").isNull() | (F.col(order) >= F.col("_before"))).select(*rows.columns), keys)

        snapshots.change(spark, root, last, newer, f"BATCH {number}", number=number)

    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
