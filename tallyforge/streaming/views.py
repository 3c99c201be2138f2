"""Live aggregates over a usage stream. Watermarks bound their state; the stored table has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions import caliber
from tallyforge.sources.transcripts import keep_last_snapshot
from tallyforge.streaming.ingest import USAGE_KEY, write_batch

LATENESS = "1 day"


def _timed(usage: DataFrame, lateness: str) -> DataFrame:
    """Event time with a watermark; a stream may have only one, so a deduplicated one keeps its own."""
    if "ts" in usage.columns:
        return usage
    return usage.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), F.sum(caliber.display_total()).alias("total")]


def _bounds(df: DataFrame) -> DataFrame:
    edges = [F.unix_millis(F.col(f"window.{e}")).alias(f"{e}_ms") for e in ("start", "end")]
    return df.select(*edges, *[c for c in df.columns if c != "window"])


def dedup_live(usage: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop re-deliveries inside the watermark; rows later than that are dropped too, so this is for live
    views only."""
    return _timed(usage, lateness).dropDuplicatesWithinWatermark(USAGE_KEY)


def live_model_trend(usage: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Requests and tokens per tumbling window and model."""
    return _bounds(_timed(usage, lateness).groupBy(F.window("ts", width), "model").agg(*_measures()))


def live_session_rate(
    usage: DataFrame, width: str = "5 minutes", slide: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Tokens per minute of each session over a trailing window."""
    rows = _timed(usage, lateness).where(F.col("session_id").isNotNull())
    grouped = rows.groupBy(F.window("ts", width, slide), "source", "session_id").agg(*_measures())
    minutes = (F.col("end_ms") - F.col("start_ms")) / F.lit(60_000.0)
    return _bounds(grouped).withColumn("tokens_per_min", F.col("total") / minutes)


def live_session_steps(usage: DataFrame, step: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Requests and tokens of each session per tumbling step: what ``rate_of_steps`` makes trailing windows of. The
    state holds each event once, not once for every window it is in."""
    rows = _timed(usage, lateness).where(F.col("session_id").isNotNull())
    return _bounds(rows.groupBy(F.window("ts", step), "source", "session_id").agg(*_measures()))


def rate_of_steps(steps: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Trailing windows that end with every step, from stored steps: what ``live_session_rate`` gives. ``width`` is a
    whole number of steps."""
    placed = steps.select(F.window(F.timestamp_millis("start_ms"), width, step).alias("window"), "source", "session_id", "requests", "total")
    grouped = placed.groupBy("window", "source", "session_id").agg(F.sum("requests").alias("requests"), F.sum("total").alias("total"))
    minutes = (F.col("end_ms") - F.col("start_ms")) / F.lit(60_000.0)
    return _bounds(grouped).withColumn("tokens_per_min", F.col("total") / minutes)


def start_view(view: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write the changed rows of every trigger as a new version (update mode)."""
    writer = view.writeStream.outputMode("update").foreachBatch(lambda df, i: write_batch(df, out, i))
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_view(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version of each row."""
    return keep_last_snapshot(spark.read.parquet(out), keys, "batch_id").drop("batch_id")
