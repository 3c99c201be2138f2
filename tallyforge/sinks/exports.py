"""Export shapes and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import aggs
from tallyforge.operators.trends import trend

# Fixed value: shown where no cache field was reported.
NO_RATE = "unavailable"


def _rate_text() -> Column:
    text = F.format_string("%.4f", F.col("hit_rate"))
    return F.when(F.col("hit_rate").isNotNull(), text).otherwise(F.lit(NO_RATE)).alias("cacheHitRate")


def _tokens(with_write: bool = True) -> list[Column]:
    names = {
        "requests": "requests",
        "inputTokens": "input",
        "outputTokens": "output",
        "reasoningTokens": "reasoning_sum",
        "cacheReadTokens": "cache_read_sum",
        "cacheWriteTokens": "cache_write_sum",
        "totalTokens": "total",
    }
    if not with_write:
        del names["cacheWriteTokens"]
    return [F.col(col).alias(name) for name, col in names.items()]


def export_range(usage: DataFrame, range_key: str, now_ms: int, tz: str = "UTC") -> DataFrame:
    buckets = trend(usage, range_key, now_ms, tz)
    return buckets.select(
        F.col("start_ms").alias("bucketStart"), F.col("end_ms").alias("bucketEnd"), *_tokens(), _rate_text()
    ).orderBy("bucketStart")


def export_models(usage: DataFrame) -> DataFrame:
    models = aggs.usage_agg(usage, ["model"]).withColumn("hit_rate", aggs.hit_rate())
    return models.select(
        "model",
        *_tokens(),
        _rate_text(),
        F.col("first_ts_ms").alias("firstUsedMs"),
        F.col("last_ts_ms").alias("lastUsedMs"),
    ).orderBy(F.desc("totalTokens"), "model")


def export_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        F.col("id").alias("sessionId"),
        F.coalesce("project", F.lit("")).alias("project"),
        F.array_join("models", ", ").alias("models"),
        *_tokens(with_write=False),
        _rate_text(),
        F.col("first_ts_ms").alias("startMs"),
        F.col("last_ts_ms").alias("lastActivityMs"),
    ).orderBy(F.desc_nulls_last("lastActivityMs"), "sessionId")


def export_raw(usage: DataFrame) -> DataFrame:
    return usage.select(
        F.col("ts_ms").alias("timestampMs"),
        "model",
        F.coalesce("session_id", F.lit("")).alias("sessionId"),
        F.coalesce("project", F.lit("")).alias("project"),
        F.col("input_tokens").alias("inputTokens"),
        F.col("output_tokens").alias("outputTokens"),
        F.col("reasoning_tokens").alias("reasoningTokens"),
        F.col("cache_read_tokens").alias("cacheReadTokens"),
        F.col("cache_write_tokens").alias("cacheWriteTokens"),
        F.col("source_file").alias("sourceFile"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes only where needed, doubled quotes inside, NULL as the word null."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="null", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines; NULL fields are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_rollups(usage: DataFrame, sessions: DataFrame, today: DataFrame, path: str) -> None:
    """Small tables that answer the first screen before live data is read. ``today`` is the usage of
    today's span."""
    tables = {
        "today": aggs.usage_agg(today),
        "today_models": aggs.usage_agg(today, ["model"]),
        "all_models": aggs.usage_agg(usage, ["model"]),
        "sessions": sessions,
        "bounds": aggs.history_bounds(usage),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_rollup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Older snapshots may lack newer columns: they read as NULL, counters as 0."""
    df = spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
    present = [c for c in aggs.ADDITIVE if c in df.columns]
    for missing in (c for c in aggs.ADDITIVE if c not in df.columns and name != "bounds"):
        df = df.withColumn(missing, F.lit(0).cast("bigint"))
    return df.fillna(0, present)
