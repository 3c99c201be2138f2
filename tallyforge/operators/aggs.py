"""Token aggregates over usage rows."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import caliber

# Additive columns of an aggregate row, in output order.
ADDITIVE = [
    "requests",
    "input",
    "output",
    "reasoning_sum",
    "reasoning_present",
    "cache_read_sum",
    "cache_read_present",
    "cache_write_sum",
    "cache_write_present",
    "total",
    "hit_input_total",
]


_made: dict[tuple, list[Column]] = {}


def _once(name: str, make) -> list[Column]:
    """Columns that every report uses, made once per JVM: making one takes as long as planning it."""
    key = (name, id(SparkContext._jvm))
    if key not in _made:
        _made[key] = make()
    return list(_made[key])


def _sum(col: Column, name: str) -> Column:
    """Sum with NULL as 0 that stops at the largest bigint instead of failing the query."""
    total = F.try_sum(F.coalesce(col, F.lit(0).cast("bigint")))
    most = F.lit(caliber.MAX_COUNT).cast("bigint")
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(total, most)).otherwise(F.lit(0).cast("bigint")).alias(name)


def usage_measures() -> list[Column]:
    """Aggregates over usage rows. Failed requests count. All are fixed-width, so hash aggregation
    combines them on the map side whatever the skew of the key."""
    return _once("usage", _usage_measures)


def _usage_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        _sum(F.col("input_tokens"), "input"),
        _sum(F.col("output_tokens"), "output"),
        _sum(F.col("reasoning_tokens"), "reasoning_sum"),
        F.count("reasoning_tokens").alias("reasoning_present"),
        _sum(F.col("cache_read_tokens"), "cache_read_sum"),
        F.count("cache_read_tokens").alias("cache_read_present"),
        _sum(F.col("cache_write_tokens"), "cache_write_sum"),
        F.count("cache_write_tokens").alias("cache_write_present"),
        _sum(caliber.display_total(), "total"),
        _sum(caliber.hit_denominator(), "hit_input_total"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    ]


def merged_measures(where: Column | None = None, suffix: str = "") -> list[Column]:
    """Combine aggregate rows into coarser ones, optionally only those meeting a condition."""
    if where is None:
        return _once(f"merged{suffix}", lambda: _merged_measures(None, suffix))
    return _merged_measures(where, suffix)


def _merged_measures(where: Column | None, suffix: str) -> list[Column]:
    def pick(name: str) -> Column:
        return F.col(name) if where is None else F.when(where, F.col(name))

    return [_sum(pick(name), name + suffix) for name in ADDITIVE] + [
        F.min(pick("first_ts_ms")).alias("first_ts_ms" + suffix),
        F.max(pick("last_ts_ms")).alias("last_ts_ms" + suffix),
    ]


def hit_rate(suffix: str = "") -> Column:
    """Cached share of the input side; NULL when nothing reported cache reads."""
    return F.try_divide(F.col("cache_read_sum" + suffix), F.col("hit_input_total" + suffix)).alias(
        "hit_rate" + suffix
    )


def coverage(field: str) -> Column:
    """Share of requests that report an optional field; 0 without requests."""
    return F.coalesce(F.try_divide(F.col(f"{field}_present"), F.col("requests")), F.lit(0.0)).alias(
        f"{field}_coverage"
    )


def token_mix() -> list[Column]:
    """Shares of input, output and reasoning in their sum."""
    parts = {"input": F.col("input"), "output": F.col("output"), "reasoning": F.col("reasoning_sum")}
    whole = F.greatest(F.col("input") + F.col("output") + F.col("reasoning_sum"), F.lit(1))
    return [(col / whole).alias(f"{name}_ratio") for name, col in parts.items()]


def usage_agg(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return usage.groupBy(*(keys or [])).agg(*usage_measures())


def cache_hit_rate(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    grouped = usage_agg(usage, keys)
    return grouped.select(*keys, F.col("cache_read_sum").alias("hit_cached"), "hit_input_total", hit_rate())


def group_by_model(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Aggregates per raw model name, largest total first."""
    keys = [*(keys or []), "model"]
    return usage_agg(usage, keys).orderBy(F.desc("total"), *keys)


def with_share(models: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of the grand total (within ``keys``). The window runs over finished report rows, one per
    model, never over usage rows."""
    grand = F.sum("total").over(Window.partitionBy(*(keys or [])))
    return models.withColumn("share", F.coalesce(F.try_divide(F.col("total"), grand), F.lit(0.0)))


def history_bounds(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return usage.groupBy(*(keys or [])).agg(
        F.min("ts_ms").alias("first_ts_ms"),
        F.count(F.lit(1)).alias("record_count"),
        F.max("ts_ms").alias("last_ts_ms"),
    )


def distinct_models(usage: DataFrame) -> DataFrame:
    return usage.select("model").distinct().orderBy("model")


def by_model(usage: DataFrame, model: str) -> DataFrame:
    """Exact, case-sensitive match."""
    return usage.where(F.col("model") == model)


def by_session(usage: DataFrame, session_id: str) -> DataFrame:
    return usage.where(F.col("session_id") == session_id)


def enabled_sources(usage: DataFrame, sources: list[str]) -> DataFrame:
    return usage.where(F.col("source").isin(*sources))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union; the same model from two sources stays two rows."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
