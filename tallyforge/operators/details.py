"""Composed reports: rolling ranges, model rows, model detail, overview card and usage view."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.times import local_day_start_ms
from tallyforge.operators import aggs, pricing, speed, trends
from tallyforge.operators.sessions import active_session_card
from tallyforge.plans.ranges import (
    DAY_MS,
    ROLLING_RANGES,
    Span,
    explode_members,
    filter_range,
    has_bit,
    in_range,
    known_range,
    membership,
    span_of,
)
from tallyforge.plans.staging import literal_rows

_ROLLUP = ["requests", "input", "cache_read_sum", "cache_write_sum", "output", "reasoning_sum", "total"]


def range_rollup(usage: DataFrame, now_ms: int, tz: str = "UTC", file_meta: DataFrame | None = None) -> DataFrame:
    """Six rolling ranges per source: totals (``model`` NULL, always present) and rows per model.

    ``sessions`` counts files with a row in the range; for ``all`` it also counts files known only from
    ``file_meta`` (source, source_file, session_id) that have an id.
    """
    mask = membership([in_range(key, now_ms, tz) for key in ROLLING_RANGES])
    rows = usage.withColumn("mask", mask)
    classes = rows.groupBy("source", "model", "mask").agg(*aggs.usage_measures()).select("source", "model", "mask", *_ROLLUP)
    level = F.explode(F.array(F.col("model"), F.lit(None).cast("string")))
    models = (
        classes.withColumn("range_key", explode_members(F.col("mask"), ROLLING_RANGES))
        .select("source", "range_key", level.alias("model"), *_ROLLUP)
        .groupBy("source", "range_key", "model")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in _ROLLUP])
    )
    files = rows.groupBy("source", "source_file").agg(F.bit_or("mask").alias("mask"))
    if file_meta is not None:
        known = file_meta.where(F.col("session_id") != "").select(
            "source", "source_file", F.lit(1 << ROLLING_RANGES.index("all")).alias("mask")
        )
        files = files.unionByName(known).groupBy("source", "source_file").agg(F.bit_or("mask").alias("mask"))
    counts = files.groupBy("source").agg(
        *[F.count_if(has_bit(F.col("mask"), i)).alias(key) for i, key in enumerate(ROLLING_RANGES)]
    )
    sessions = counts.unpivot("source", ROLLING_RANGES, "range_key", "sessions")
    totals = sessions.join(models.where("model IS NULL").drop("model"), ["source", "range_key"], "left").fillna(0, _ROLLUP)
    per_model = models.where("model IS NOT NULL").withColumn("sessions", F.lit(None).cast("bigint"))
    return totals.withColumn("model", F.lit(None).cast("string")).unionByName(per_model)


def range_totals(usage: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Aggregates of the six named spans (each ends now, both ends included); empty spans have zero rows."""
    spans = {key: span_of(usage, key, now_ms, tz) for key in ROLLING_RANGES}
    mask = membership([F.col("ts_ms").between(s.from_ms, s.to_ms) for s in spans.values()])
    classes = usage.withColumn("mask", mask).groupBy("mask").agg(*aggs.usage_measures())
    present = classes.withColumn("range_key", explode_members(F.col("mask"), ROLLING_RANGES)).drop("mask")
    spine = literal_rows(usage.sparkSession, [{"range_key": key, **s._asdict()} for key, s in spans.items()])
    spine = spine.withColumns({c: F.col(c).cast("bigint") for c in Span._fields})
    keys = ["range_key", "from_ms", "to_ms", "buckets"]
    return (
        spine.join(present, "range_key", "left")
        .groupBy(*keys)
        .agg(*aggs.merged_measures())
        .withColumn("hit_rate", aggs.hit_rate())
    )


def model_rows(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Aggregates per model with share of the total and speed figures; no samples leave them empty."""
    keys = [*(keys or []), "model"]
    models = aggs.with_share(aggs.usage_agg(usage, keys), keys[:-1])
    fast = speed.speed_stats(usage, keys)
    counted = ["ttft_samples", "speed_samples", "completed_requests", "generated_tokens", "generation_ms"]
    joined = models.join(fast, keys, "left").fillna(0, counted).fillna(False, ["speed_approximate"])
    return joined.withColumn("hit_rate", aggs.hit_rate()).orderBy(F.desc("total"), *keys)


def model_rows_with_cost(usage: DataFrame, prices: DataFrame, usd_cny: float) -> DataFrame:
    """Model rows of all sources with their cost; the same model in two sources stays two rows."""
    costs = pricing.cost_by_model(usage, prices, usd_cny, ["source"]).select("source", "model", "cost_cny", "priced")
    models = aggs.with_share(aggs.usage_agg(usage, ["source", "model"]))
    return models.join(costs, ["source", "model"], "left").orderBy(F.desc("total"), "source", "model")


def model_detail(usage: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """One row per source and model: aggregates of today, 7 days, 30 days and all time (unbounded above).

    Usage rows are folded once per window class; the windows are summed from the classes.
    """
    windows = {
        "today": F.col("ts_ms").between(local_day_start_ms(now_ms, tz), now_ms),
        "7d": F.col("ts_ms").between(now_ms - 7 * DAY_MS, now_ms),
        "30d": F.col("ts_ms").between(now_ms - 30 * DAY_MS, now_ms),
    }
    rows = usage.withColumn("mask", membership(list(windows.values())))
    classes = rows.groupBy("source", "model", "mask").agg(*aggs.usage_measures())
    folded = [m for i, name in enumerate(windows) for m in aggs.merged_measures(has_bit(F.col("mask"), i), f"_{name}")]
    detail = classes.groupBy("source", "model").agg(*folded, *aggs.merged_measures())
    return detail.select(
        "*",
        aggs.hit_rate(),
        (F.col("total") / F.col("requests")).alias("avg_tokens_per_request"),
        F.col("last_ts_ms").alias("last_used_ms"),
    )


def overview_card(usage: DataFrame, prices: DataFrame, usd_cny: float, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Today in one row: tokens, cost, hit rate, requests and models by size."""
    span = span_of(usage, "today", now_ms, tz)
    today = filter_range(usage, span.from_ms, span.to_ms)
    models = pricing.priced_models(today, prices, usd_cny)
    whole = models.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total_tokens", "requests")],
        F.sum("cache_read_sum").alias("cache_read_sum"),
        F.sum("hit_input_total").alias("hit_input_total"),
        F.coalesce(F.sum("cost_cny"), F.lit(0.0)).alias("total_cost_cny"),
        F.coalesce(F.bool_and("priced"), F.lit(True)).alias("fully_priced"),
        F.sort_array(F.collect_list(F.struct("total_tokens", "model")), asc=False).alias("by_size"),
    )
    return whole.select(
        F.col("total_tokens").alias("today_tokens"),
        "requests",
        aggs.hit_rate(),
        "total_cost_cny",
        "fully_priced",
        F.transform("by_size", lambda m: m["model"]).alias("models"),
    )


class UsageView(NamedTuple):
    range_key: str
    from_ms: int
    to_ms: int
    totals: DataFrame
    models: DataFrame
    speed: DataFrame
    speed_windows: DataFrame
    active: DataFrame
    trend: DataFrame | None
    cost: DataFrame
    cost_models: DataFrame
    revision: DataFrame


def usage_view(
    usage: DataFrame,
    prices: DataFrame,
    usd_cny: float,
    range_key: str,
    now_ms: int,
    tz: str = "UTC",
    include_trend: bool = True,
) -> UsageView:
    """Everything a dashboard shows, over one span. ``revision`` counts the rows it was built from."""
    span = span_of(usage, range_key, now_ms, tz)
    rows = filter_range(usage, span.from_ms, span.to_ms)
    return UsageView(
        range_key=known_range(range_key),
        from_ms=span.from_ms,
        to_ms=span.to_ms,
        totals=aggs.usage_agg(rows).withColumn("hit_rate", aggs.hit_rate()),
        models=model_rows(rows),
        speed=speed.speed_stats(rows),
        speed_windows=speed.speed_windows(usage, now_ms),
        active=active_session_card(usage, now_ms),
        trend=trends.bucketize_by_model(rows, span) if include_trend else None,
        cost=pricing.cost_summary(rows, prices, usd_cny),
        cost_models=pricing.cost_by_model(rows, prices, usd_cny),
        revision=rows.groupBy("source").agg(F.count(F.lit(1)).alias("revision")),
    )


def active_with_speed(usage: DataFrame, now_ms: int) -> DataFrame:
    """The active sessions with the speed of their latest model."""
    fast = speed.speed_totals(usage, ["source", "model"]).select(
        "source", F.col("model").alias("active_model"), "speed_tps", "speed_samples"
    )
    return active_session_card(usage, now_ms).join(fast, ["source", "active_model"], "left")
