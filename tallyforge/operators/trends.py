"""Equal time buckets over a span, dense over empty buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.aggs import ADDITIVE, hit_rate, merged_measures, usage_measures
from tallyforge.plans.ranges import Span, filter_range, span_of

# Models named in a stacked chart, and the label of the rest.
NAMED_MODELS = 4
OTHER = "__other__"

# Stacking order of the token series.
TOKEN_SERIES = ["output", "reasoning", "cache", "input"]


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def bucket_index(ts: Column, start: Column, end: Column, buckets: Column) -> Column:
    """Index by integer division; the inclusive end falls into the last bucket."""
    span = F.greatest(end - start, _long(1))
    slot = F.call_function("div", (ts - start) * buckets, span)
    return F.least(buckets - 1, slot).cast("bigint")


def bucket_edge(index: Column, start: Column, end: Column, buckets: Column) -> Column:
    span = F.greatest(end - start, _long(1))
    return (start + F.call_function("div", span * index, buckets)).cast("bigint")


def with_bucket(usage: DataFrame, span: Span) -> DataFrame:
    n = _long(max(span.buckets, 1))
    inside = filter_range(usage, span.from_ms, span.to_ms)
    return inside.withColumn("bucket_idx", bucket_index(F.col("ts_ms"), _long(span.from_ms), _long(span.to_ms), n))


def bucket_spine(usage: DataFrame, span: Span) -> DataFrame:
    n = max(span.buckets, 1)
    edge = [_long(span.from_ms), _long(span.to_ms), _long(n)]
    idx = F.col("id")
    return usage.sparkSession.range(n).select(
        idx.alias("bucket_idx"),
        bucket_edge(idx, *edge).alias("start_ms"),
        bucket_edge(idx + 1, *edge).alias("end_ms"),
    )


def _dense(spine: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    joined = spine.join(grouped, keys, "left")
    return joined.fillna(0, ADDITIVE).withColumn("hit_rate", hit_rate())


def bucketize(usage: DataFrame, span: Span) -> DataFrame:
    """One row per bucket, empty ones included."""
    grouped = with_bucket(usage, span).groupBy("bucket_idx").agg(*usage_measures())
    return _dense(bucket_spine(usage, span), grouped, ["bucket_idx"])


def bucketize_by_model(usage: DataFrame, span: Span) -> DataFrame:
    """Both levels at once: ``model`` is NULL on the bucket's own total row (always present).

    Usage rows are grouped once by bucket and model; totals are folded from those few groups.
    """
    groups = with_bucket(usage, span).groupBy("bucket_idx", "model").agg(*usage_measures())
    levels = groups.withColumn("level", F.explode(F.array(F.col("model"), F.lit(None).cast("string"))))
    both = levels.groupBy("bucket_idx", F.col("level").alias("model")).agg(*merged_measures())
    spine = bucket_spine(usage, span)
    return _dense(spine, both, ["bucket_idx"])


def trend(usage: DataFrame, range_key: str, now_ms: int, tz: str = "UTC", by_model: bool = False) -> DataFrame:
    """Buckets of a named range; no usage at all gives no buckets."""
    span = span_of(usage, range_key, now_ms, tz)
    out = (bucketize_by_model if by_model else bucketize)(usage, span)
    any_row = usage.select(F.lit(1).alias("any_row")).limit(1)
    return out.crossJoin(F.broadcast(any_row)).drop("any_row")


def trend_per_model(usage: DataFrame, span: Span, keys: list[str]) -> DataFrame:
    """A dense trend for every key that occurs anywhere in ``usage``."""
    grouped = with_bucket(usage, span).groupBy(*keys, "bucket_idx").agg(*usage_measures())
    spine = usage.select(*keys).distinct().crossJoin(F.broadcast(bucket_spine(usage, span)))
    return _dense(spine, grouped, [*keys, "bucket_idx"])


def top_models_trend(
    usage: DataFrame, span: Span, named: int = NAMED_MODELS, visible: list[str] | None = None
) -> DataFrame:
    """Totals per bucket for the largest models; everything else, hidden models too, is ``__other__``.

    Works on bucket x model groups only. Rows with no tokens are left out.
    """
    groups = with_bucket(usage, span).groupBy("bucket_idx", "model").agg(*usage_measures())
    groups = groups.select("bucket_idx", "model", "total")
    top = groups.groupBy("model").agg(F.sum("total").alias("model_total"))
    top = top.orderBy(F.desc("model_total"), "model").limit(named).select("model", F.lit(True).alias("top"))
    # At most ``named`` rows are broadcast.
    ranked = groups.join(F.broadcast(top), "model", "left").withColumn("shown", F.coalesce("top", F.lit(False)))
    if visible:
        ranked = ranked.withColumn("shown", F.col("shown") & F.col("model").isin(*visible))
    label = F.when(F.col("shown"), F.col("model")).otherwise(F.lit(OTHER))
    return (
        ranked.groupBy("bucket_idx", label.alias("series"))
        .agg(F.sum("total").cast("bigint").alias("total"))
        .where(F.col("total") > 0)
    )


def token_type_series(buckets: DataFrame) -> DataFrame:
    """Unpivot bucket rows into output, reasoning, cache and input series; zero values are dropped."""
    values = {
        "output": F.col("output"),
        "reasoning": F.col("reasoning_sum"),
        "cache": F.col("cache_read_sum") + F.col("cache_write_sum"),
        "input": F.col("input"),
    }
    wide = buckets.select("bucket_idx", *[values[name].alias(name) for name in TOKEN_SERIES])
    return wide.unpivot("bucket_idx", TOKEN_SERIES, "series", "tokens").where(F.col("tokens") > 0)
