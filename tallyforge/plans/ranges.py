"""Named time ranges: spans, filters and membership masks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.times import local_day_start_ms

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# Length and bucket count of each range key; "today" and "all" have no fixed length.
RANGE_LENGTH_MS = {"60m": HOUR_MS, "24h": DAY_MS, "7d": 7 * DAY_MS, "30d": 30 * DAY_MS}
RANGE_BUCKETS = {"60m": 60, "today": 24, "24h": 24, "7d": 28, "30d": 30, "all": 90}
# Order in which the rolling ranges are listed.
ROLLING_RANGES = ["today", "60m", "24h", "7d", "30d", "all"]


class Span(NamedTuple):
    from_ms: int
    to_ms: int
    buckets: int


def known_range(range_key: str) -> str:
    """An unknown key means today."""
    return range_key if range_key in RANGE_BUCKETS else "today"


def resolve_span(range_key: str, now_ms: int, history_start_ms: int | None = None, tz: str = "UTC") -> Span:
    key = known_range(range_key)
    if key == "today":
        start = local_day_start_ms(now_ms, tz)
    elif key == "all":
        start = now_ms - 30 * DAY_MS if history_start_ms is None else history_start_ms
    else:
        start = now_ms - RANGE_LENGTH_MS[key]
    return Span(start, now_ms, RANGE_BUCKETS[key])


def span_of(usage: DataFrame, range_key: str, now_ms: int, tz: str = "UTC") -> Span:
    """Like ``resolve_span``; only ``all`` reads data, and only one scalar (the oldest timestamp)."""
    oldest = usage.agg(F.min("ts_ms")).first()[0] if known_range(range_key) == "all" else None
    return resolve_span(range_key, now_ms, oldest, tz)


def filter_range(usage: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Rows in the span, both ends included. A stored ``ts_date`` column prunes partitions too."""
    inside = usage.where(F.col("ts_ms").between(from_ms, to_ms))
    if "ts_date" in usage.columns:
        days = [F.date_from_unix_date(F.lit(ms // DAY_MS).cast("int")) for ms in (from_ms, to_ms)]
        inside = inside.where(F.col("ts_date").between(*days))
    return inside


def in_range(range_key: str, now_ms: int, tz: str = "UTC") -> Column:
    """Membership of a rolling range; ``all`` has no upper end, an unknown key has no members."""
    if range_key == "all":
        return F.lit(True)
    if range_key not in RANGE_BUCKETS:
        return F.lit(False)
    return F.col("ts_ms").between(resolve_span(range_key, now_ms, tz=tz).from_ms, now_ms)


def membership(predicates: list[Column]) -> Column:
    """Bit i is set where predicate i holds. Grouping by this splits rows into disjoint classes, so
    overlapping ranges are aggregated in one pass without multiplying rows."""
    mask = F.lit(0)
    for i, predicate in enumerate(predicates):
        mask = mask.bitwiseOR(F.when(predicate, F.lit(1 << i)).otherwise(F.lit(0)))
    return mask


def has_bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def explode_members(mask: Column, names: list[str]) -> Column:
    """One row per range the class belongs to (used on already aggregated classes)."""
    members = F.array(*[F.when(has_bit(mask, i), F.lit(name)) for i, name in enumerate(names)])
    return F.explode(F.array_compact(members))
