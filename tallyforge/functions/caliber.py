"""Counting rules for one usage row, as Column expressions over the usage schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.variant import MAX_COUNT


def zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def added(first: Column, *more: Column) -> Column:
    """Sum of counts that stops at the largest bigint instead of failing the query. No argument is NULL where
    the result is used."""
    for col in more:
        first = F.coalesce(F.try_add(first, col), F.lit(MAX_COUNT).cast("bigint"))
    return first


def is_completed() -> Column:
    """Unknown status counts as completed."""
    return F.coalesce(F.col("status"), F.lit("completed")) == "completed"


def _looks_exclusive() -> Column:
    """Judge by the numbers: an input that could hold its cache tokens is taken to hold them."""
    cached = added(F.col("cache_read_tokens"), zero_if_null("cache_write_tokens"))
    return ~((F.col("input_tokens") >= cached) & (F.col("input_tokens") > 0))


def input_is_exclusive() -> Column:
    """Does ``input_tokens`` leave the cache tokens out? A declared schema beats the numbers."""
    by_numbers = F.when(F.col("cache_read_tokens").isNotNull(), _looks_exclusive()).otherwise(F.lit(False))
    return F.coalesce(F.col("schema_exclusive"), by_numbers)


def display_total() -> Column:
    """Total tokens of a row without counting nested cache or reasoning tokens twice."""
    cached = added(F.col("cache_read_tokens"), zero_if_null("cache_write_tokens"))
    cache_extra = (
        F.when(F.col("cache_read_tokens").isNull(), zero_if_null("cache_write_tokens"))
        .when(input_is_exclusive(), cached)
        .otherwise(F.lit(0))
    )
    reasoning_extra = F.when(F.col("reasoning_in_output"), F.lit(0)).otherwise(zero_if_null("reasoning_tokens"))
    rebuilt = added(F.col("input_tokens"), F.col("output_tokens"), cache_extra, reasoning_extra)
    return F.coalesce(F.col("total_override"), rebuilt).cast("bigint")


def generated_tokens() -> Column:
    """Output side of a row: output plus reasoning unless reasoning is already inside output."""
    apart = F.when(F.col("reasoning_in_output"), F.lit(0).cast("bigint")).otherwise(zero_if_null("reasoning_tokens"))
    return added(F.col("output_tokens"), apart)


def approximate_window() -> Column:
    """True where only a derived whole-request duration is known, so speed is an approximation."""
    return (
        (generated_tokens() > 0)
        & F.col("duration_ms").isNotNull()
        & F.col("ttft_ms").isNull()
        & F.col("duration_derived")
    )


def generation_ms() -> Column:
    """Milliseconds spent generating, or NULL when the row is no speed sample."""
    known = F.when(F.col("duration_ms") > F.col("ttft_ms"), F.col("duration_ms") - F.col("ttft_ms")).when(
        approximate_window(), F.col("duration_ms")
    )
    return F.when((generated_tokens() > 0) & (known > 0), known)


def ttft_sample() -> Column:
    """Time to first token, or NULL when absent or longer than the request itself."""
    plausible = F.col("duration_ms").isNull() | (F.col("duration_ms") >= F.col("ttft_ms"))
    return F.when(F.col("ttft_ms").isNotNull() & plausible, F.col("ttft_ms"))


def hit_denominator() -> Column:
    """Input side of a row for the cache-hit rate; NULL when the row does not report cache reads."""
    read = F.col("cache_read_tokens")
    whole = added(F.col("input_tokens"), read, zero_if_null("cache_write_tokens"))
    return F.when(
        read.isNotNull(),
        F.when(input_is_exclusive(), whole).otherwise(F.greatest(F.col("input_tokens"), read)),
    )


def raw_sum_tokens() -> Column:
    """Plain sum of the five counters, whatever the schema nests."""
    parts = ("reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
    return added(F.col("input_tokens"), F.col("output_tokens"), *map(zero_if_null, parts))


def billable_input(schema_hint: str | None) -> Column:
    """Input tokens billed at the full input price under a price entry's schema hint.

    The row's own ``schema_exclusive`` plays no part here; without a hint the numbers decide.
    """
    read = zero_if_null("cache_read_tokens")
    write = zero_if_null("cache_write_tokens")
    less_read = F.greatest(F.col("input_tokens") - read, F.lit(0))
    if schema_hint == "exclusive":
        return F.col("input_tokens")
    if schema_hint == "inclusive":
        return less_read
    holds_cache = (F.col("input_tokens") >= read + write) & (F.col("input_tokens") > 0)
    return F.when(holds_cache, less_read).otherwise(F.col("input_tokens"))
