"""The time rollup against direct answers."""

import random

import pytest

from tallyforge.operators import aggs, cells, trends
from tallyforge.plans.ranges import MINUTE_MS, Span, filter_range
from tallyforge.schema import with_ts_date

T0 = 1_700_000_000_000


def test_cover_is_exact_and_short():
    rng = random.Random(1)
    for _ in range(2000):
        first = rng.randrange(-5000, 5000)
        last = first + rng.choice([0, 1, 2, 7, 300, 1 << 20, 1 << 24]) + rng.randrange(4)
        spans = cells.cover(first, last)
        minutes = sorted((a << 2 * level, b << 2 * level) for level, a, b in spans)
        assert sum(b - a for a, b in minutes) == last - first
        assert all(x[1] == y[0] for x, y in zip(minutes, minutes[1:])) and (not minutes or minutes[0][0] == first)
        assert all(b - a <= 6 for level, a, b in spans if level < cells.LEVELS - 1)
        assert len({level for level, _, _ in spans}) * 2 >= len(spans)


@pytest.fixture
def usage(usage_of):
    rng = random.Random(2)
    rows = [
        dict(ts_ms=T0 + int(rng.expovariate(1 / 40) * 7_200_000) + rng.randrange(3) * MINUTE_MS, model="abc"[i % 3], source=["x", "y"][i % 2], input_tokens=rng.randrange(100),
             cache_read_tokens=rng.choice([None, 5]), event_key=str(i))
        for i in range(600)
    ] + [dict(ts_ms=t, output_tokens=1) for t in (-1, 0, T0, T0 - 1, T0 + 60_000, T0 + 59_999, -61_000)]
    return with_ts_date(usage_of(*rows)).cache()


def rows_of(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ranges_equal_direct_aggregates(spark, usage, tmp_path):
    cells.write_cells(cells.usage_cells(usage), str(tmp_path / "cells"))
    stored = cells.read_cells(spark, str(tmp_path / "cells"))
    rng = random.Random(3)
    spans = [(T0, T0), (T0, T0 - 1), (-100_000, 5), (0, 1 << 42), (T0 + 1, T0 + 59_998), (T0 - T0 % 60_000, T0 - T0 % 60_000 + 59_999)]
    spans += [(a, a + rng.choice([10, 70_000, 10_000_000, 400_000_000])) for a in (T0 + rng.randrange(600_000_000) for _ in range(6))]
    columns = ["source", "model", *aggs.ADDITIVE, "first_ts_ms", "last_ts_ms"]
    for a, b in spans:
        want = aggs.usage_agg(filter_range(usage, a, b), ["source", "model"])
        assert rows_of(cells.range_from_cells(stored, usage, a, b), columns) == rows_of(want, columns), (a, b)


@pytest.mark.parametrize("buckets", [1, 7, 30])
def test_trends_equal_direct_buckets(usage, buckets):
    stored = cells.usage_cells(usage).cache()
    for a, b in ((T0 - 5, T0 + 300_000_000), (T0, T0 + 7 * 60_000), (T0, T0), (T0 - 86_400_000, T0 + 1_000_000_007)):
        span = Span(a, b, buckets)
        columns = ["bucket_idx", "start_ms", "end_ms", *aggs.ADDITIVE]
        assert rows_of(cells.trend_from_cells(stored, usage, span), columns) == rows_of(trends.bucketize(usage, span), columns)
        assert rows_of(cells.trend_from_cells(stored, usage, span, finest=3), columns) == rows_of(trends.bucketize(usage, span), columns)
        keyed = [(*r[:3], r[3] or "", *r[4:]) for r in rows_of_unsorted(trends.bucketize_by_model(usage, span), ["bucket_idx", "start_ms", "end_ms", "model", *aggs.ADDITIVE])]
        got = [(*r[:3], r[3] or "", *r[4:]) for r in rows_of_unsorted(cells.trend_from_cells(stored, usage, span, by_model=True), ["bucket_idx", "start_ms", "end_ms", "model", *aggs.ADDITIVE])]
        assert sorted(got) == sorted(keyed)


def rows_of_unsorted(df, columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_cells_of_batches_add_up(usage):
    halves = [cells.usage_cells(usage.where(f"event_key % 2 = {i}")) for i in range(2)]
    rest = cells.usage_cells(usage.where("event_key is null or event_key not rlike '^[0-9]+$'"))
    columns = ["level", "cell", "source", "model", *aggs.ADDITIVE]
    merged = cells.merged_cells(*halves, rest)
    assert rows_of(merged, columns) == rows_of(cells.usage_cells(usage), columns)


def test_few_usage_rows_are_read(usage):
    """Of a range only its two cut minutes are read from usage."""
    read = cells._usage_between(usage, [(T0, T0 + 30_000), (T0 + 400_000_000, T0 + 400_020_000)])
    assert read.count() == usage.where(f"ts_ms between {T0} and {T0 + 29_999} or ts_ms between {T0 + 400_000_000} and {T0 + 400_019_999}").count() < 20
