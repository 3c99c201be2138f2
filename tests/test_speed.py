"""Speed figures by hand, and exact order statistics against brute force."""

import math
import random
import statistics

from pyspark.sql import functions as F

from tallyforge.operators import speed


def stats(usage):
    return speed.speed_stats(usage).first().asDict()


def test_weighted_speed_differs_from_mean(usage_of):
    got = stats(usage_of(
        dict(output_tokens=100, duration_ms=1_100, ttft_ms=100),
        dict(output_tokens=900, duration_ms=3_200, ttft_ms=200),
    ))
    assert got["speed_tps"] == 1000 * 1000 / 4000
    assert got["speed_p50_tps"] == (100.0 + 300.0) / 2
    assert (got["ttft_avg_ms"], got["ttft_p50_ms"], got["ttft_p95_ms"]) == (150.0, 100.0, 200.0)
    assert not got["speed_approximate"]


def test_exclusions(usage_of):
    got = stats(usage_of(
        dict(output_tokens=5, duration_ms=100, ttft_ms=10, status="error"),
        dict(output_tokens=5, duration_ms=100),  # recorded duration, no first-token time
        dict(output_tokens=5, duration_ms=100, ttft_ms=100),  # no window left; the first-token time still counts
        dict(output_tokens=5, duration_ms=100, ttft_ms=200),  # impossible first-token time
        dict(output_tokens=0, duration_ms=100, ttft_ms=10),
        dict(output_tokens=5, ttft_ms=50),
    ))
    assert got["completed_requests"] == 5
    assert got["ttft_samples"] == 3
    assert got["speed_samples"] == 0 and got["speed_tps"] is None and got["speed_p50_tps"] is None


def test_derived_durations_are_approximate(usage_of):
    got = stats(usage_of(
        dict(output_tokens=150, duration_ms=6_900, duration_derived=True),
        dict(output_tokens=0, reasoning_tokens=50, duration_ms=2_500, duration_derived=True),
    ))
    assert got["speed_approximate"] and got["generation_ms"] == 9_400 and got["generated_tokens"] == 200


def test_zero_window_marks_approximate_without_a_sample(usage_of):
    got = stats(usage_of(dict(output_tokens=5, duration_ms=0, duration_derived=True)))
    assert got["speed_approximate"] and got["speed_samples"] == 0


def test_no_rows(usage_of):
    got = stats(usage_of())
    assert got["completed_requests"] == 0 and got["ttft_p50_ms"] is None


def _rows(n, seed=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ttft = rng.choice([0, 1, 2, rng.randrange(5_000), int(10 ** rng.uniform(0, 6))])
        rows.append(dict(
            model="hot" if rng.random() < 0.6 else rng.choice("ab"), output_tokens=rng.randrange(3_000),
            duration_ms=ttft + rng.randrange(60_000), ttft_ms=ttft,
        ))
    return rows


def _check(usage_of, rows):
    got = {r.model: r.asDict() for r in speed.speed_by_model(usage_of(*rows)).collect()}
    for model in {r["model"] for r in rows}:
        mine = [r for r in rows if r["model"] == model]
        ttfts = sorted(r["ttft_ms"] for r in mine)
        tps = [r["output_tokens"] * 1000.0 / (r["duration_ms"] - r["ttft_ms"])
               for r in mine if r["output_tokens"] and r["duration_ms"] > r["ttft_ms"]]
        assert got[model]["ttft_p50_ms"] == ttfts[math.ceil(len(ttfts) * 0.5) - 1]
        assert got[model]["ttft_p95_ms"] == ttfts[math.ceil(len(ttfts) * 0.95) - 1]
        assert got[model]["speed_p50_tps"] == statistics.median(tps)


def test_order_statistics_against_brute_force(usage_of):
    _check(usage_of, _rows(3_000))


def test_many_groups_take_the_shuffle_join(usage_of, monkeypatch):
    from tallyforge.plans import staging

    monkeypatch.setattr(speed, "small_or_lazy", lambda df: staging.small_or_lazy(df, row_limit=0))
    _check(usage_of, _rows(500, seed=3))


def test_order_statistics_with_equal_values(usage_of):
    _check(usage_of, [dict(model="a", output_tokens=10, duration_ms=30, ttft_ms=20)] * 7)


def test_windows_always_have_both_rows(usage_of):
    day = 86_400_000
    rows = usage_of(
        dict(ts_ms=10 * day, output_tokens=100, duration_ms=1_000, ttft_ms=0),
        dict(ts_ms=5 * day, output_tokens=300, duration_ms=1_000, ttft_ms=0),
    )
    got = {r.window: r for r in speed.speed_windows(rows, 10 * day).collect()}
    assert (got["24h"].speed_tps, got["7d"].speed_tps) == (100.0, 200.0)
    compare = speed.speed_window_compare(rows, 10 * day).first()
    assert compare.delta == -0.5 and compare.direction == "down"
    late = speed.speed_window_compare(rows, 100 * day).first()
    assert late.delta is None and late.samples_7d == 0
    assert speed.speed_windows(rows, 100 * day).where(F.col("speed_tps").isNull()).count() == 2
