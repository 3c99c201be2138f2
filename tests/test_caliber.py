"""Counting rules, ranges, buckets and text rules on hand-computed rows."""

import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import caliber, text, times
from tallyforge.functions import variant as V
from tallyforge.operators import aggs, trends
from tallyforge.plans.ranges import DAY_MS, Span, filter_range, resolve_span


def one(df, *cols):
    return tuple(df.select(*cols).first())


@pytest.mark.parametrize(
    "row, total, denominator",
    [
        # input holds its cache: nothing is added
        (dict(input_tokens=100, output_tokens=10, cache_read_tokens=60, cache_write_tokens=20), 110, 100),
        # input smaller than its cache: cache lies outside
        (dict(input_tokens=10, output_tokens=5, cache_read_tokens=100, cache_write_tokens=20), 135, 130),
        # declared exclusive beats the numbers
        (dict(input_tokens=500, output_tokens=5, cache_read_tokens=100, schema_exclusive=True), 605, 600),
        # declared inclusive beats the numbers
        (dict(input_tokens=10, output_tokens=5, cache_read_tokens=100, schema_exclusive=False), 15, 100),
        # only a cache write is known: it is added, and there is no hit rate
        (dict(input_tokens=10, output_tokens=5, cache_write_tokens=7), 22, None),
        # reasoning inside output is not added again
        (dict(input_tokens=1, output_tokens=5, reasoning_tokens=3, reasoning_in_output=True), 6, None),
        (dict(input_tokens=1, output_tokens=5, reasoning_tokens=3), 9, None),
        # the source's own total wins
        (dict(input_tokens=1, output_tokens=5, reasoning_tokens=3, total_override=77), 77, None),
        (dict(input_tokens=0, output_tokens=5, cache_read_tokens=0), 5, 0),
    ],
)
def test_totals(usage_of, row, total, denominator):
    assert one(usage_of(row), caliber.display_total(), caliber.hit_denominator()) == (total, denominator)


@pytest.mark.parametrize(
    "hint, row, billed",
    [
        ("exclusive", dict(input_tokens=50, cache_read_tokens=40), 50),
        ("inclusive", dict(input_tokens=50, cache_read_tokens=40, cache_write_tokens=20), 10),
        ("inclusive", dict(input_tokens=30, cache_read_tokens=40), 0),
        (None, dict(input_tokens=50, cache_read_tokens=40), 10),
        (None, dict(input_tokens=50, cache_read_tokens=40, cache_write_tokens=20), 50),
        (None, dict(input_tokens=50), 50),
        # the row's own flag plays no part
        (None, dict(input_tokens=50, cache_read_tokens=40, schema_exclusive=True), 10),
    ],
)
def test_billable_input(usage_of, hint, row, billed):
    assert one(usage_of(row), caliber.billable_input(hint)) == (billed,)


def test_hit_rate_without_reports_is_null(usage_of):
    agg = aggs.usage_agg(usage_of(dict(input_tokens=5))).select(aggs.hit_rate(), aggs.coverage("cache_read"))
    assert tuple(agg.first()) == (None, 0.0)


def test_failed_requests_count_in_totals(usage_of):
    rows = usage_of(dict(output_tokens=1, status="error"), dict(output_tokens=2))
    assert aggs.usage_agg(rows).select("requests", "total").first() == (2, 3)


def test_spans():
    now = 1_706_616_000_000
    assert resolve_span("60m", now) == Span(now - 3_600_000, now, 60)
    assert resolve_span("7d", now) == Span(now - 7 * DAY_MS, now, 28)
    assert resolve_span("all", now, 5) == Span(5, now, 90)
    assert resolve_span("all", now) == Span(now - 30 * DAY_MS, now, 90)
    assert resolve_span("nonsense", now) == resolve_span("today", now)
    assert resolve_span("today", now, tz="Asia/Shanghai").from_ms == now - 20 * 3_600_000


def test_skipped_midnight_gives_now():
    # Beirut moved its clocks forward at midnight on 2022-03-27.
    now = 1_648_375_200_000
    assert times.local_day_start_ms(now, "Asia/Beirut") == now
    assert times.local_day_start_ms(now, "UTC") == now - now % DAY_MS


def test_range_is_inclusive(usage_of):
    rows = usage_of(*[dict(ts_ms=t) for t in (9, 10, 15, 20, 21)])
    assert [r.ts_ms for r in filter_range(rows, 10, 20).orderBy("ts_ms").collect()] == [10, 15, 20]
    assert filter_range(rows, 20, 10).count() == 0


def test_buckets(usage_of):
    rows = usage_of(*[dict(ts_ms=t, output_tokens=1) for t in (0, 33, 34, 99, 100, 101)])
    out = trends.bucketize(rows, Span(0, 100, 3)).orderBy("bucket_idx")
    got = [tuple(r) for r in out.select("start_ms", "end_ms", "requests").collect()]
    assert got == [(0, 33, 2), (33, 66, 1), (66, 100, 2)]
    assert [r.requests for r in trends.bucketize(rows, Span(5, 5, 4)).collect()] == [0, 0, 0, 0]


def test_no_usage_gives_no_buckets(usage_of):
    assert trends.trend(usage_of(), "7d", 10**12).count() == 0
    assert trends.trend(usage_of(dict(ts_ms=1)), "7d", 10**12).count() == 28


def test_other_takes_small_and_hidden_models(usage_of):
    rows = usage_of(*[dict(ts_ms=1, model=f"m{i}", output_tokens=10 * (i + 1)) for i in range(6)])
    span = Span(0, 10, 1)
    got = {r.series: r.total for r in trends.top_models_trend(rows, span).collect()}
    assert got == {"m5": 60, "m4": 50, "m3": 40, "m2": 30, "__other__": 30}
    got = {r.series: r.total for r in trends.top_models_trend(rows, span, visible=["m5"]).collect()}
    assert got == {"m5": 60, "__other__": 150}


@pytest.mark.parametrize(
    "path, name",
    [("/a/b/c", "c"), ("C:\\x\\y\\", "y"), ("/a/b/ /", None), ("///", None), ("solo", "solo"), ("", None), ("/a\\b/", "b")],
)
def test_folder_name(spark, path, name):
    df = spark.createDataFrame([(path,)], "p string")
    assert one(df, text.folder_name(F.col("p"))) == (name,)


def test_titles(spark):
    rows = ["  hi\u3000", "<cmd>", "   ", "[Request interrupted by user]", "x" * 400]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(text.normalize_title(F.col("t"))).collect()]
    assert got == ["hi", None, None, rows[3], "x" * 300]
    assert df.where("i = 3").select(text.normalize_title(F.col("t"), True)).first()[0] is None


def test_prefixes(spark):
    df = spark.createDataFrame([("cx-cc-1",), ("dsh-9",), ("plain",)], "id string")
    got = [tuple(r[0]) for r in df.select(text.split_prefixed(F.col("id"))).collect()]
    assert got == [("codex", "cc-1"), ("dsh", "9"), ("zcode", "plain")]


def test_path_hints(spark):
    path = "/x/Projects/my-app/0123456789-0123456789-0123456789.jsonl"
    df = spark.createDataFrame([(path,)], "p string")
    hints = one(df, text.session_hint(F.col("p")), text.project_hint(F.col("p")))
    assert hints == ("0123456789-0123456789-0123456789", "my-app")
    df = spark.createDataFrame([("/s/sessions/a.jsonl",), ("/s/id7/log.jsonl.zstd",)], "p string")
    assert [r[0] for r in df.select(text.event_log_session(F.col("p"))).collect()] == ["a", "id7"]


@pytest.mark.parametrize(
    "ts, tier",
    [
        ("2024-01-29 01:00:00", "peak"),  # Monday 09:00 at UTC+8
        ("2024-01-29 00:59:59", "offpeak"),
        ("2024-01-29 04:00:00", "offpeak"),
        ("2024-01-29 06:00:00", "peak"),
        ("2024-01-29 10:00:00", "offpeak"),
        ("2024-01-27 02:00:00", "offpeak"),  # Saturday
        ("2024-01-28 17:30:00", "offpeak"),  # Monday 01:30 at UTC+8
    ],
)
def test_peak_tier(spark, ts, tier):
    ms = spark.sql(f"SELECT unix_millis(timestamp '{ts}') AS ms")
    assert one(ms, times.peak_tier(F.col("ms"))) == (tier,)


@pytest.mark.parametrize(
    "json, count",
    [
        ("12", 12), ("12.9", 12), ("-3", 0), ("-2.5", 0), ('"15"', 15), ('" 15 "', 15), ('"12.7"', None), ('"-4"', None),
        ("true", None), ("null", None), ("[1]", None), ("1e3", 1000), ('""', None),
    ],
)
def test_counts(spark, json, count):
    df = spark.createDataFrame([(json,)], "j string").select(F.try_parse_json("j").alias("v"))
    assert one(df, V.to_count(F.col("v"))) == (count,)


@pytest.mark.parametrize(
    "json, ms",
    [
        ("1700000000000", 1_700_000_000_000), ("1700000000", 1_700_000_000_000), ("12345", None),
        ('"1700000000"', 1_700_000_000_000), ('"2023-11-14T22:13:20Z"', 1_700_000_000_000),
        ('"2023-11-15T06:13:20.250+08:00"', 1_700_000_000_250), ('"2023-11-14T22:13:20"', 1_700_000_000_000),
        ('"2023-11-14T22:13:20.9 local"', 1_700_000_000_000), ('"2026年08月27日 10时00分00秒"', None), ("true", None),
        ('"2023-13-44T22:13:20Z"', None),
    ],
)
def test_timestamps(spark, json, ms):
    df = spark.createDataFrame([(json,)], "j string").select(F.try_parse_json("j").alias("v"))
    assert one(df, V.parse_ts(F.col("v"))) == (ms,)


def test_path_segments_in_linear_time(spark):
    """Names are found as before in odd paths, and a very long segment costs no square of its length."""
    odd = ["", "/", "a", "a/", "/a", "a//b", "a\\b/c", "a/b\n", "a/\n", "\n", "x y/.z", "a/b\nc", "a\n/b", "\\\\", "a/b/c/"]
    df = spark.createDataFrame([(p,) for p in odd], "p string")
    old = {"name": r"([^/\\]*)$", "parent": r"([^/\\]*)[/\\][^/\\]*$"}
    plain = [F.regexp_extract("p", old["name"], 1), F.nullif(F.regexp_extract("p", old["parent"], 1), F.lit(""))]
    rows = df.select(F.array(text.file_name(F.col("p")), text.parent_name(F.col("p"))), F.array(*plain)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]
    long = spark.createDataFrame([("s" * 1_000_000 + "/x/y.jsonl",)], "p string")
    start = time.perf_counter()
    assert long.select(text.event_log_session(F.col("p"))).first()[0] == "x"
    assert time.perf_counter() - start < 60
