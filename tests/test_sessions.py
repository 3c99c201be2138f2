"""Sessions, details, quality and exports by hand."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggs, details, quality, sessions
from tallyforge.plans.ranges import DAY_MS
from tallyforge.sinks import exports

NOW = 100 * DAY_MS


def test_store_sessions(spark, usage_of):
    usage = usage_of(
        dict(session_id="b", ts_ms=5, model="y", output_tokens=1),
        dict(session_id="b", ts_ms=3, model="x", project="late", source_file="g"),
        dict(session_id="b", ts_ms=3, model="x", project="first", source_file="f"),
        dict(session_id="a", ts_ms=5), dict(session_id=None, ts_ms=9), dict(session_id="c", ts_ms=1, source="codex"),
    )
    meta = spark.createDataFrame([("a", "Title", "/w/dir", "dir")], "id string, title string, directory string, project_name string")
    rows = {r.id: r for r in sessions.store_sessions(usage, meta).collect()}
    assert sorted(rows) == ["a", "b", "cx-c"]
    assert rows["b"].project == "first" and rows["b"].models == ["x", "y"]
    assert (rows["a"].project, rows["a"].title, rows["a"].project_path) == ("dir", "Title", "/w/dir")
    active = {r.source: r.session_id for r in sessions.active_session(usage).collect()}
    assert active == {"zcode": "a", "codex": "c"}  # equal times: smallest id
    order = [r.id for r in sessions.sort_sessions(sessions.store_sessions(usage)).collect()]
    assert order == ["a", "b", "cx-c"]


def test_file_sessions_merge_and_keep_silent_ones(spark, usage_of):
    usage = usage_of(
        dict(source="codex", source_file="1", model="m", output_tokens=2), dict(source="codex", source_file="2", output_tokens=3)
    )
    meta = spark.createDataFrame(
        [("codex", "1", "s", None, "/w/p"), ("codex", "2", "s", "Title", "/other"), ("codex", "3", "quiet", "T3", None)],
        "source string, source_file string, session_id string, title string, project_path string",
    )
    rows = {r.id: r for r in sessions.file_sessions(usage, meta).collect()}
    assert (rows["cx-s"].total, rows["cx-s"].title, rows["cx-s"].project) == (5, "Title", "p")
    assert (rows["cx-quiet"].requests, rows["cx-quiet"].models, rows["cx-quiet"].last_ts_ms) == (0, [], None)


@pytest.fixture
def listed(usage_of):
    rows = [dict(session_id=f"s{i:03d}", ts_ms=i % 7, model="Alpha" if i % 2 else "50%_off", output_tokens=i % 5) for i in range(130)]
    return sessions.store_sessions(usage_of(*rows))


def test_search_is_literal_and_before_paging(listed):
    assert sessions.search_sessions(listed, "  ALPHA ").count() == 65
    assert sessions.search_sessions(listed, "%_").count() == 65
    assert sessions.search_sessions(listed, "x_y").count() == 0
    assert sessions.search_sessions(listed, "  ").count() == 130
    page = sessions.page_sessions(listed, "s12", "recent", 0, 3)
    assert page.total.first().total == 10 and page.items.count() == 3


def test_paging(listed):
    ids = [r.id for r in listed.orderBy(F.desc("last_ts_ms"), "id").collect()]
    got = [r.id for p in range(3) for r in sessions.page_sessions(listed, page=p).items.collect()]
    assert got == ids
    assert sessions.page_sessions(listed, page_size=1_000).page_size == 100
    past = sessions.page_sessions(listed, page=9)
    assert past.items.count() == 0 and past.total.first().total == 130
    tokens = [r.total for r in sessions.page_sessions(listed, sort="tokens", page_size=100).items.collect()]
    assert tokens == sorted(tokens, reverse=True)
    other = [r.id for r in sessions.page_sessions(listed, sort="whatever").items.collect()]
    assert other == ids[:50]


def test_switches_and_card(usage_of):
    minute = 60_000
    usage = usage_of(
        *[dict(session_id="s", ts_ms=NOW - m * minute, model=model, input_tokens=10, cache_read_tokens=100, output_tokens=1)
          for m, model in [(40, "a"), (29, "b"), (20, "b"), (4, "a"), (1, "a")]]
    )
    card = sessions.active_session_card(usage, NOW).first()
    assert (card.tokens_last_5m, card.tokens_per_min, card.active_model) == (222, 44.4, "a")
    assert [r.model for r in sessions.active_model_switches(usage, NOW).orderBy("place").collect()] == ["b", "a"]
    assert [r.model for r in sessions.model_switches(usage).orderBy("place").collect()] == ["a", "b", "a"]
    later = NOW + 60 * minute
    assert sessions.active_session_card(usage, later).first().active_model is None
    local = usage.withColumn("source", F.lit("codex"))
    assert sessions.active_session_card(local, later).first().active_model == "a"


def test_all_switches_are_kept(usage_of):
    usage = usage_of(*[dict(session_id="s", ts_ms=i * 3_000_000, model="ab"[i % 2]) for i in range(120)])
    rows = sessions.model_switches(usage).orderBy("place").collect()
    assert len(rows) == 120 and rows[-1].ts_ms == 119 * 3_000_000


def test_top_models_and_one_session(usage_of):
    usage = usage_of(*[dict(session_id="s", model=f"m{i}", output_tokens=i) for i in range(5)], dict(session_id="S", model="x"))
    mine = aggs.by_session(usage, "s")
    assert [r.model for r in sessions.top_models(aggs.group_by_model(mine), 2).collect()] == ["m4", "m3"]
    assert aggs.by_model(mine, "M1").count() == 0 and aggs.by_model(mine, "m1").count() == 1


def test_session_detail(usage_of):
    usage = usage_of(*[dict(session_id="s", ts_ms=t, output_tokens=1, model="m" if t else "n") for t in (0, 5, 10)], dict(session_id="t"))
    detail = sessions.session_detail(usage, "zcode", "s")
    buckets = detail.buckets.orderBy("bucket_idx").collect()
    assert [(b.start_ms, b.end_ms, b.requests) for b in buckets] == [(0, 3, 1), (3, 7, 1), (7, 11, 1)]
    assert [r.model for r in detail.models.collect()] == ["m", "n"]
    assert detail.summary.first().requests == 3


def test_range_rollup(spark, usage_of):
    usage = usage_of(
        dict(ts_ms=NOW, source_file="a", output_tokens=1), dict(ts_ms=NOW - DAY_MS, source_file="a", output_tokens=2),
        dict(ts_ms=NOW - 8 * DAY_MS, source_file="b", output_tokens=4), dict(ts_ms=NOW + 1, source_file="c", output_tokens=8),
    )
    meta = spark.createDataFrame([("zcode", "a", "s"), ("zcode", "d", "s2"), ("zcode", "e", "")], "source string, source_file string, session_id string")
    rows = {r.range_key: r for r in details.range_rollup(usage, NOW, file_meta=meta).where("model IS NULL").collect()}
    assert {k: (r.total, r.sessions) for k, r in rows.items()} == {
        "today": (1, 1), "60m": (1, 1), "24h": (3, 1), "7d": (3, 1), "30d": (7, 2), "all": (15, 4)
    }


def test_model_detail_and_view(spark, usage_of):
    usage = usage_of(dict(ts_ms=NOW, output_tokens=1), dict(ts_ms=NOW - 6 * DAY_MS, output_tokens=2), dict(ts_ms=NOW + 5, output_tokens=4))
    row = details.model_detail(usage, NOW).first()
    assert (row.total_today, row.total_7d, row.total_30d, row.total, row.last_used_ms) == (1, 3, 3, 7, NOW + 5)
    prices = spark.createDataFrame([], "match_key string, time_tier string, tier string, currency string, input_per_m double, "
                                       "cache_hit_per_m double, cache_write_per_m double, cache_storage_per_m double, "
                                       "output_per_m double, input_schema string")
    view = details.usage_view(usage, prices, 7.0, "7d", NOW)
    total = view.totals.first().total
    assert total == 3 == view.models.agg(F.sum("total")).first()[0] == view.cost.first().total_tokens
    buckets = view.trend.where("model IS NULL")
    assert buckets.count() == 28 and buckets.agg(F.sum("total")).first()[0] == total
    assert view.models.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    assert view.revision.first().revision == 2


def test_failure_streaks(spark):
    log = [(0, True), (10, False), (20, True), (30, False), (40, False), (200_000, True), (300_000, False)]
    df = spark.createDataFrame([("s", t, i, ok) for i, (t, ok) in enumerate(log)], "source string, ts_ms bigint, seq bigint, ok boolean")
    rows = quality.failure_streaks(df, chunk_ms=25).orderBy("ts_ms").collect()
    assert [r.streak for r in rows] == [0, 1, 0, 1, 2, 0, 1]
    assert [r.visible for r in rows] == [False, False, False, False, True, False, True]
    lone = quality.failure_streaks(df.where("seq = 1")).first()
    assert lone.visible and lone.last_ok_ms is None


def test_staleness(spark):
    hour = 3_600_000
    log = [("a", 0, "ok"), ("a", 7 * hour, "error"), ("b", 5 * hour, "ok"), ("b", 6 * hour, "error"), ("c", 1, "error"), ("d", 1, "not_configured"), ("e", 1, "ok")]
    df = spark.createDataFrame([(s, t, 0, st) for s, t, st in log], "source string, ts_ms bigint, seq bigint, status string")
    rows = {r.source: (r.status, r.health, r.updated_at_ms) for r in quality.source_staleness(df, 8 * hour).collect()}
    assert rows == {
        "a": ("stale", "degraded", 0), "b": ("error", "degraded", 5 * hour), "c": ("error", "degraded", 1),
        "d": ("not_configured", "ok", 1), "e": ("ok", "ok", 1),
    }


def test_vanished_files(spark, usage_of):
    usage = usage_of(dict(source_file="a", output_tokens=1), dict(source_file="b", output_tokens=2))
    live = spark.createDataFrame([("b",), ("b",), ("c",)], "source_file string")
    assert [r.output_tokens for r in quality.keep_live_files(usage, live).collect()] == [2]


def test_csv_and_json(spark, usage_of, tmp_path):
    usage = usage_of(dict(model='a,"b"', session_id="s", ts_ms=1, input_tokens=3))
    exports.write_csv(exports.export_raw(usage).coalesce(1), str(tmp_path / "csv"))
    text = open(glob.glob(str(tmp_path / "csv" / "part-*"))[0]).read()
    header, row = text.splitlines()
    assert header.startswith("timestampMs,model,sessionId,project")
    assert row == '1,"a,""b""",s,,3,0,null,null,null,f'
    assert next(csv.reader([row]))[1] == 'a,"b"'
    exports.write_json(exports.export_raw(usage).coalesce(1), str(tmp_path / "json"))
    assert '"reasoningTokens":null' in open(glob.glob(str(tmp_path / "json" / "part-*"))[0]).read()
    assert exports.export_models(usage).first().cacheHitRate == "unavailable"


def test_rollups_read_back_with_missing_columns(spark, usage_of, tmp_path):
    usage = usage_of(dict(session_id="s", output_tokens=4, cache_read_tokens=1))
    path = str(tmp_path / "rollup")
    exports.write_rollups(usage, sessions.store_sessions(usage), usage.where("ts_ms < 0"), path)
    assert exports.read_rollup(spark, path, "all_models").first().total == 4 + 0 + 1
    assert exports.read_rollup(spark, path, "today").first().requests == 0
    assert exports.read_rollup(spark, path, "bounds").first().record_count == 1
    exports.read_rollup(spark, path, "sessions").drop("total").write.parquet(str(tmp_path / "old" / "sessions"))
    assert exports.read_rollup(spark, str(tmp_path / "old"), "sessions").first().total == 0
