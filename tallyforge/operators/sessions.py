"""Sessions: summaries, search, paging, detail, activity and model switches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import caliber
from tallyforge.functions.text import file_stem, folder_name, prefix_session, trimmed
from tallyforge.operators.aggs import ADDITIVE, hit_rate, merged_measures, usage_measures
from tallyforge.operators.trends import bucket_edge, bucket_index
from tallyforge.plans.ordered import Last, running
from tallyforge.plans.ranges import MINUTE_MS
from tallyforge.schema import SOURCE_RELATIONAL
from tallyforge.sources.tables import one_meta

# Fixed values.
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 100
LISTED_SESSIONS = 500
DETAIL_BUCKETS = 48
SWITCH_WINDOW_MS = 30 * MINUTE_MS
RATE_WINDOW_MS = 5 * MINUTE_MS

SESSION = ["source", "session_id"]

_LINE_SPACE = 10**18


def _position() -> Column:
    """``(ts_ms, line_no)`` packed into one fixed-width number, so that hash aggregation can take its
    minimum or maximum."""
    wide = F.col("ts_ms").cast("decimal(19,0)") * F.lit(_LINE_SPACE).cast("decimal(19,0)")
    return (wide + F.coalesce("line_no", F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _ordered(position: str) -> Column:
    """Total order of usage rows: time, then file, then line."""
    space = F.lit(_LINE_SPACE).cast("decimal(19,0)")
    ts = F.floor(F.col(position) / space).cast("bigint")
    return F.struct(ts, F.col("source_file"), F.col(position))


def session_parts(usage: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """First fold: per key, model, project and file. Only fixed-width buffers, combined on the map side."""
    return usage.groupBy(*keys, "model", "project", "source_file").agg(
        *usage_measures(),
        F.min(_position()).alias("first_seen"),
        F.max(_position()).alias("last_seen"),
        *(extra or []),
    )


def _sorted_models() -> Column:
    return F.array_sort(F.collect_set("model")).alias("models")


def store_sessions(usage: DataFrame, session_meta: DataFrame | None = None) -> DataFrame:
    """Sessions of a record store: rows with a session id only. The earliest project wins, then the
    folder of the recorded directory; title and path come from ``session_meta``, which describes sessions of
    the relational store only (one row per id is used)."""
    parts = session_parts(usage.where(F.col("session_id").isNotNull()), SESSION)
    named = F.when(F.col("project").isNotNull(), _ordered("first_seen"))
    sessions = parts.groupBy(*SESSION).agg(
        F.min_by("project", named).alias("project"), _sorted_models(), *merged_measures()
    )
    if session_meta is None:
        out = sessions.withColumns({"title": F.lit(None).cast("string"), "project_path": F.lit(None).cast("string")})
    else:
        meta = one_meta(session_meta).select(
            F.lit(SOURCE_RELATIONAL).alias("source"), F.col("id").alias("session_id"), "title",
            F.col("directory").alias("project_path"), "project_name",
        )
        out = sessions.join(meta, SESSION, "left").withColumn("project", F.coalesce("project", "project_name"))
    return _session_columns(out)


def file_sessions(usage: DataFrame, file_meta: DataFrame) -> DataFrame:
    """Sessions of log files. ``file_meta`` has source, source_file, session_id, title, project_path; files
    of one session are merged, and a session without usage still appears."""
    parts = usage.groupBy("source", "source_file", "model").agg(*usage_measures())
    joined = parts.join(file_meta, ["source", "source_file"], "full").withColumn(
        "session_id", F.coalesce("session_id", file_stem(F.col("source_file")))
    )

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("source_file"))).alias(name)

    merged = joined.groupBy(*SESSION).agg(first("title"), first("project_path"), _sorted_models(), *merged_measures())
    return _session_columns(merged.withColumn("project", folder_name(F.col("project_path"))))


def _session_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *SESSION,
        prefix_session(F.col("source"), F.col("session_id")).alias("id"),
        "title",
        "project",
        "project_path",
        "models",
        *ADDITIVE,
        "first_ts_ms",
        "last_ts_ms",
        hit_rate(),
    )


def search_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of id, title, project, path or any model; blank text keeps all."""
    needle = F.lower(trimmed(F.lit(text)))
    if not text.strip():
        return sessions
    hit = F.lit(False)
    for name in ("id", "title", "project", "project_path"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
    return sessions.where(hit | F.exists("models", lambda m: F.contains(F.lower(m), needle)))


def _session_order(sort: str) -> list[Column]:
    primary = F.desc("total") if sort == "tokens" else F.desc_nulls_last("last_ts_ms")
    return [primary, F.asc("id")]


def sort_sessions(sessions: DataFrame, sort: str = "recent") -> DataFrame:
    return sessions.orderBy(*_session_order(sort))


class Page(NamedTuple):
    items: DataFrame
    total: DataFrame
    page: int
    page_size: int


def page_sessions(sessions: DataFrame, query: str = "", sort: str = "recent", page: int = 0, page_size: int = 0) -> Page:
    """One page after search and sort (a distributed top-k), and the count of all matches."""
    size = min(page_size or DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    matches = search_sessions(sessions, query)
    items = sort_sessions(matches, sort).offset(page * size).limit(size)
    return Page(items, matches.agg(F.count(F.lit(1)).alias("total")), page, size)


def newest_sessions(sessions: DataFrame, limit: int = LISTED_SESSIONS) -> DataFrame:
    return sort_sessions(sessions).limit(limit)


def top_models(models: DataFrame, limit: int = 3) -> DataFrame:
    return models.orderBy(F.desc("total"), "model").limit(limit)


def top_sessions_per_model(usage: DataFrame, from_ms: int, to_ms: int, limit: int = 10) -> DataFrame:
    """Largest sessions of each model by plain token sum. Each map task keeps only its own best rows
    before the ranking shuffle (window group limit)."""
    rows = usage.where(F.col("ts_ms").between(from_ms, to_ms) & F.col("session_id").isNotNull())
    sums = rows.groupBy("source", "model", "session_id").agg(F.sum(caliber.raw_sum_tokens()).alias("tokens"))
    place = F.row_number().over(Window.partitionBy("source", "model").orderBy(F.desc("tokens"), "session_id"))
    return sums.withColumn("place", place).where(F.col("place") <= limit)


def active_session(usage: DataFrame) -> DataFrame:
    """Per source the session with the newest row; on a tie the smallest id."""
    latest = usage.where(F.col("session_id").isNotNull()).groupBy(*SESSION).agg(F.max("ts_ms").alias("last_ts_ms"))
    best = F.min(F.struct(-F.col("last_ts_ms"), F.col("session_id"))).alias("best")
    return latest.groupBy("source").agg(best).select(
        "source", F.col("best.session_id").alias("session_id"), (-F.col("best.col1")).alias("last_ts_ms")
    )


def active_session_card(usage: DataFrame, now_ms: int) -> DataFrame:
    """The active session of each source: totals, tokens of the last five minutes and the latest model.

    The relational store counts plain sums and looks for the model in the last 30 minutes only; the other
    sources count display totals and take the last row of all.
    """
    # At most one row per source, and the sources are a fixed list.
    active = F.broadcast(active_session(usage).select(*SESSION))
    store = F.col("source") == SOURCE_RELATIONAL
    recent = F.col("ts_ms") >= now_ms - RATE_WINDOW_MS
    tokens = F.when(store, caliber.raw_sum_tokens()).otherwise(caliber.display_total())
    parts = session_parts(
        usage.join(active, SESSION),
        SESSION,
        [
            F.sum(F.when(recent, tokens)).alias("recent_tokens"),
            F.max(F.when(F.col("ts_ms") >= now_ms - SWITCH_WINDOW_MS, _position())).alias("last_recent"),
        ],
    )
    last_model = F.when(store, F.max_by("model", F.when(F.col("last_recent").isNotNull(), _ordered("last_recent"))))
    last_model = last_model.otherwise(F.max_by("model", _ordered("last_seen")))
    card = parts.groupBy(*SESSION).agg(
        F.min_by("project", F.when(F.col("project").isNotNull(), _ordered("first_seen"))).alias("project"),
        *merged_measures(),
        F.coalesce(F.sum("recent_tokens"), F.lit(0)).cast("bigint").alias("tokens_last_5m"),
        last_model.alias("active_model"),
    )
    return card.select(
        *SESSION,
        prefix_session(F.col("source"), F.col("session_id")).alias("id"),
        "project",
        F.col("total").alias("session_total_tokens"),
        "requests",
        "tokens_last_5m",
        (F.col("tokens_last_5m") / F.lit(5.0)).alias("tokens_per_min"),
        F.col("last_ts_ms").alias("last_request_ms"),
        "active_model",
        hit_rate(),
    )


def model_switches(usage: DataFrame, from_ms: int | None = None) -> DataFrame:
    """Per session all rows whose model differs from the row before; the first row always counts."""
    rows = usage.where(F.col("session_id").isNotNull())
    if from_ms is not None:
        rows = rows.where(F.col("ts_ms") >= from_ms)
    rows = rows.select(*SESSION, "ts_ms", "source_file", "line_no", "model").withColumn(
        "minute", F.call_function("div", F.col("ts_ms"), F.lit(MINUTE_MS).cast("bigint"))
    )
    order = ["ts_ms", "source_file", "line_no"]
    seen = running(rows, SESSION, "minute", order, [Last("previous", F.struct("model"), inclusive=False)])
    switched = seen.where(F.col("previous").isNull() | (F.col("previous.model") != F.col("model")))
    place = F.row_number().over(Window.partitionBy(*SESSION).orderBy(*order))
    return switched.withColumn("place", place).select(*SESSION, "place", "ts_ms", "model")


def active_model_switches(usage: DataFrame, now_ms: int) -> DataFrame:
    """Switch log of each source's active session over the last 30 minutes."""
    active = F.broadcast(active_session(usage).select(*SESSION))
    return model_switches(usage.join(active, SESSION), now_ms - SWITCH_WINDOW_MS)


def _session_spans(usage: DataFrame) -> DataFrame:
    return (
        usage.where(F.col("session_id").isNotNull())
        .groupBy(*SESSION)
        .agg(
            F.min("ts_ms").alias("from_ms"),
            (F.max("ts_ms") + 1).alias("to_ms"),
            F.least(F.count(F.lit(1)), F.lit(DETAIL_BUCKETS)).alias("buckets"),
        )
    )


def session_trends(usage: DataFrame) -> DataFrame:
    """Dense buckets over each session's own span, for all sessions at once. A busy session's rows are split
    by adaptive execution where they meet its one span row."""
    spans = _session_spans(usage)
    edges = [F.col("from_ms"), F.col("to_ms"), F.col("buckets")]
    rows = usage.join(spans, SESSION)
    grouped = (
        rows.withColumn("bucket_idx", bucket_index(F.col("ts_ms"), *edges))
        .groupBy(*SESSION, "bucket_idx")
        .agg(*usage_measures())
    )
    idx = F.col("bucket_idx")
    spine = spans.withColumn("bucket_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1))).select(
        *SESSION,
        "bucket_idx",
        bucket_edge(idx, *edges).alias("start_ms"),
        bucket_edge(idx + 1, *edges).alias("end_ms"),
    )
    return spine.join(grouped, [*SESSION, "bucket_idx"], "left").fillna(0, ADDITIVE).withColumn("hit_rate", hit_rate())


def session_models(usage: DataFrame) -> DataFrame:
    """Aggregates per session and model."""
    rows = usage.where(F.col("session_id").isNotNull())
    return rows.groupBy(*SESSION, "model").agg(*usage_measures()).withColumn("hit_rate", hit_rate())


class SessionDetail(NamedTuple):
    summary: DataFrame
    buckets: DataFrame
    models: DataFrame


def session_detail(usage: DataFrame, source: str, session_id: str, session_meta: DataFrame | None = None) -> SessionDetail:
    """Summary, buckets and models of one session; the filter reaches the scan."""
    mine = usage.where((F.col("source") == source) & (F.col("session_id") == session_id))
    models = session_models(mine).orderBy(F.desc("total"), "model")
    return SessionDetail(store_sessions(mine, session_meta), session_trends(mine), models)


def first_titles(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First acceptable title per key; ``candidates`` has a ``title`` that is NULL where unusable."""
    found = candidates.where(F.col("title").isNotNull())
    return found.groupBy(*keys).agg(F.min_by("title", order).alias("title"))
