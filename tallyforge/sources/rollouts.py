"""Rollout logs with counters that accumulate over a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions import variant as V
from tallyforge.plans.ordered import Count, First, Last, final_values, running
from tallyforge.plans.staging import cut
from tallyforge.schema import SOURCE_ROLLOUT, as_usage
from tallyforge.sources.lines import number_lines
from tallyforge.sources.transcripts import file_facts, refusal

# Counter names, and the accepted length of a derived request.
COUNTERS = {
    "input": "input_tokens",
    "cached": "cached_input_tokens",
    "cache_write": "cache_write_input_tokens",
    "output": "output_tokens",
    "reasoning": "reasoning_output_tokens",
    "total": "total_tokens",
}
MIN_REQUEST_MS = 100
MAX_REQUEST_MS = 10 * 60_000

KEYS, CHUNK, ORDER = ["source_file"], "block", ["line_no"]


def counter_delta(current: Column, previous: Column) -> Column:
    """Increase of one counter; a decrease means it was reset, and the new value is the increase."""
    before = F.coalesce(previous, F.lit(0))
    return F.when(current < before, current).otherwise(current - before)


def is_request_input(item_type: Column, role: Column) -> Column:
    """Items that feed the next request: user messages and tool outputs."""
    output = item_type.endswith("_output") & (item_type != "message_output")
    return F.coalesce(F.when(item_type == "message", role == "user").otherwise(output), F.lit(False))


def accepted_duration(start: Column, end: Column) -> Column:
    length = end - start
    return F.when((length >= MIN_REQUEST_MS) & (length <= MAX_REQUEST_MS), length)


_LIMITS = [f"{w}.{f}" for w in ("primary", "secondary") for f in ("used_percent", "window_minutes", "resets_at")]
_LINE = V.schema(
    [
        "type",
        "timestamp",
        *[f"payload.{f}" for f in ("type", "role", "session_id", "id", "cwd", "model", "message", "content")],
        "payload.info.model",
        *[f"payload.info.total_token_usage.{key}" for key in COUNTERS.values()],
        *[f"payload.rate_limits.{f}" for f in ("limit_id", "plan_type", *_LIMITS)],
    ]
)


def _counter(leaf: Column) -> Column:
    """One counter: a missing one is 0, anything but an unsigned integer is below 0."""
    return F.coalesce(V.long_of(leaf), F.when(leaf.isNull(), F.lit(0)).otherwise(F.lit(-1)).cast("bigint"))


def _counters() -> Column:
    """Struct of counters, or NULL when the object or one of its values has the wrong type."""
    values = [F.col(f"counter_{name}") for name in COUNTERS]
    return F.when(F.least(*values) >= 0, F.struct(*[v.alias(name) for v, name in zip(values, COUNTERS)]))


def _limit_window(name: str) -> Column:
    at = f"payload.rate_limits.{name}"
    return F.struct(
        F.try_variant_get(F.col(f"{at}.used_percent"), "$", "double").alias("used_percent"),
        V.count_of(F.col(f"{at}.window_minutes")).alias("window_minutes"),
        V.long_of(F.col(f"{at}.resets_at")).alias("resets_at"),
    ).alias(name)


def rollout_records(lines: DataFrame) -> DataFrame:
    """Numbered rows with only what the counting needs."""
    wanted = F.contains("value", F.lit('"type"'))
    parsed = V.with_object(lines, "line", F.when(wanted, F.col("value")), _LINE)
    bodies = parsed.select(
        "source_file",
        "block",
        "pos",
        V.text_of(F.col("line.type")).alias("kind"),
        V.parse_rfc3339(V.text_of(F.col("line.timestamp"))).alias("ts_ms"),
        F.col("line.payload").alias("payload"),
        V.text_of(F.col("line.payload.type")).alias("payload_type"),
        V.text_of(F.col("line.payload.role")).alias("role"),
        F.col("line.payload.info.total_token_usage").alias("totals"),
        F.when(F.col("line").isNull(), F.struct("value")).alias("refused"),
    ).withColumns({f"counter_{name}": _counter(F.col(f"totals.{key}")) for name, key in COUNTERS.items()})
    kind, ts, payload_type = F.col("kind"), F.col("ts_ms"), F.col("payload_type")
    token_event = (kind == "event_msg") & (payload_type == "token_count")
    item = (kind == "response_item") & (ts > 0)
    feeds = is_request_input(payload_type, F.col("role"))
    # A JSON null in the first place still decides.
    session = F.coalesce(F.col("payload.session_id"), F.col("payload.id"))
    model = F.coalesce(F.col("payload.model"), F.col("payload.info.model"))
    said = F.when(
        (payload_type == "message") & (F.col("role") == "user"),
        V.first_text_part(F.col("payload.content"), ["text", "input_text"]),
    )
    title = F.when(kind == "response_item", said).when(
        (kind == "event_msg") & (payload_type == "user_message"), V.text_of(F.col("payload.message"))
    )
    # An object without a type is not parsed, but is no reject.
    body = F.col("refused.value")
    why = refusal(body)
    why = F.when((why != "not an object") | ~F.ltrim(body).startswith("{"), why)
    rows = bodies.select(
        "source_file",
        "block",
        "pos",
        why.alias("reason"),
        F.coalesce(ts, F.lit(0)).alias("ts_ms"),
        F.when(kind == "session_meta", F.coalesce(V.text_of(session), F.lit(""))).alias("meta_session"),
        F.when(kind == "session_meta", V.text_of(F.col("payload.cwd"))).alias("meta_cwd"),
        F.when(kind == "turn_context", V.text_of(F.col("payload.model"))).alias("context_model"),
        F.when(item & feeds, ts).alias("input_ms"),
        F.when(item & ~feeds, ts).alias("output_ms"),
        text.normalize_title(title).alias("title"),
        F.when(token_event & F.col("totals").isNotNull(), _counters()).alias("counters"),
        F.when(token_event, F.nullif(V.text_of(model), F.lit(""))).alias("event_model"),
        F.when(
            token_event & F.col("payload.rate_limits").isNotNull(),
            F.struct(
                V.text_of(F.col("payload.rate_limits.limit_id")).alias("limit_id"),
                _limit_window("primary"),
                _limit_window("secondary"),
                V.text_of(F.col("payload.rate_limits.plan_type")).alias("plan_type"),
            ),
        ).alias("rate_limits"),
    )
    return number_lines(cut(rows))


def _specs() -> list:
    return [
        Last("previous", F.col("counters"), inclusive=False),
        Last("model_now", F.nullif(F.col("context_model"), F.lit(""))),
        Last("session_now", F.col("meta_session")),
        First("cwd_now", F.col("meta_cwd")),
        Count("segment", F.col("counters").isNotNull(), inclusive=False),
        Count("lines", F.lit(True)),
    ]


def _anchors() -> list[Column]:
    """First input item and last output item of a segment."""
    return [
        F.min_by("input_ms", F.when(F.col("input_ms").isNotNull(), F.col("line_no"))).alias("input_ms"),
        F.max_by("output_ms", F.when(F.col("output_ms").isNotNull(), F.col("line_no"))).alias("output_ms"),
    ]


def _with_open_request(segments: DataFrame, state: DataFrame | None) -> DataFrame:
    """Continue the segment that an earlier batch left open."""
    if state is None:
        return segments
    earlier = state.select("source_file", "segment", "open_input_ms", "open_output_ms")
    joined = segments.join(earlier, ["source_file", "segment"], "left")
    return joined.withColumns(
        {
            "input_ms": F.coalesce("open_input_ms", "input_ms"),
            "output_ms": F.coalesce("output_ms", "open_output_ms"),
        }
    ).drop("open_input_ms", "open_output_ms")


def rollout_usage(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Usage rows from cumulative counters.

    Each usage event closes a segment; the first input item and the last output item of the segment bound
    the request. ``state`` continues files whose earlier lines were read in another batch.
    """
    placed = running(records.drop("title", "rate_limits", "is_last", "reason"), KEYS, CHUNK, ORDER, _specs(), state)
    event = F.struct(
        "lines", "ts_ms", "counters", "previous", "event_model", "model_now", "session_now", "cwd_now"
    )
    segments = placed.groupBy("source_file", "segment").agg(
        *_anchors(), F.first(F.when(F.col("counters").isNotNull(), event), ignorenulls=True).alias("e")
    )
    closed = _with_open_request(segments.where(F.col("e").isNotNull()), state)
    closed = closed.select("source_file", "segment", "input_ms", "output_ms", "e.*")
    delta = {n: counter_delta(F.col(f"counters.{n}"), F.col(f"previous.{n}")) for n in COUNTERS}
    duration = accepted_duration(F.col("input_ms"), F.coalesce("output_ms", "ts_ms"))
    session = F.coalesce("session_now", text.file_stem(F.col("source_file")), F.lit("codex-session"))
    return as_usage(
        closed,
        source=F.lit(SOURCE_ROLLOUT),
        ts_ms=F.col("ts_ms"),
        model=F.coalesce("event_model", "model_now", F.lit("unknown")),
        session_id=F.nullif(session, F.lit("")),
        project=F.col("cwd_now"),
        input_tokens=delta["input"],
        output_tokens=delta["output"],
        reasoning_tokens=delta["reasoning"],
        cache_read_tokens=delta["cached"],
        cache_write_tokens=delta["cache_write"],
        duration_ms=duration,
        duration_derived=duration.isNotNull(),
        total_override=delta["total"],
        schema_exclusive=F.lit(False),
        source_file=F.col("source_file"),
        line_no=F.col("lines"),
        event_key=F.concat_ws(":", F.col("source_file"), F.col("segment")),
    )


def rollout_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per file what a later batch must know: counters, model, session, directory, lines and usage events
    so far, and the anchors of a request still open."""
    ended = final_values(records, KEYS, CHUNK, ORDER, _specs(), state)
    narrow = records.select("source_file", "block", "line_no", "input_ms", "output_ms", "counters")
    segment = Count("segment", F.col("counters").isNotNull(), inclusive=False)
    placed = running(narrow, KEYS, CHUNK, ORDER, [segment], state)
    anchors = placed.where(F.col("counters").isNull()).groupBy("source_file", "segment").agg(*_anchors())
    joined = _with_open_request(ended.join(anchors, ["source_file", "segment"], "left"), state)
    return joined.withColumnsRenamed({"input_ms": "open_input_ms", "output_ms": "open_output_ms"})


def rollout_files(records: DataFrame) -> DataFrame:
    """Per file: last session id, first title, first working directory."""
    session = F.max_by("meta_session", F.when(F.col("meta_session").isNotNull(), F.col("line_no"))).alias("session")
    facts = file_facts(records, F.lit(SOURCE_ROLLOUT), F.col("title"), F.col("meta_cwd"), session)
    fallback = F.coalesce(text.file_stem(F.col("source_file")), F.lit("codex-session"))
    return facts.withColumn("session_id", F.coalesce("session", fallback)).select(
        "source", "source_file", "session_id", "title", "project_path"
    )


def latest_rate_limits(records: DataFrame, source: str = SOURCE_ROLLOUT) -> DataFrame:
    """Newest quota snapshot; on equal times the later line."""
    found = records.where(F.col("rate_limits").isNotNull())
    newest = F.max_by(F.struct("ts_ms", "rate_limits"), F.struct("ts_ms", "source_file", "line_no")).alias("n")
    return found.groupBy(F.lit(source).alias("source")).agg(newest).select("source", "n.ts_ms", "n.rate_limits.*")


def read_cumulative_rollouts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage rows and per-file facts."""
    records = rollout_records(lines)
    return rollout_usage(records), rollout_files(records)
