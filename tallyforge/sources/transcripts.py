"""Generic and assistant-style transcripts: one JSON object per line, fields found by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions import variant as V
from tallyforge.plans.ordered import First, final_values, running
from tallyforge.plans.staging import cut
from tallyforge.schema import SOURCE_RELATIONAL, SOURCE_TRANSCRIPT, as_usage
from tallyforge.sources.lines import PART_SPACE, UNREADABLE, number_lines

# Where tools put each field, in order of preference.
USAGE_OBJECT = [
    "usage", "message.usage", "tokens", "token_usage", "tokenUsage", "data.usage", "message.tokens", "cost.usage",
]
MODEL = ["model", "message.model", "modelName", "model_name", "modelInfo.name", "request.model"]
TIMESTAMP = [
    "timestamp", "ts", "requestTimestamp", "request_timestamp", "createdAt", "created_at", "time", "date",
    "message.created_at",
]
SESSION = ["sessionId", "session_id", "conversationId"]
PROJECT = ["project", "projectPath", "project_path", "cwd", "workspace", "gitBranch"]
INPUT = ["input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "input_token_count", "inputTokensCount"]
OUTPUT = ["output_tokens", "outputTokens", "completion_tokens", "completionTokens", "output_token_count"]
REASONING = [
    "reasoning_tokens", "reasoningTokens", "thinking_tokens", "reasoning_output_tokens",
    "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens",
]
CACHE_READ = [
    "cache_read_input_tokens", "cacheReadInputTokens", "cached_input_tokens", "cachedInputTokens", "cached_tokens",
    "cache_read", "cacheReadTokens", "prompt_tokens_details.cached_tokens", "usage_details.cached_tokens",
]
CACHE_WRITE = [
    "cache_creation_input_tokens", "cacheCreationInputTokens", "cache_write_input_tokens", "cacheWriteInputTokens",
    "cache_creation", "cache_written_input_tokens",
]
DURATION = ["duration_ms", "durationMs", "duration"]
TTFT = ["time_to_first_token_ms", "timeToFirstTokenMs", "ttft_ms", "ttftMs", "first_token_ms"]

_USAGE_LEAVES = [*INPUT, *OUTPUT, *REASONING, *CACHE_READ, *CACHE_WRITE, *DURATION, *TTFT, "status", "model"]
_LINE_LEAVES = [
    *_USAGE_LEAVES, *MODEL, *TIMESTAMP, *SESSION, *PROJECT,
    "type", "summary", "uuid", "message.id", "message.content",
]
_LINE = V.schema(
    _LINE_LEAVES, **{path.replace(".", "__"): V.schema(_USAGE_LEAVES) for path in USAGE_OBJECT}
)


def _under(parent: str, names: list[str]) -> list[Column]:
    return [F.col(f"{parent}.{n}") for n in names]


def _fits(value: Column, max_line_bytes: int | None) -> Column:
    return F.lit(True) if max_line_bytes is None else F.octet_length(value) <= max_line_bytes


def _parsed(lines: DataFrame, max_line_bytes: int | None) -> DataFrame:
    """``line`` is the parsed object (NULL where there is none) and ``usage`` its usage object: the first
    path that holds an object, else the line itself when it has a token field."""
    fits = _fits(F.col("value"), max_line_bytes)
    bodies = V.with_object(lines, "line", F.when(fits, F.col("value")), _LINE)
    roots = list(dict.fromkeys(leaf.split(".")[0] for leaf in _USAGE_LEAVES))
    flat = F.when(
        V.first_present(_under("line", INPUT + OUTPUT)).isNotNull(), F.struct(*[F.col(f"line.{r}") for r in roots])
    )
    return bodies.withColumn("usage", F.coalesce(*_under("line", USAGE_OBJECT), flat))


def _fields() -> dict[str, Column]:
    def text_in(names: list[str]) -> Column:
        """The first present field decides; if it is not text there is no value."""
        return V.text_of(V.first_present(_under("line", names)))

    def count(names: list[str]) -> Column:
        return V.pick_count(_under("usage", names))

    return {
        "ts_ms": V.parse_ts(V.first_present(_under("line", TIMESTAMP))),
        "model": F.coalesce(text_in(MODEL), V.text_of(F.col("usage.model")), F.lit("unknown")),
        "line_session": text_in(SESSION),
        "line_project": text_in(PROJECT),
        "input_tokens": count(INPUT),
        "output_tokens": count(OUTPUT),
        "reasoning_tokens": count(REASONING),
        "cache_read_tokens": count(CACHE_READ),
        "cache_write_tokens": count(CACHE_WRITE),
        "duration_ms": count(DURATION),
        "ttft_ms": count(TTFT),
        "status": V.text_of(V.first_present([F.col("usage.status"), F.col("line.status")])),
    }


def refusal(body: Column, max_line_bytes: int | None = None) -> Column:
    """Why a line that is no JSON object is refused; blank lines are not."""
    return (
        F.when(body.isNull() | ~body.rlike(r"[^\s]"), None)
        .when(body.startswith(UNREADABLE), "unreadable file")
        .when(~_fits(body, max_line_bytes), "oversized line")
        .when(V.is_json(body), "not an object")
        .otherwise("not JSON")
    )


def extract_records(
    lines: DataFrame, extra: dict[str, Column] | None = None, max_line_bytes: int | None = None
) -> DataFrame:
    """Lines frame to numbered rows with ``reason`` (NULL for good and skipped lines) and ``is_record``.

    ``extra`` columns may use ``line``, the parsed object. Longer lines than ``max_line_bytes`` are rejected
    unread; by default none is.
    """
    fields = {**_fields(), "ts_given": V.first_present(_under("line", TIMESTAMP)).isNotNull(), **(extra or {})}
    row = _parsed(lines, max_line_bytes).select(
        "source_file",
        "block",
        "pos",
        F.when(F.col("line").isNull(), F.struct("value")).alias("refused"),
        *[c.alias(n) for n, c in fields.items()],
    )
    has_tokens = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    why = refusal(F.col("refused.value"), max_line_bytes)
    late = F.when(F.col("ts_given"), "unusable timestamp").otherwise("tokens without a timestamp")
    undated = F.when(has_tokens & F.col("ts_ms").isNull(), late)
    reason = F.when(F.col("refused").isNotNull(), why).otherwise(undated)
    judged = row.withColumns({"reason": reason, "is_record": has_tokens & F.col("ts_ms").isNotNull()})
    return number_lines(cut(judged.drop("refused", "ts_given")))


def _tokens() -> dict[str, Column]:
    zero = F.lit(0)
    plain = ["reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "duration_ms", "ttft_ms", "status"]
    return {
        "ts_ms": F.col("ts_ms"),
        "model": F.col("model"),
        "input_tokens": F.coalesce("input_tokens", zero),
        "output_tokens": F.coalesce("output_tokens", zero),
        **{n: F.col(n) for n in plain},
        "source_file": F.col("source_file"),
        "line_no": F.col("line_no"),
    }


def _position_key() -> Column:
    """File, landed part (0 for files read whole) and line."""
    part = F.call_function("div", F.col("block"), F.lit(PART_SPACE).cast("bigint"))
    return F.concat_ws(":", F.col("source_file"), part, F.col("line_no"))


def jsonl_usage(records: DataFrame, source: str = SOURCE_RELATIONAL) -> DataFrame:
    """Usage rows of a generic transcript; session and project fall back to hints from the path."""
    rows = records.where("is_record")
    path = F.col("source_file")
    return as_usage(
        rows,
        source=F.lit(source),
        session_id=F.coalesce("line_session", text.session_hint(path)),
        project=F.coalesce("line_project", text.project_hint(path)),
        event_key=_position_key(),
        **_tokens(),
    )


def rejected_lines(records: DataFrame) -> DataFrame:
    """Refused lines of any log format. A last line that is no JSON yet may still be being written and is not counted."""
    unfinished = F.col("is_last") & (F.col("reason") == "not JSON")
    return records.where(F.col("reason").isNotNull() & ~unfinished).select("source_file", "line_no", "reason")


def read_jsonl_usage(
    lines: DataFrame, source: str = SOURCE_RELATIONAL, max_line_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    records = extract_records(lines, max_line_bytes=max_line_bytes)
    return jsonl_usage(records, source), rejected_lines(records)


def keep_last_snapshot(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key. An aggregate, not a window: copies of one key are
    combined on the map side, however many there are."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*keys, "last.*").select(*rows.columns)


def _user_title(content: Column) -> Column:
    words = F.coalesce(V.text_of(content), V.first_text_part(content, ["text"]))
    return text.normalize_title(words, reject_interrupted=True)


def transcript_records(lines: DataFrame) -> DataFrame:
    """Numbered rows of assistant-style transcripts with what their metadata lines say."""
    line_type = V.text_of(F.col("line.type"))
    summary = text.normalize_title(V.text_of(F.col("line.summary")), reject_interrupted=True)
    said = _user_title(F.col("line.message.content"))
    extra = {
        "line_type": line_type,
        "message_id": V.text_of(F.col("line.message.id")),
        "uuid": V.text_of(F.col("line.uuid")),
        "cwd": V.text_of(F.col("line.cwd")),
        "title": F.when(line_type == "summary", summary).when(line_type == "user", said),
    }
    return extract_records(lines, extra)


def _first_cwd() -> list:
    return [First("first_cwd", F.col("cwd"))]


def transcript_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per file what a later batch must know: the first working directory."""
    return final_values(records, ["source_file"], "block", ["line_no"], _first_cwd(), state)


def transcript_usage(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Usage rows: assistant lines with tokens, cache outside input, last snapshot of each message per
    file. Sidechain lines count. ``state`` continues files whose earlier lines were read before."""
    rows = records.drop("is_last", "reason", "title")
    placed = running(rows, ["source_file"], "block", ["line_no"], _first_cwd(), state)
    tokens = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    anonymous = F.concat_ws("-", F.lit("anon"), F.col("ts_ms"), *tokens)
    rows = placed.where(F.col("is_record") & (F.col("line_type") == "assistant") & ((tokens[0] > 0) | (tokens[1] > 0)))
    usage = as_usage(
        rows,
        source=F.lit(SOURCE_TRANSCRIPT),
        session_id=F.coalesce("line_session", text.file_stem(F.col("source_file"))),
        project=F.coalesce("line_project", "first_cwd"),
        schema_exclusive=F.lit(True),
        event_key=F.coalesce("message_id", "uuid", anonymous),
        **_tokens(),
    )
    return keep_last_snapshot(usage, ["source_file", "event_key"], "line_no")


def transcript_files(records: DataFrame) -> DataFrame:
    """Per file: session id (the file stem), first title and first working directory."""
    return file_facts(records, F.lit(SOURCE_TRANSCRIPT), F.col("title"), F.col("cwd")).withColumn(
        "session_id", F.coalesce(text.file_stem(F.col("source_file")), F.lit("claude-session"))
    ).select("source", "source_file", "session_id", "title", "project_path")


def file_facts(records: DataFrame, source: Column, title: Column, path: Column, *more: Column) -> DataFrame:
    def earliest(col: Column) -> Column:
        return F.min_by(col, F.when(col.isNotNull(), F.col("line_no")))

    return records.groupBy("source_file").agg(
        earliest(title).alias("title"), earliest(path).alias("project_path"), *more
    ).withColumn("source", source)


def read_transcripts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage rows and per-file facts."""
    records = transcript_records(lines)
    return transcript_usage(records), transcript_files(records)
