"""Relational usage tables whose columns are recognised by name, and session metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import text
from tallyforge.functions.variant import parse_ts_text
from tallyforge.schema import SOURCE_RELATIONAL, as_usage

# Accepted column names per logical field.
COLUMN_ALIASES = {
    "input": [
        "input_tokens", "inputtokens", "prompt_tokens", "prompttokens", "input_token_count", "inputtokenscount", "input",
    ],
    "output": [
        "output_tokens", "outputtokens", "completion_tokens", "completiontokens", "output_token_count", "output",
        "completion",
    ],
    "reasoning": ["reasoning_tokens", "reasoningtokens", "thinking_tokens", "reasoning_output_tokens", "reasoning"],
    "cache_read": [
        "cache_read_input_tokens", "cachereadinputtokens", "cached_input_tokens", "cachedinputtokens", "cached_tokens",
        "cachedtokens", "cache_read", "cacheread", "cache_read_tokens",
    ],
    "cache_write": [
        "cache_creation_input_tokens", "cachecreationinputtokens", "cache_write_input_tokens", "cachewriteinputtokens",
        "cache_creation", "cachecreation", "cache_write",
    ],
    "time": [
        "timestamp", "ts", "time", "created_at", "createdat", "request_timestamp", "requesttimestamp", "date",
        "created_at_ms", "timestamp_ms", "started_at",
    ],
    "duration": ["duration_ms", "durationms", "duration"],
    "ttft": ["time_to_first_token_ms", "timetofirsttokenms", "ttft_ms", "first_token_ms"],
    "status": ["status"],
    "total": ["computed_total_tokens", "computedtotaltokens"],
    "model": ["model", "model_name", "modelname", "model_id", "modelid"],
    "session": ["session_id", "sessionid", "session", "conversation_id"],
    "project": ["project", "project_path", "projectpath", "cwd", "workspace"],
    "id": ["id", "request_id", "requestid", "uuid", "row_id", "rowid_key"],
}
TOKEN_FIELDS = ["input", "output", "reasoning", "cache_read", "cache_write"]


def map_columns(names: list[str]) -> dict[str, str]:
    """Logical field to the first column (in table order) that carries one of its names."""
    mapping = {}
    for name in names:
        for field, aliases in COLUMN_ALIASES.items():
            if field not in mapping and name.strip().lower() in aliases:
                mapping[field] = name
    return mapping


def table_score(names: list[str]) -> int | None:
    """How much a table looks like usage; None when it has no token column."""
    mapping = map_columns(names)
    tokens = sum(f in mapping for f in TOKEN_FIELDS)
    return 4 * tokens + 2 * ("time" in mapping) + ("model" in mapping) if tokens else None


def pick_usage_table(tables: dict[str, DataFrame]) -> str | None:
    """Best-scoring table, the first on a tie. Only schemas are looked at."""
    best, best_score = None, -1
    for name, df in tables.items():
        score = table_score(df.columns)
        if score is not None and score > best_score:
            best, best_score = name, score
    return best


def _cell(df: DataFrame, mapping: dict[str, str], field: str) -> Column:
    """Cell as text; missing columns and fractional numbers are NULL."""
    if field not in mapping:
        return F.lit(None).cast("string")
    kind = df.schema[mapping[field]].dataType
    col = F.col(f"`{mapping[field]}`")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.BooleanType, T.BinaryType)):
        return F.lit(None).cast("string")
    if isinstance(kind, T.DecimalType) and kind.scale:
        return F.lit(None).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(col.cast("timestamp")).cast("string")
    return col.cast("string")


def _count(cell: Column) -> Column:
    return F.when(cell.rlike(r"^\+?[0-9]+$"), cell.try_cast("bigint"))


def map_usage_table(df: DataFrame, source: str = SOURCE_RELATIONAL, source_file: str = "") -> DataFrame:
    """Project any usage-like table onto the usage schema.

    A source-computed total marks the schema in which reasoning is nested in output. Rows without a key get
    a 256-bit hash of their mapped cells.
    """
    mapping = map_columns(df.columns)
    cells = {f: _cell(df, mapping, f) for f in COLUMN_ALIASES}
    rows = df.select(*[c.alias(f) for f, c in cells.items()]).withColumn("ts_ms", parse_ts_text(F.col("time")))
    n = {f: _count(F.col(f)) for f in [*TOKEN_FIELDS, "duration", "ttft", "total"]}
    usable = F.col("ts_ms").isNotNull() & F.col("model").isNotNull()
    usable = usable & (n["input"].isNotNull() | n["output"].isNotNull())
    return as_usage(
        rows.where(usable),
        source=F.lit(source),
        ts_ms=F.col("ts_ms"),
        model=F.col("model"),
        session_id=F.col("session"),
        project=F.col("project"),
        input_tokens=F.coalesce(n["input"], F.lit(0)),
        output_tokens=F.coalesce(n["output"], F.lit(0)),
        reasoning_tokens=n["reasoning"],
        cache_read_tokens=n["cache_read"],
        cache_write_tokens=n["cache_write"],
        duration_ms=n["duration"],
        ttft_ms=n["ttft"],
        status=F.nullif("status", F.lit("")),
        total_override=n["total"],
        reasoning_in_output=F.lit("total" in mapping),
        source_file=F.lit(source_file),
        event_key=F.coalesce(F.nullif("id", F.lit("")), F.sha2(F.to_json(F.struct(*COLUMN_ALIASES)), 256)),
    )


def read_session_meta(df: DataFrame) -> DataFrame | None:
    """``id``, ``title``, ``directory`` and its folder name; None when the columns are not there."""
    names = {c.lower(): c for c in df.columns}
    place = names.get("directory") or names.get("path")
    if "id" not in names or "title" not in names or place is None:
        return None

    def clean(name: str) -> Column:
        return text.non_blank(F.col(f"`{name}`").cast("string"))

    updated = F.col(f"`{names['time_updated']}`") if "time_updated" in names else F.lit(None)
    meta = df.select(
        clean(names["id"]).alias("id"), clean(names["title"]).alias("title"), clean(place).alias("directory"),
        updated.cast("string").try_cast("bigint").alias("time_updated"),
    )
    named = meta.where(F.col("id").isNotNull()).withColumn("project_name", text.folder_name(F.col("directory")))
    return one_meta(named).select("id", "title", "directory", "project_name")


def one_meta(meta: DataFrame) -> DataFrame:
    """One row per session id: the newest by ``time_updated`` where there is one, then the largest values."""
    fields = [c for c in ("title", "directory", "project_name") if c in meta.columns]
    order = [c for c in ("time_updated", *fields) if c in meta.columns]
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("last")
    return meta.groupBy("id").agg(last).select("id", "last.*")


def read_jdbc(spark, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A relational table read in ranges of a numeric column, one range per task."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )
