"""The one fact table, ``usage``: a row per model response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids of the four log-producing tools.
SOURCE_RELATIONAL = "zcode"
SOURCE_ROLLOUT = "codex"
SOURCE_EVENT_LOG = "dsh"
SOURCE_TRANSCRIPT = "claude-code"
SOURCES = [SOURCE_RELATIONAL, SOURCE_ROLLOUT, SOURCE_EVENT_LOG, SOURCE_TRANSCRIPT]

# Prefix put before a session id when sources are shown together.
SESSION_PREFIXES = {
    SOURCE_RELATIONAL: "",
    SOURCE_ROLLOUT: "cx-",
    SOURCE_TRANSCRIPT: "cc-",
    SOURCE_EVENT_LOG: "dsh-",
}

USAGE = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("ts_ms", T.LongType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("input_tokens", T.LongType(), False),
        T.StructField("output_tokens", T.LongType(), False),
        # NULL in the next five means "the source does not say", never zero.
        T.StructField("reasoning_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("cache_write_tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("ttft_ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_override", T.LongType()),
        T.StructField("reasoning_in_output", T.BooleanType(), False),
        T.StructField("schema_exclusive", T.BooleanType()),
        T.StructField("duration_derived", T.BooleanType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("line_no", T.LongType()),
        T.StructField("event_key", T.StringType()),
    ]
)


def as_usage(df: DataFrame, **columns: Column) -> DataFrame:
    """Project ``df`` onto the usage schema; fields not given become NULL (false for the flags)."""
    defaults = {"reasoning_in_output": F.lit(False), "duration_derived": F.lit(False)}
    out = []
    for field in USAGE.fields:
        if field.name in columns:
            col = columns[field.name]
        elif field.name in defaults:
            col = defaults[field.name]
        else:
            col = F.lit(None)
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def with_ts_date(usage: DataFrame) -> DataFrame:
    """Add the partition column ``ts_date`` (UTC day of ``ts_ms``)."""
    return usage.withColumn("ts_date", F.date_from_unix_date(F.expr("cast(floor(ts_ms / 86400000D) as int)")))
