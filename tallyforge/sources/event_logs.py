"""Event logs with sequence numbers, plain or zstd-compressed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions import variant as V
from tallyforge.plans.ordered import Count, First, Last, Max, final_values, running
from tallyforge.plans.staging import cut
from tallyforge.schema import SOURCE_EVENT_LOG, as_usage
from tallyforge.sources.frames import BATCH_LINES, LINES, RANGE_BYTES, frame_lines, frame_ranges, opened_by_arrow
from tallyforge.sources.lines import COMPRESSED, UNREADABLE, number_lines, plain_path, root_folders, searched
from tallyforge.sources.transcripts import file_facts, refusal

# Where a header or selection names the model and the working directory.
MODEL_PATHS = [
    "header.config.model", "header.model", "config.model", "model", "modelId", "selection.model",
    "selection.modelId", "selection.model.modelId",
]
CWD_PATHS = ["header.cwd", "header.config.cwd", "config.cwd", "cwd", "header.workspace"]
USAGE_FIELDS = ["inputTokens", "outputTokens", "reasoningTokens", "cacheReadTokens", "cacheWriteTokens"]
# Spark hands a file over whole only up to this many bytes.
MAX_BINARY_BYTES = 2_147_483_647

# Bytes read at a time, and lines per block of a file that is decompressed whole.
READ_BYTES = 1 << 20
BLOCK_LINES = 65_536


_DATA = V.schema(
    ["header", "config", "model", "modelId", "selection", "cwd"], usage=V.schema(USAGE_FIELDS)
)
_ENVELOPE = ["type", "seq", "time", "timestamp"]
_LINE = V.schema(
    _ENVELOPE, data=_DATA, usage=V.schema(USAGE_FIELDS), event=V.schema(_ENVELOPE, data=_DATA)
)


def _time_of(node: str) -> Column:
    stamp = V.text_of(F.col(f"{node}.timestamp"))
    number = F.when(F.trim(stamp).rlike(r"^[+-]?[0-9]+$"), F.trim(stamp).try_cast("bigint"))
    numbers = [V.in_calendar(n) for n in (V.long_of(F.col(f"{node}.time")), V.long_of(F.col(f"{node}.timestamp")), number)]
    return F.coalesce(*numbers[:2], V.parse_rfc3339(stamp), numbers[2])


def _data_text(path: str) -> Column:
    """Text at a dotted path of ``data``."""
    first, _, rest = path.partition(".")
    leaf = F.col(f"data.{first}")
    return V.text_at(leaf, f"$.{rest}") if rest else V.text_of(leaf)


def event_records(lines: DataFrame) -> DataFrame:
    """Numbered rows of the event envelope, either bare or nested under ``event``."""
    parsed = V.with_object(lines, "line", F.col("value"), _LINE)
    bare = F.col("line.type").isNotNull()
    split = parsed.select(
        "source_file",
        "block",
        "pos",
        V.text_of(F.when(bare, F.col("line.type")).otherwise(F.col("line.event.type"))).alias("kind"),
        F.when(bare, F.col("line.data")).otherwise(F.col("line.event.data")).alias("data"),
        F.coalesce(V.long_of(F.col("line.event.seq")), V.long_of(F.col("line.seq"))).alias("seq"),
        F.coalesce(_time_of("line.event"), _time_of("line"), F.lit(0)).alias("ts_ms"),
        F.col("line.usage").alias("line_usage"),
        F.when(F.col("line").isNull(), refusal(F.col("value"))).alias("reason"),
    ).withColumn("usage", F.when(F.col("kind") == "assistant/message", F.coalesce("data.usage", "line_usage")))
    header = F.col("kind").isin("request/header", "model/selection")
    model = F.coalesce(*[F.nullif(_data_text(p), F.lit("")) for p in MODEL_PATHS])
    filled = [_data_text(p) for p in CWD_PATHS]
    cwd = F.coalesce(*[F.when(t.rlike(r"[^\p{IsWhite_Space}]"), t) for t in filled])
    rows = split.select(
        "source_file",
        "block",
        "pos",
        F.col("kind").isNotNull().alias("is_event"),
        "reason",
        "seq",
        "ts_ms",
        F.when(header, model).alias("header_model"),
        F.when(header, cwd).alias("header_cwd"),
        *[V.count_of(F.col(f"usage.{f}")).alias(f) for f in USAGE_FIELDS],
    )
    return number_lines(cut(rows))


def _highest() -> list:
    return [Max("highest", F.col("seq"))]


def _numbered(records: DataFrame) -> DataFrame:
    return records.where(F.col("is_event") & F.col("seq").isNotNull())


def keep_new_sequence(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Events whose number exceeds every earlier one of the file; unnumbered events are dropped."""
    seen = running(_numbered(records), ["source_file"], "block", ["line_no"], _highest(), state)
    return seen.where(F.col("seq") > F.coalesce("highest", F.lit(-1))).drop("highest")


def sequenced_usage(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Usage rows of logs that may be delivered again: known sequence numbers change nothing."""
    return event_usage(keep_new_sequence(records, state), state)


def sequenced_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    highest = final_values(_numbered(records), ["source_file"], "block", ["line_no"], _highest(), state)
    return highest.join(event_state(keep_new_sequence(records, state), state), "source_file", "left")


def _specs() -> list:
    return [
        Last("model_now", F.col("header_model")),
        First("cwd_now", F.col("header_cwd")),
        Count("events", F.lit(True)),
    ]


def event_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per file what a later batch must know: model, directory and events so far."""
    return final_values(records.where("is_event"), ["source_file"], "block", ["line_no"], _specs(), state)


def event_usage(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Usage rows of assistant messages; reasoning is inside output, cache outside input. ``state``
    continues files whose earlier lines were read in another batch."""
    placed = running(records.where("is_event"), ["source_file"], "block", ["line_no"], _specs(), state)
    rows = placed.where(F.col("inputTokens").isNotNull() | F.col("outputTokens").isNotNull())
    n = {f: F.coalesce(f, F.lit(0)) for f in USAGE_FIELDS}
    return as_usage(
        rows,
        source=F.lit(SOURCE_EVENT_LOG),
        ts_ms=F.col("ts_ms"),
        model=F.coalesce("model_now", F.lit("unknown")),
        session_id=text.event_log_session(F.col("source_file")),
        project=F.col("cwd_now"),
        input_tokens=n["inputTokens"],
        output_tokens=n["outputTokens"],
        reasoning_tokens=n["reasoningTokens"],
        cache_read_tokens=n["cacheReadTokens"],
        cache_write_tokens=n["cacheWriteTokens"],
        total_override=n["inputTokens"] + n["cacheReadTokens"] + n["cacheWriteTokens"] + n["outputTokens"],
        reasoning_in_output=F.lit(True),
        schema_exclusive=F.lit(True),
        source_file=F.col("source_file"),
        line_no=F.col("events"),
        event_key=F.concat_ws(":", F.col("source_file"), F.coalesce("seq", "events")),
    )


def event_files(records: DataFrame) -> DataFrame:
    facts = file_facts(records, F.lit(SOURCE_EVENT_LOG), F.lit(None).cast("string"), F.col("header_cwd"))
    return facts.withColumn("session_id", text.event_log_session(F.col("source_file"))).select(
        "source", "source_file", "session_id", "title", "project_path"
    )


def read_event_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage rows and per-file facts of plain logs."""
    records = event_records(lines)
    return event_usage(records), event_files(records)


def _text_lines(content: bytes) -> Iterator[str]:
    """Lines of zstd frames, a piece at a time. Where the frames are broken one marked line follows what
    could be read, which the reader reports as a reject."""
    import pyarrow as pa

    rest = b""
    try:
        with pa.CompressedInputStream(pa.BufferReader(content), "zstd") as stream:
            while piece := stream.read(READ_BYTES):
                *whole, rest = (rest + piece).split(b"\n")
                yield from (line.decode("utf-8", "replace") for line in whole)
    except (OSError, pa.ArrowException) as problem:
        yield f"{UNREADABLE}{problem}"
        return
    if rest:
        yield rest.decode("utf-8", "replace")


def _decompress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["source_file"], frame["content"]):
            numbered = enumerate(_text_lines(content))
            while batch := list(islice(numbered, BATCH_LINES)):
                rows = [(path, n // BLOCK_LINES, n, line) for n, line in batch]
                yield pd.DataFrame(rows, columns=["source_file", "block", "pos", "value"])


def _whole_files(spark: SparkSession, root: str) -> DataFrame:
    """For stores that only Spark reads: it hands a file over whole, so a file is one task and at most
    ``MAX_BINARY_BYTES`` long; a longer one is a reject (the length is filtered before the content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", COMPRESSED)
    found = files.load(root).withColumn("source_file", plain_path(F.col("_metadata.file_path"))).where(searched(F.col("source_file"), root_folders(spark, root)))
    lines = found.where(F.col("length") <= MAX_BINARY_BYTES).select("source_file", "content").mapInPandas(_decompress, LINES)
    why = F.concat(F.lit(UNREADABLE), F.col("length").cast("string"), F.lit(" bytes"))
    zero = F.lit(0).cast("bigint")
    too_long = found.where(F.col("length") > MAX_BINARY_BYTES).select("source_file", zero.alias("block"), zero.alias("pos"), why.alias("value"))
    return lines.unionByName(too_long)


def scan_compressed_lines(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of zstd-framed logs of every size, a task per range of frames. A range with a broken frame, or a
    file that is none, ends in one marked line, which becomes a reject. Only in stores that Python cannot open
    (see ``opened_by_arrow``) is a file read whole."""
    if not opened_by_arrow(root_folders(spark, root)):
        return _whole_files(spark, root)
    return frame_lines(frame_ranges(spark, root, range_bytes))


def read_compressed_event_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like ``read_event_logs``, with repeated and unnumbered events dropped."""
    records = keep_new_sequence(event_records(lines))
    return event_usage(records), event_files(records)
