"""Log lines rendered from the event table, so that the log readers can be run over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.event_logs import BLOCK_LINES

# Line times: an arbitrary start plus a step per event id.
START_MS = 1_700_000_000_000
STEP_MS = 37


def _base(events: DataFrame, logs: int | None = None) -> DataFrame:
    """One log per user, or users spread over a fixed number of logs."""
    eid = F.col("event_id")
    log = F.col("user_id") if logs is None else F.col("user_id") % logs
    # The event table may be one small file; real logs are many, and are read by as many tasks.
    tasks = events.sparkSession.sparkContext.defaultParallelism
    return events.repartition(tasks, "event_id").select(
        eid,
        F.concat(F.lit("/logs/f"), log.cast("string"), F.lit(".jsonl")).alias("source_file"),
        F.call_function("div", eid, F.lit(BLOCK_LINES).cast("bigint")).alias("block"),
        eid.alias("pos"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("model-"), F.col("event_type")).alias("model"),
        (F.lit(START_MS) + eid * STEP_MS).alias("ms"),
    )


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _lines(base: DataFrame, value: Column) -> DataFrame:
    return base.select("source_file", "block", "pos", value.alias("value"))


def _obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def rollout_lines(events: DataFrame, logs: int | None = None) -> DataFrame:
    base = _base(events, logs)
    eid, stamp = F.col("event_id"), _iso(F.col("ms"))

    def line(kind: str, payload: Column) -> Column:
        return F.to_json(_obj(timestamp=stamp, type=F.lit(kind), payload=payload))

    text = F.array(_obj(type=F.lit("input_text"), text=F.concat(F.lit("  question "), eid.cast("string"))))
    totals = _obj(
        input_tokens=F.col("cents") * 3,
        cached_input_tokens=F.col("cents"),
        output_tokens=F.col("k") * 5,
        reasoning_output_tokens=F.col("k"),
        total_tokens=F.col("cents") * 3 + F.col("k") * 5,
    )
    limits = _obj(
        plan_type=F.concat(F.lit("plan"), (eid % 5).cast("string")),
        primary=_obj(used_percent=F.col("k") / 2, window_minutes=F.lit(300), resets_at=eid),
    )
    usage = _obj(
        type=F.lit("token_count"),
        info=_obj(total_token_usage=totals, model=F.when(eid % 5 == 0, F.lit("named-model"))),
        rate_limits=F.when(eid % 4 == 0, limits),
    )
    value = (
        F.when(eid % 8 == 0, line("turn_context", _obj(model=F.col("model"))))
        .when(eid % 8 == 1, line("response_item", _obj(type=F.lit("message"), role=F.lit("user"), content=text)))
        .when(eid % 8 == 2, line("response_item", _obj(type=F.lit("reasoning"))))
        .when(
            eid % 8 == 3,
            line("session_meta", _obj(id=F.concat(F.lit("ses"), eid.cast("string")), cwd=F.lit("/work/x"))),
        )
        .otherwise(line("event_msg", usage))
    )
    return _lines(base, value)


def event_log_lines(events: DataFrame, repeats: int = 1, logs: int | None = None) -> DataFrame:
    """``repeats`` > 1 appends the whole log again, as a re-read would."""
    base = _base(events, logs)
    if repeats > 1:
        base = base.withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        shift = F.col("again").cast("bigint") * F.lit(1 << 40)
        base = base.withColumns({"block": F.col("block") + shift, "pos": F.col("pos") + shift})
    eid = F.col("event_id")
    usage = _obj(
        inputTokens=F.col("cents"),
        outputTokens=F.col("k") * 7,
        reasoningTokens=F.when(eid % 3 != 0, F.col("k")),
        cacheReadTokens=F.when(eid % 4 != 0, F.col("cents") * 2),
    )
    header = _obj(header=_obj(config=_obj(model=F.col("model")), cwd=F.lit("/work/y")))
    chosen = _obj(selection=_obj(modelId=F.concat(F.lit("chosen-"), F.col("model"))))
    value = (
        F.when(eid % 7 == 0, F.to_json(_obj(type=F.lit("request/header"), seq=eid, time=F.col("ms"), data=header)))
        .when(
            eid % 7 == 1,
            F.to_json(_obj(event=_obj(type=F.lit("model/selection"), seq=eid, timestamp=F.col("ms"), data=chosen))),
        )
        .otherwise(
            F.to_json(_obj(type=F.lit("assistant/message"), seq=eid, time=F.col("ms"), data=_obj(usage=usage)))
        )
    )
    return _lines(base, value)


def transcript_lines(events: DataFrame, logs: int | None = None) -> DataFrame:
    """Three events share a message id; snapshots of one message in one file replace each other."""
    base = _base(events, logs)
    eid = F.col("event_id")
    usage = _obj(
        input_tokens=F.col("cents"),
        output_tokens=F.when(eid % 13 != 0, F.col("k") * 7),
        cache_read_input_tokens=F.when(eid % 4 != 0, F.col("cents") * 2),
        cache_creation_input_tokens=F.when(eid % 5 != 0, (F.col("k") * 3).cast("string")),
    )
    group = F.call_function("div", eid, F.lit(400).cast("bigint")).cast("string")
    assistant = _obj(
        type=F.lit("assistant"),
        sessionId=F.when(eid % 3 == 0, F.concat(F.lit("cs"), eid.cast("string"))),
        timestamp=_iso(F.col("ms")),
        uuid=F.concat(F.lit("u"), eid.cast("string")),
        message=_obj(id=F.when(eid % 2 == 0, F.concat(F.lit("msg"), group)), model=F.col("model"), usage=usage),
    )
    user = _obj(
        type=F.lit("user"),
        cwd=F.concat(F.lit("/work/c"), (eid % 5).cast("string")),
        message=_obj(role=F.lit("user"), content=F.concat(F.lit(" hello "), eid.cast("string"))),
    )
    return _lines(base, F.when(eid % 6 == 0, F.to_json(user)).otherwise(F.to_json(assistant)))


def generic_lines(events: DataFrame, logs: int | None = None) -> DataFrame:
    """Two dialects of token lines, lines without tokens and four kinds of bad lines."""
    base = _base(events, logs)
    eid = F.col("event_id")
    nested = _obj(
        session_id=F.concat(F.lit("g"), eid.cast("string")),
        createdAt=_iso(F.col("ms")),
        message=_obj(
            model=F.col("model"),
            usage=_obj(input_tokens=F.col("cents"), output_tokens=F.col("k"), reasoning_tokens=F.col("k") + 0.75),
        ),
    )
    flat = _obj(
        ts=F.floor(F.col("ms") / 1000),
        model_name=F.col("model"),
        prompt_tokens=F.col("cents").cast("string"),
        completion_tokens=F.col("k"),
        prompt_tokens_details=_obj(cached_tokens=F.col("k") * 2),
        status=F.lit("completed"),
    )
    silent = _obj(type=F.lit("user"), text=F.lit("no tokens here"))
    undated = _obj(usage=_obj(input_tokens=F.col("cents")))
    value = (
        F.when(eid % 17 == 0, F.lit("{broken"))
        .when(eid % 19 == 0, F.lit('"just text"'))
        .when(eid % 23 == 0, F.to_json(undated))
        .when(eid % 29 == 0, F.lit("   "))
        .when(eid % 31 == 0, F.concat(F.to_json(nested), F.lit(" trailing")))
        .when(eid % 3 == 0, F.to_json(nested))
        .when(eid % 3 == 1, F.to_json(flat))
        .otherwise(F.to_json(silent))
    )
    return _lines(base, value)


def write_compressed(lines: DataFrame, root: str, frame_lines: int) -> None:
    """Each log as one file of many zstd frames, ``<root>/<log>/log.jsonl.zst``. A line is cut in two wherever a
    frame ends, as writers that flush by size do. A log is written in order by one task, frame by frame."""
    log = F.regexp_extract("source_file", r"([^/]*)\.jsonl$", 1)
    ordered = lines.select(log.alias("log"), "pos", "value").repartition("log").sortWithinPartitions("log", "pos")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from pyarrow import fs

        def frame(data: bytes) -> bytes:
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as out:
                out.write(data)
            return sink.getvalue().to_pybytes()

        now, file, kept = None, None, b""
        for batch in batches:
            for name, rows in batch.groupby("log", sort=True):
                if name != now:
                    if file is not None:
                        file.write(frame(kept))
                        file.close()
                    store, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
                    store.create_dir(f"{path}/{name}", recursive=True)
                    now, file, kept = name, store.open_output_stream(f"{path}/{name}/log.jsonl.zst", compression=None), b""
                for first in range(0, len(rows), frame_lines):
                    data = kept + "".join(f"{v}\n" for v in rows["value"].iloc[first : first + frame_lines]).encode()
                    file.write(frame(data[:-20]))
                    kept = data[-20:]
        if file is not None:
            file.write(frame(kept))
            file.close()
        yield pd.DataFrame({"log": pd.Series([], dtype=str)})

    ordered.mapInPandas(write, "log string").count()


def write_plain(lines: DataFrame, root: str) -> None:
    """Each log as one text file, ``<root>/<log>.jsonl``, written in order by one task."""
    log = F.regexp_extract("source_file", r"([^/]*)\.jsonl$", 1)
    ordered = lines.select(log.alias("log"), "pos", "value").repartition("log").sortWithinPartitions("log", "pos")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        now, file = None, None
        for batch in batches:
            for name, rows in batch.groupby("log", sort=True):
                if name != now:
                    if file is not None:
                        file.close()
                    store, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
                    store.create_dir(path, recursive=True)
                    now, file = name, store.open_output_stream(f"{path}/{name}.jsonl", compression=None)
                file.write("".join(f"{v}\n" for v in rows["value"]).encode())
        if file is not None:
            file.close()
        yield pd.DataFrame({"log": pd.Series([], dtype=str)})

    ordered.mapInPandas(write, "log string").count()
