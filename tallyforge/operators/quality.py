"""Ingestion audit, failure streaks, staleness and removal of vanished files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.ordered import Count, Last, running
from tallyforge.plans.ranges import HOUR_MS

# Fixed values.
VISIBLE_STREAK = 2
STALE_ERROR_AFTER_MS = 60_000
STALE_AFTER_MS = 6 * HOUR_MS
HEALTHY_STATES = ["ok", "disabled", "not_configured"]
RECENT_RECORDS = 3


class Audit(NamedTuple):
    files: DataFrame
    recent: DataFrame
    untracked: DataFrame | None


def audit_files(accepted: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per file: rows read, lines skipped and the last error."""
    read = accepted.groupBy("source_file").agg(F.count(F.lit(1)).alias("records_read"))
    skipped = rejects.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines_skipped"), F.max_by("reason", "line_no").alias("last_error")
    )
    return read.join(skipped, "source_file", "full").fillna(0, ["records_read", "lines_skipped"])


def ingest_audit(accepted: DataFrame, rejects: DataFrame, listed: DataFrame | None = None) -> Audit:
    """File status, the newest three rows, and listed files nothing was read from."""
    files = audit_files(accepted, rejects)
    order = [F.desc("ts_ms"), F.desc("source_file"), F.desc("line_no")]
    recent = accepted.orderBy(*order).limit(RECENT_RECORDS)
    untracked = None
    if listed is not None:
        untracked = listed.join(files, "source_file", "left_anti").agg(F.count(F.lit(1)).alias("untracked"))
    return Audit(files, recent, untracked)


def failure_streaks(log: DataFrame, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Per cycle of each source: failures in a row so far, and whether the error is shown.

    ``log`` has source, ts_ms, seq, ok. A success resets the streak; a lone failure is shown once the last
    success is more than a minute old.
    """
    rows = log.withColumn("chunk", F.call_function("div", F.col("ts_ms"), F.lit(chunk_ms).cast("bigint")))
    along = (["source"], "chunk", ["ts_ms", "seq"])
    counted = running(rows, *along, [Count("failures", ~F.col("ok"))])
    at_ok = F.when(F.col("ok"), F.struct("failures", "ts_ms"))
    known = running(counted, *along, [Last("success", at_ok)])
    streak = F.col("failures") - F.coalesce(F.col("success.failures"), F.lit(0))
    silent = F.col("success").isNull() | (F.col("ts_ms") - F.col("success.ts_ms") > STALE_ERROR_AFTER_MS)
    return known.select(
        "source",
        "ts_ms",
        "seq",
        "ok",
        streak.alias("streak"),
        ((streak >= VISIBLE_STREAK) | ((streak > 0) & silent)).alias("visible"),
        F.col("success.ts_ms").alias("last_ok_ms"),
    )


def health(status: Column) -> Column:
    return F.when(status.isin(*HEALTHY_STATES), F.lit("ok")).otherwise(F.lit("degraded"))


def source_staleness(log: DataFrame, now_ms: int) -> DataFrame:
    """Latest state per source; a failure after a success keeps the last good data time and is ``stale``
    once that is over six hours old, else ``error``. ``log`` has source, ts_ms, seq, status."""
    latest = log.groupBy("source").agg(
        F.max_by("status", F.struct("ts_ms", "seq")).alias("reported"),
        F.max("ts_ms").alias("attempt_ms"),
        F.max(F.when(F.col("status") == "ok", F.col("ts_ms"))).alias("last_ok_ms"),
    )
    failed = ~F.col("reported").isin(*HEALTHY_STATES) & F.col("last_ok_ms").isNotNull()
    late = F.lit(now_ms) - F.col("last_ok_ms") > STALE_AFTER_MS
    status = F.when(failed, F.when(late, F.lit("stale")).otherwise(F.lit("error"))).otherwise(F.col("reported"))
    return latest.withColumn("status", status).select(
        "source",
        "status",
        health(F.col("status")).alias("health"),
        F.when(failed, F.col("last_ok_ms")).otherwise(F.col("attempt_ms")).alias("updated_at_ms"),
        "last_ok_ms",
    )


def keep_live_files(usage: DataFrame, live: DataFrame) -> DataFrame:
    """Drop the rows of files that are gone; everything derived is simply computed again."""
    return usage.join(live.select("source_file").distinct(), "source_file", "left_semi")


def only_new(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet. Rows without a key always count as new."""
    return batch.join(stored.select(*keys).distinct(), keys, "left_anti")
