"""A time rollup that answers any range exactly.

Usage is folded to one row per minute and model, and further to cells of 4, 16, 64, ... minutes. A range is made up
of few whole cells, at most six of each width, and of the parts of minutes at its two ends, for which alone usage
rows are read. A trend is one such range per bucket: the ends of its buckets are the parts that usage is read for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.aggs import ADDITIVE, hit_rate, merged_measures, usage_measures
from tallyforge.operators.trends import _dense, bucket_index, bucket_spine
from tallyforge.plans.ranges import MINUTE_MS, Span
from tallyforge.plans.staging import cut

BITS = 2  # a cell has four cells of the next smaller width
LEVELS = 11  # the widest: 4 ** 10 minutes, about two years
KEYS = ["source", "model"]


def usage_cells(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``level, cell``, the keys and the measures of every cell that has usage. Usage is folded to minutes in one
    pass; wider cells are folded from these."""
    keys = KEYS if keys is None else keys
    minute = F.floor(F.col("ts_ms") / F.lit(MINUTE_MS)).cast("bigint")
    minutes = cut(usage.groupBy(minute.alias("minute"), *keys).agg(*usage_measures()))
    return _widened(minutes, keys)


def _widened(minutes: DataFrame, keys: list[str]) -> DataFrame:
    leveled = minutes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    cell = F.call_function("shiftright", F.col("minute"), F.col("level") * BITS)
    return leveled.groupBy("level", cell.alias("cell"), *keys).agg(*merged_measures())


def merged_cells(*parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells of several batches as one: measures add up, so a batch's own cells are all that is computed."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("level", "cell", *(KEYS if keys is None else keys)).agg(*merged_measures())


def write_cells(cells: DataFrame, path: str) -> None:
    """A folder per width, cells in order, so that a reader opens few row groups."""
    ordered = cells.repartitionByRange("level", "cell").sortWithinPartitions("level", "cell")
    ordered.write.mode("overwrite").partitionBy("level").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cover(first: int, last: int) -> list[tuple[int, int, int]]:
    """Cells (level, first, one after the last) that make up the minutes from ``first`` to before ``last``: the
    widest that fit, and at most three of each width on either side."""
    out, level = [], 0
    while first < last:
        inner_first, inner_last = -(-first >> BITS), last >> BITS
        if level == LEVELS - 1 or inner_first >= inner_last:
            out.append((level, first, last))
            break
        out += [(level, a, b) for a, b in ((first, inner_first << BITS), (inner_last << BITS, last)) if a < b]
        first, last, level = inner_first, inner_last, level + 1
    return out


def _whole_minutes(start_ms: int, end_ms: int) -> tuple[int, int]:
    """The minutes that lie wholly in the times from ``start_ms`` to before ``end_ms``."""
    return -(-start_ms // MINUTE_MS), end_ms // MINUTE_MS


def _usage_between(usage: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Usage rows of some short times (the end excluded); days prune partitions where they are stored."""
    spans = [(a, b) for a, b in spans if a < b]
    rows = usage.where(" or ".join(f"ts_ms between {a}L and {b - 1}L" for a, b in spans) or "false")
    if "ts_date" in usage.columns:
        days = sorted({d for a, b in spans for d in range(a // (1440 * MINUTE_MS), (b - 1) // (1440 * MINUTE_MS) + 1)})
        rows = rows.where(F.unix_date("ts_date").isin(days) if days else F.lit(False))
    return rows


def _merged(keys: list[str], whole: DataFrame, edges: DataFrame) -> DataFrame:
    names = [*keys, *ADDITIVE, "first_ts_ms", "last_ts_ms"]
    parts = whole.select(*names).unionByName(edges.groupBy(*keys).agg(*usage_measures()).select(*names))
    return parts.groupBy(*keys).agg(*merged_measures())


def range_from_cells(cells: DataFrame, usage: DataFrame, from_ms: int, to_ms: int, keys: list[str] | None = None) -> DataFrame:
    """``usage_agg`` of the rows in a span, both ends included, by any of the cells' keys."""
    keys = KEYS if keys is None else keys
    end_ms = to_ms + 1
    first, last = _whole_minutes(from_ms, end_ms)
    if first >= last:
        edges, spans = [(from_ms, end_ms)], []
    else:
        edges, spans = [(from_ms, first * MINUTE_MS), (last * MINUTE_MS, end_ms)], cover(first, last)
    whole = cells.where(" or ".join(f"level = {level} and cell between {a}L and {b - 1}L" for level, a, b in spans) or "false")
    return _merged(keys, whole, _usage_between(usage, edges)).withColumn("hit_rate", hit_rate())


def bucket_edges(span: Span) -> list[int]:
    """The first time of each bucket, and the time after the last."""
    n, length = max(span.buckets, 1), max(span.to_ms - span.from_ms, 1)
    return [*(span.from_ms - (-i * length // n) for i in range(n)), span.to_ms + 1]


def trend_from_cells(cells: DataFrame, usage: DataFrame, span: Span, by_model: bool = False, finest: int = 0) -> DataFrame:
    """The rows of ``bucketize`` (or ``bucketize_by_model``): the widest cells inside one bucket, and usage rows
    of the cells of level ``finest`` that a bucket's end cuts. Where a minute has few usage rows, a wider finest
    level reads less."""
    unit = MINUTE_MS << BITS * finest
    n, start, end = (F.lit(x).cast("bigint") for x in (max(span.buckets, 1), span.from_ms, span.to_ms))

    def bucket_of(cell: Column, width: Column) -> Column:
        """Bucket of a cell that lies inside one; NULL for others."""
        low, high = cell * width, cell * width + width - 1
        index = bucket_index(low, start, end, n)
        return F.when((low >= start) & (high <= end) & (index == bucket_index(high, start, end, n)), index)

    levels = []
    for level in range(finest, LEVELS):
        width = MINUTE_MS << BITS * level
        if width <= span.to_ms - span.from_ms + 1:
            levels.append(f"level = {level} and cell between {span.from_ms // width}L and {span.to_ms // width}L")
    own_width = F.call_function("shiftleft", F.lit(MINUTE_MS).cast("bigint"), F.col("level") * BITS)
    wider = F.call_function("shiftright", F.col("cell"), F.lit(BITS))
    taken_wider = bucket_of(wider, own_width * (1 << BITS)).isNotNull() & (F.col("level") < LEVELS - 1)
    whole = cells.where(" or ".join(levels) or "false").withColumn("bucket_idx", bucket_of(F.col("cell"), own_width))
    whole = whole.where(F.col("bucket_idx").isNotNull() & ~taken_wider)

    edges = bucket_edges(span)
    cuts = sorted({e // unit for e in edges if e % unit})
    parts = [(max(m * unit, span.from_ms), min((m + 1) * unit, span.to_ms + 1)) for m in cuts]
    rows = _usage_between(usage, parts).withColumn("bucket_idx", bucket_index(F.col("ts_ms"), start, end, n))
    keys = ["bucket_idx", "model"] if by_model else ["bucket_idx"]
    if by_model:
        groups = _merged(keys, whole, rows)
        levels_of = groups.withColumn("shown", F.explode(F.array(F.col("model"), F.lit(None).cast("string"))))
        merged = levels_of.groupBy("bucket_idx", F.col("shown").alias("model")).agg(*merged_measures())
    else:
        merged = _merged(keys, whole, rows)
    return _dense(bucket_spine(usage, span), merged, ["bucket_idx"])
