"""Response speed: time to first token and tokens per second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import caliber
from tallyforge.plans import quantiles as q
from tallyforge.plans.ranges import DAY_MS, explode_members, membership
from tallyforge.plans.staging import literal_rows, small_or_lazy

# Trailing windows compared on the speed card, and the change called flat.
SPEED_WINDOWS_MS = {"24h": DAY_MS, "7d": 7 * DAY_MS}
FLAT_BELOW = 0.03

SCALARS = [
    "ttft_avg_ms",
    "ttft_samples",
    "speed_tps",
    "speed_samples",
    "speed_approximate",
    "completed_requests",
    "generated_tokens",
    "generation_ms",
]


def _ranks() -> list[q.Rank]:
    return [
        q.nearest_rank("ttft_p50_ms", "ttft", 0.50),
        q.nearest_rank("ttft_p95_ms", "ttft", 0.95),
        *q.median_ranks("speed_p50", "tps"),
    ]


def _completed(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Per completed row: the two samples it may give and whether its window is approximate."""
    ms = caliber.generation_ms()
    return usage.where(caliber.is_completed()).select(
        *keys,
        caliber.ttft_sample().alias("ttft"),
        F.when(ms.isNotNull(), caliber.generated_tokens()).alias("generated"),
        ms.alias("gen_ms"),
        caliber.approximate_window().alias("approximate"),
    )


def _scalars():
    zero = F.lit(0).cast("bigint")
    generated, gen_ms = F.coalesce(F.sum("generated"), zero), F.coalesce(F.sum("gen_ms"), zero)
    return [
        F.avg("ttft").alias("ttft_avg_ms"),
        F.count("ttft").alias("ttft_samples"),
        F.try_divide(F.sum("generated") * F.lit(1000.0), F.sum("gen_ms")).alias("speed_tps"),
        F.count("gen_ms").alias("speed_samples"),
        F.coalesce(F.max("approximate"), F.lit(False)).alias("speed_approximate"),
        F.count(F.lit(1)).alias("completed_requests"),
        generated.alias("generated_tokens"),
        gen_ms.alias("generation_ms"),
    ]


def speed_totals(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The figures that need no ranks: one map-side combined aggregate."""
    keys = keys or []
    return _completed(usage, keys).groupBy(*keys).agg(*_scalars())


def _samples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: per completed row one counting entry plus up to two samples."""

    def entry(metric: str, value, weight, approximate):
        return F.struct(
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            weight.cast("bigint").alias("weight"),
            F.col("gen_ms").alias("ms"),
            approximate.alias("approximate"),
        )

    off = F.lit(False)
    entries = F.array(
        entry("row", F.lit(0), F.lit(0), F.col("approximate")),
        F.when(F.col("ttft").isNotNull(), entry("ttft", F.col("ttft"), F.col("ttft"), off)),
        F.when(
            F.col("gen_ms").isNotNull(),
            entry("tps", F.col("generated") * F.lit(1000.0) / F.col("gen_ms"), F.col("generated"), off),
        ),
    )
    long = rows.select(*keys, F.explode(entries).alias("s")).where(F.col("s").isNotNull())
    return long.select(*keys, "s.*", q.coarse_bucket(F.col("s.value")).alias("bucket"))


def speed_stats(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Averages, nearest-rank percentiles and the true median of per-request speed.

    Groups without a completed request have no row (without keys there is always one row). Two narrow
    scans: the first gives all sums and finds where the ranks lie, the second reads only those places.
    """
    keys = keys or []
    samples = _samples(_completed(usage, keys), keys)
    histogram = samples.groupBy(*keys, "metric", "bucket").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("weight").alias("weight"),
        F.sum("ms").alias("ms"),
        F.max("approximate").alias("approximate"),
    )
    zero = F.lit(0).cast("bigint")

    def total(metric: str, name: str):
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col(name))), zero)

    summary = (
        q.locate(histogram, keys, _ranks())
        .groupBy(*keys)
        .agg(
            total("ttft", "weight").alias("ttft_sum"),
            total("ttft", "c").alias("ttft_samples"),
            total("tps", "c").alias("speed_samples"),
            F.coalesce(F.max("approximate"), F.lit(False)).alias("speed_approximate"),
            total("row", "c").alias("completed_requests"),
            total("tps", "weight").alias("generated_tokens"),
            total("tps", "ms").alias("generation_ms"),
            F.flatten(F.collect_list("wanted")).alias("wanted"),
        )
    )
    summary, small = small_or_lazy(summary)
    targets = summary.select(*keys, F.explode("wanted").alias("w")).select(*keys, "w.*")
    picked = q.pick(samples.select(*keys, "metric", "bucket", "value"), targets, small, keys, _ranks())
    joined = summary.join(picked, keys, "left") if keys else summary.crossJoin(picked)
    return joined.select(
        *keys,
        F.try_divide(F.col("ttft_sum"), F.col("ttft_samples")).alias("ttft_avg_ms"),
        "ttft_samples",
        F.try_divide(F.col("generated_tokens") * F.lit(1000.0), F.col("generation_ms")).alias("speed_tps"),
        *SCALARS[3:],
        "ttft_p50_ms",
        "ttft_p95_ms",
        ((F.col("speed_p50_low") + F.col("speed_p50_high")) / 2).alias("speed_p50_tps"),
    )


def speed_by_model(usage: DataFrame) -> DataFrame:
    return speed_stats(usage, ["model"])


def speed_windows(usage: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Speed over the trailing 24 hours and 7 days of the full history; both rows always present."""
    keys = keys or []
    names = list(SPEED_WINDOWS_MS)
    inside = [F.col("ts_ms").between(now_ms - ms, now_ms) for ms in SPEED_WINDOWS_MS.values()]
    recent = usage.where(F.col("ts_ms").between(now_ms - max(SPEED_WINDOWS_MS.values()), now_ms))
    classes = (
        _completed(recent.withColumn("mask", membership(inside)), [*keys, "mask"])
        .groupBy(*keys, "mask")
        .agg(
            F.sum("generated").alias("generated"),
            F.sum("gen_ms").alias("gen_ms"),
            F.count("gen_ms").alias("samples"),
            F.max("approximate").alias("approximate"),
            F.count(F.lit(1)).alias("completed"),
        )
    )
    present = classes.select(
        *keys, explode_members(F.col("mask"), names).alias("window"), "generated", "gen_ms", "samples",
        "approximate", "completed",
    )
    spine = literal_rows(usage.sparkSession, [{"window": n, "window_ms": ms} for n, ms in SPEED_WINDOWS_MS.items()])
    spine = spine.withColumn("window_ms", F.col("window_ms").cast("bigint"))
    if keys:
        spine = usage.select(*keys).distinct().crossJoin(spine)
    zero = F.lit(0).cast("bigint")
    return (
        spine.join(present, [*keys, "window"], "left")
        .groupBy(*keys, "window", "window_ms")
        .agg(
            F.try_divide(F.sum("generated") * F.lit(1000.0), F.sum("gen_ms")).alias("speed_tps"),
            F.coalesce(F.sum("samples"), zero).alias("speed_samples"),
            F.coalesce(F.sum("completed"), zero).alias("completed_requests"),
            F.coalesce(F.max("approximate"), F.lit(False)).alias("speed_approximate"),
        )
    )


def speed_window_compare(usage: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """24-hour speed against 7-day speed. No delta while the 7-day window has no samples."""
    keys = keys or []

    def of(window: str, name: str):
        return F.max(F.when(F.col("window") == window, F.col(name)))

    wide = (
        speed_windows(usage, now_ms, keys)
        .groupBy(*keys)
        .agg(
            of("24h", "speed_tps").alias("speed_24h"),
            of("7d", "speed_tps").alias("speed_7d"),
            of("24h", "speed_samples").alias("samples_24h"),
            of("7d", "speed_samples").alias("samples_7d"),
        )
    )
    delta = F.try_divide(F.col("speed_24h") - F.col("speed_7d"), F.col("speed_7d"))
    return wide.withColumn("delta", F.when(F.col("samples_7d") > 0, delta)).withColumn(
        "direction",
        F.when(F.abs("delta") < FLAT_BELOW, "flat").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down"),
    )
