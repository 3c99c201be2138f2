"""Exact order statistics per group without bringing a group's values into one task.

Spark's exact percentile aggregate keeps every distinct value of a group in one buffer. A model with a
third of all rows would not fit, so ranks are found by narrowing down:

1. one pass counts values per coarse bucket (map-side combined; the number of buckets is bounded by the
   range of a double, not by the data);
2. the buckets holding the wanted ranks are found from those counts;
3. a second pass keeps only values in these buckets, counts equal values, narrows once more inside the
   bucket and reads off the value.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Coarse buckets per factor e, and slices of one coarse bucket.
COARSE = 512
FINE = 4096


class Rank(NamedTuple):
    """Output column, the metric it is taken from, and the 1-based rank as an expression of ``n``."""

    name: str
    metric: str
    rank: Column


def nearest_rank(name: str, metric: str, fraction: float) -> Rank:
    n = F.col("n")
    return Rank(name, metric, F.least(F.greatest(F.ceil(n * F.lit(fraction)), F.lit(1)), n).cast("bigint"))


def median_ranks(name: str, metric: str) -> list[Rank]:
    """The two middle ranks (equal for an odd count)."""
    n = F.col("n")
    return [
        Rank(f"{name}_low", metric, F.expr("(n + 1) div 2")),
        Rank(f"{name}_high", metric, F.expr("n div 2 + 1")),
    ]


def coarse_bucket(value: Column) -> Column:
    """Bucket number, never decreasing in ``value``; defined for any sign."""
    up = F.floor(F.ln(value) * COARSE)
    down = -F.floor(F.ln(-value) * COARSE) - F.lit(2_000_000)
    return F.when(value > 0, up).when(value == 0, F.lit(-1_000_000)).otherwise(down).cast("bigint")


def _fine_bucket(value: Column, bucket: Column) -> Column:
    """Slice inside a coarse bucket, never decreasing in ``value``."""
    magnitude = F.when(value > 0, value / F.exp(bucket / F.lit(float(COARSE)))).otherwise(value)
    return F.floor((magnitude - 1) * F.lit(float(COARSE * FINE))).cast("bigint")


def locate(histogram: DataFrame, keys: list[str], ranks: list[Rank]) -> DataFrame:
    """Add to each histogram row the list of ranks that fall into its bucket.

    ``histogram`` has keys, ``metric``, ``bucket`` and ``c``; one row per non-empty bucket, so the windows
    are bounded by the number of buckets. ``wanted`` is NULL where no rank falls in.
    """
    group = [*keys, "metric"]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("below", F.coalesce(F.sum("c").over(running), F.lit(0))).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*group))
    )
    hits = [
        F.when(
            (F.col("metric") == r.metric)
            & (r.rank > F.col("below"))
            & (r.rank <= F.col("below") + F.col("c")),
            F.struct("metric", "bucket", F.lit(r.name).alias("name"), (r.rank - F.col("below")).alias("rank")),
        )
        for r in ranks
    ]
    wanted = F.array_compact(F.array(*hits))
    return placed.withColumn("wanted", F.when(F.size(wanted) > 0, wanted))


def pick(samples: DataFrame, targets: DataFrame, small: bool, keys: list[str], ranks: list[Rank]) -> DataFrame:
    """Read the values off. ``samples`` has keys, ``metric``, ``bucket``, ``value``; one row per sample.
    ``targets`` has keys, ``metric``, ``bucket``, ``name``, ``rank``; ``small`` says it was size-checked."""
    where = [*keys, "metric", "bucket"]
    if small:
        targets = F.broadcast(targets)
        samples = samples.withColumn("c", F.lit(1).cast("bigint"))
    else:
        # Too many groups to broadcast: shrink equal samples before the shuffle join.
        samples = samples.groupBy(*where, "value").agg(F.count(F.lit(1)).alias("c"))
    group = [*keys, "name"]
    counted = (
        samples.join(targets, where)
        .groupBy(*group, "rank", "bucket", "value")
        .agg(F.sum("c").alias("c"))
        .withColumn("fine", _fine_bucket(F.col("value"), F.col("bucket")))
        .repartition(*group, "fine")
    )
    slices = counted.groupBy(*group, "rank", "fine").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(*group).orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        slices.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("c")))
        .select(*group, "fine", "below")
    )
    upto = Window.partitionBy(*group, "fine").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counted.join(chosen, [*group, "fine"])
        .withColumn("through", F.col("below") + F.sum("c").over(upto))
        .where((F.col("rank") <= F.col("through")) & (F.col("rank") > F.col("through") - F.col("c")))
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == r.name, F.col("value"))).alias(r.name) for r in ranks]
    )
