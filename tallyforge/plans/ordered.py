"""Running values along an order, for keys of any size.

A plain window per key puts the whole key into one task. Here the order is cut into chunks (a file block, a
stretch of line numbers, an hour); windows run inside ``(key, chunk)``, and what a chunk must know about
earlier ones comes from a window over chunk summaries, of which there is one per key and chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Last:
    """Latest non-NULL value; ``inclusive=False`` looks only at earlier rows."""

    out: str
    value: Column
    inclusive: bool = True

    def summary(self, order: Column) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def carried(self, earlier) -> Column:
        return F.last(F.col(self.out), ignorenulls=True).over(earlier)

    def inside(self, upto, before) -> Column:
        return F.last(self.value, ignorenulls=True).over(upto if self.inclusive else before)

    def combined(self, inside: Column, carried: Column) -> Column:
        return F.coalesce(inside, carried)

    def final(self, summary: Column, carried: Column) -> Column:
        return F.coalesce(summary, carried)


@dataclass(frozen=True)
class First:
    """Earliest non-NULL value seen so far."""

    out: str
    value: Column

    def summary(self, order: Column) -> Column:
        return F.min_by(self.value, F.when(self.value.isNotNull(), order))

    def carried(self, earlier) -> Column:
        return F.first(F.col(self.out), ignorenulls=True).over(earlier)

    def inside(self, upto, before) -> Column:
        return F.first(self.value, ignorenulls=True).over(upto)

    def combined(self, inside: Column, carried: Column) -> Column:
        return F.coalesce(carried, inside)

    def final(self, summary: Column, carried: Column) -> Column:
        return F.coalesce(carried, summary)


@dataclass(frozen=True)
class Count:
    """How many rows met a condition so far."""

    out: str
    condition: Column
    inclusive: bool = True

    def _ones(self) -> Column:
        return F.when(self.condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def summary(self, order: Column) -> Column:
        return F.sum(self._ones())

    def carried(self, earlier) -> Column:
        return F.sum(F.col(self.out)).over(earlier)

    def inside(self, upto, before) -> Column:
        return F.sum(self._ones()).over(upto if self.inclusive else before)

    def combined(self, inside: Column, carried: Column) -> Column:
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))

    final = combined


@dataclass(frozen=True)
class Max:
    """Highest value of the rows before this one."""

    out: str
    value: Column

    def summary(self, order: Column) -> Column:
        return F.max(self.value)

    def carried(self, earlier) -> Column:
        return F.max(F.col(self.out)).over(earlier)

    def inside(self, upto, before) -> Column:
        return F.max(self.value).over(before)

    def combined(self, inside: Column, carried: Column) -> Column:
        return F.greatest(inside, carried)

    final = combined


def chunk_summaries(df: DataFrame, keys: list[str], chunk: str, order: list[str], specs: list) -> DataFrame:
    """One row per key and chunk: each spec folded over the chunk's own rows (map-side combined)."""
    position = F.struct(*order)
    return df.groupBy(*keys, chunk).agg(*[s.summary(position).alias(s.out) for s in specs])


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    specs: list,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add one column per spec. ``chunk`` must never decrease along ``order`` within a key.

    ``initial`` holds values from before the first chunk: the keys and one column per spec.
    """
    summaries = chunk_summaries(df, keys, chunk, order, specs)
    if initial is not None:
        first = initial.select(*keys, F.lit(-1).cast("bigint").alias(chunk), *[s.out for s in specs])
        summaries = summaries.withColumn(chunk, F.col(chunk).cast("bigint")).unionByName(first)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summaries.select(*keys, chunk, *[s.carried(earlier).alias(f"carry_{s.out}") for s in specs])
    own = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carry, [*keys, chunk])
    placed = joined.select(
        *df.columns,
        *[f"carry_{s.out}" for s in specs],
        *[s.inside(upto, before).alias(f"inside_{s.out}") for s in specs],
    )
    return placed.select(
        *df.columns,
        *[s.combined(F.col(f"inside_{s.out}"), F.col(f"carry_{s.out}")).alias(s.out) for s in specs],
    )


def final_values(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], specs: list, initial: DataFrame | None = None
) -> DataFrame:
    """Values after the last row of each key: the ``initial`` of a later batch."""
    summaries = chunk_summaries(df, keys, chunk, order, specs)
    folds = [
        _merge(s, F.col(s.out), F.col(chunk)).alias(s.out) for s in specs
    ]
    ended = summaries.groupBy(*keys).agg(*folds)
    if initial is None:
        return ended
    before = initial.select(*keys, *[F.col(s.out).alias(f"carry_{s.out}") for s in specs])
    return ended.join(before, keys, "full").select(
        *keys, *[s.final(F.col(s.out), F.col(f"carry_{s.out}")).alias(s.out) for s in specs]
    )


def _merge(spec, value: Column, chunk: Column) -> Column:
    if isinstance(spec, Count):
        return F.sum(value)
    if isinstance(spec, Max):
        return F.max(value)
    by = F.min_by if isinstance(spec, First) else F.max_by
    return by(value, F.when(value.isNotNull(), chunk))
