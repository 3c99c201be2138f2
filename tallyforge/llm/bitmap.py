"""A filter of fixed size that keeps rows without a partner out of a shuffle.

It may let strangers pass, never holds a partner back, and does not grow with the data; on very many keys it
passes everything and the join does the work.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_WORDS = 1 << 21  # of 64 bits that may be set before the filter is left out: 32 MB on the driver


def build(keys: DataFrame, column: str, bits: int) -> np.ndarray | None:
    """The bits named by the highest ``bits`` of each key; None if too many are set."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit: Column = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = words.limit(MOST_WORDS + 1).toArrow()
    if rows.num_rows > MOST_WORDS:
        return None
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys whose bit is set."""
    place = keys >> np.uint64(64 - (len(bitmap).bit_length() - 1 + 6))
    return np.flatnonzero((bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))


def spread(ids: np.ndarray) -> np.ndarray:
    return bytetext.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(bytetext.STEP))


def hashed_ids(ids: DataFrame) -> DataFrame:
    """``h``: the hash of each ``doc_id``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bytetext.signed(spread(batch.column(0).to_numpy())))], ["h"])

    return ids.mapInArrow(keys, "h long")


def split_by_ids(docs: DataFrame, ids: DataFrame, bits: int = 24, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` (and ``more`` columns) of the documents that may be among ``ids`` (a column ``doc_id``),
    and of those that are surely not. Join the first for the exact set; the second never needs a shuffle. Null
    ids are never among them."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *more)
    bitmap = build(hashed_ids(ids.select("doc_id")), "h", bits)
    if bitmap is None:
        return rows.where("doc_id is not null"), rows.where("doc_id is null")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def chosen(inside: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                numbers = batch.column(0).fill_null(0).to_numpy()
                among = np.zeros(batch.num_rows, bool)
                among[passes(shared.value, spread(numbers))] = True
                found = np.flatnonzero((among & known) == inside)
                if len(found):
                    yield batch.take(pa.array(found)) if len(found) < batch.num_rows else batch

        return rows.mapInArrow(choose, rows.schema)

    return chosen(True), chosen(False)


def rows_with_ids(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The first part of ``split_by_ids``."""
    return split_by_ids(docs, ids, bits)[0]


def rows_with_keys(rows: DataFrame, keys: DataFrame, column: str, bits: int, spread_out: bool = True) -> DataFrame:
    """``rows`` whose long ``column`` (never null) may be among that of ``keys``; join them for the exact set.
    Hashes are ``spread_out`` already, ids are not."""
    hashed = hashed_ids(keys.select(F.col(column).alias("doc_id"))) if not spread_out else keys.select(F.col(column).alias("h"))
    bitmap = build(hashed, "h", bits)
    if bitmap is None:
        return rows
    shared, place = rows.sparkSession.sparkContext.broadcast(bitmap), rows.columns.index(column)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(place).to_numpy()
            found = passes(shared.value, numbers.view(np.uint64) if spread_out else spread(numbers))
            if len(found):
                yield batch.take(pa.array(found))

    return rows.mapInArrow(choose, rows.schema)
