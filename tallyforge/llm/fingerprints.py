"""Document fingerprints: MinHash of word shingles with many universal hash functions."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext, near_links
from .storage import only_kept, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
FUNCTIONS = 64  # of the fingerprint; its likeness has a standard error of at most 1/16
LINK_FUNCTIONS = 128
ROWS = 4
PERCENT = 80
SEED = 7
CHUNK_ROWS = 512  # documents of a range, while there are fewer than MOST_CHUNKS ranges
MOST_CHUNKS = 20_000
NO_ID = -(1 << 63)  # stands for a null doc_id inside, below all others


def universal_signature(sets: np.ndarray, firsts: np.ndarray, functions: int = LINK_FUNCTIONS) -> np.ndarray:
    """For each set the least value of each hash function ``(a * x + b) mod 2**64 >> 32`` with odd ``a``, a
    universal family; ``firsts`` are where the sets start, none of them empty."""
    seeds = bytetext.mix((np.arange(2 * functions, dtype=np.uint64) + np.uint64(1)) * np.uint64(bytetext.STEP))
    out = np.empty((len(firsts), functions), np.uint32)
    if len(firsts):
        for k in range(functions):
            value = sets * (seeds[2 * k] | np.uint64(1))
            value += seeds[2 * k + 1]
            out[:, k] = np.minimum.reduceat(value, firsts) >> np.uint64(32)
    return out


class Fingerprinter:
    """Fingerprints of whole texts, as bytes: two for each function. Texts without words all have the same."""

    def __init__(self, shingle_words: int = SHINGLE_WORDS, functions: int = FUNCTIONS):
        self.shingle_words, self.functions = shingle_words, functions
        self.hasher, self.wordy = bytetext.Hasher(SEED), bytetext.not_blank()

    def of(self, column: pa.Array) -> np.ndarray:
        """One row of 16-bit values per text."""
        out = np.full((len(column), self.functions), 0xFFFF, ">u2")
        for row, end, data, bounds in bytetext.pieces(column):
            starts, ends, firsts = bytetext.word_bounds(data, bounds, self.wordy)
            runs, firsts = bytetext.shingles(self.hasher.words(data, starts, ends), firsts, self.shingle_words)
            filled = np.flatnonzero(np.diff(firsts))
            least = universal_signature(runs, firsts[:-1][filled], self.functions)
            out[row:end][filled] = least & np.uint32(0xFFFF)
        return out


def as_binary(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes() for p in prints], pa.binary())


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal values, an estimate of the Jaccard likeness of the shingle sets."""
    return (left == right).mean(axis=1)


def fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """``doc_id, fingerprint`` (hex) of every row; null text is empty."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle_words, functions)
        for batch in batches:
            hexes = pa.array([p.tobytes().hex() for p in maker.of(batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), hexes], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fingerprint string")


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: signature bands joined, likeness verified on full shingle sets.

    Texts without words are linked with nothing; a null doc_id has a null component.
    """
    prints = staged(near_links.shingle_prints(docs, shingle_words, "not_blank", universal_signature, ROWS, SEED), "fingerprints")

    def sets_of(ids: DataFrame) -> DataFrame:
        return near_links.shingle_sets(docs, ids, shingle_words, "not_blank", SEED)

    return near_links.near_components(prints, sets_of, percent)


def range_tops(ids: DataFrame, chunk_rows: int = CHUNK_ROWS, most: int = MOST_CHUNKS) -> np.ndarray:
    """Ids that cut the order of ids into ranges of about ``chunk_rows`` rows: the largest id of each range,
    ascending. There are at most ``most`` of them, whatever the table's size."""
    n = ids.count()
    if not n:
        return np.zeros(0, np.int64)
    ranges = max(1, min(most, -(-n // chunk_rows)))
    shares = [(i + 1) / ranges for i in range(ranges)]
    row = ids.agg(F.percentile_approx("doc_id", shares, ranges * 10).alias("tops"), F.max("doc_id").alias("last")).first()
    return np.unique(np.array([*row["tops"], row["last"]], np.int64))


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_edited(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, functions: int = FUNCTIONS, parts: DataFrame | None = None
) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, in descending order of doc_id; the first follows the last.

    Ids are cut into ranges at quantiles (bounded in number). Every text is shuffled once, to its range; the
    largest document of a range also visits the range above, where it is the next of the smallest. Within a
    range rows stream past in order and only one document waits for its next.

    Null text is empty. Of rows with equal doc_id the smallest text is what the document before takes; each
    row is returned. Rows with a null doc_id are one document with several texts, which comes last, below all
    ids. Empty table: no rows. A single document is its own next. Other columns are not read.

    With ``parts`` (``doc_id, component_id``, one row for each id) rows have that ``component_id`` too, null
    where there is none. Parts travel in the shuffle of the texts, each just before its document.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tops = range_tops(rows.select("doc_id"))
    names = ["range", "visits", "doc_id", "text", "print", "component"]
    shape = "range long, visits boolean, doc_id long, text string, print binary, component long"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle_words, functions)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            prints = as_binary(maker.of(batch.column(1)))
            at = np.searchsorted(tops, ids)
            is_top = np.flatnonzero(tops[at] == ids)
            own = [pa.array(at), pa.array(np.zeros(len(ids), bool)), *batch.columns, prints, pa.nulls(len(ids), pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names)
            visit = [c.take(pa.array(is_top)) for c in (*batch.columns, prints)] + [pa.nulls(len(is_top), pa.int64())]
            above = (at[is_top] + 1) % len(tops)
            yield pa.RecordBatch.from_arrays([pa.array(above), pa.array(np.ones(len(is_top), bool)), *visit], names)

    def part_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = len(batch), np.searchsorted(tops, batch.column(0).to_numpy())
            empty = [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
            columns = [pa.array(at), pa.array(np.zeros(n, bool)), batch.column(0), *empty, batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    printed = rows.mapInArrow(first_pass, shape)
    if parts is not None:  # a null text sorts before the texts of its document
        printed = printed.unionByName(parts.select("doc_id", "component_id").where("doc_id is not null").mapInArrow(part_pass, shape))
    ordered = printed.repartition("range").sortWithinPartitions("range", "visits", F.desc("doc_id"), "text")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle_words, functions)
        columns = [part.split()[0] for part in result.split(", ")]
        of_id, component = None, None
        waiting: list[tuple] = []  # rows of one document that wait for the next document
        for batch in batches:
            ready: list[tuple] = []
            for at, visits, doc_id, text, own, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    of_id, component = doc_id, part
                    continue
                if waiting and (waiting[0][:2] != (at, doc_id) or visits):
                    if waiting[0][0] == at:
                        ready += [(*w[1:4], text, own, w[4]) for w in waiting]
                    waiting = []
                if not visits:
                    waiting.append((at, doc_id, text, own, component if of_id == doc_id else None))
            if not ready:
                continue
            edited = []
            for _, text, _, following, *_ in ready:
                half = len(text) // 2
                edited.append(text[: len(text) - half] + following[:half])
            mine, theirs = (np.array([np.frombuffer(r[i], ">u2") for r in ready]) for i in (2, 4))
            changed = maker.of(pa.array(edited, pa.string()))
            made = [
                pa.array([r[0] for r in ready], pa.int64()),
                pa.array([len(r[1]) for r in ready], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([r[2].hex() for r in ready]),
                pa.array([c.tobytes().hex() for c in changed]),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, theirs)),
                pa.array([r[5] for r in ready], pa.int64()),
            ][: len(columns)]
            yield pa.RecordBatch.from_arrays(made, columns)

    result = RESULT if parts is None else f"{RESULT}, component_id long"
    compared = ordered.mapInArrow(second_pass, result)
    return compared.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def with_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``compare_edited`` with the ``component_id`` of ``near_copies``; rows with equal doc_id share the
    smallest of theirs, null ids have none."""
    with only_kept() as keep:
        parts = near_copies(docs, shingle_words, percent).where("doc_id is not null")
        parts = keep(staged(parts.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "fingerprint-components"))
    return compare_edited(docs, shingle_words, parts=parts)
