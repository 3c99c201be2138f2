"""Benchmark passages in documents, found by spaced seeds.

A seed is a fixed mask over consecutive words: the words at its zeros may be any. Equal seed hashes of a
benchmark item and a document give a hit; around the hit both are compared word by word on the hit's diagonal,
so that substituted words do not hide a passage.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, bytetext
from .storage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# At least one fits into every run of 12 words with at most 3 substitutions.
MASKS = ("1101101", "1110111", "11101011", "11111", "11100111", "101111", "1110000011")
MIN_WORDS = 12
MIN_SHARE = 0.75
FILTER_BITS = 27  # a filter of 16 MB, whatever the size of the benchmark


def seed_hashes(words: np.ndarray, firsts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of all places where ``mask`` fits into one text, and the number of the first word of each."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0], np.zeros(0, np.int64)
    value = np.full(n, int(mask, 2), np.uint64)
    for j, sign in enumerate(mask):
        if sign == "1":
            value = value * np.uint64(bytetext.COMBINE) + words[j : n + j]
    end = np.repeat(firsts[1:], np.diff(firsts))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= end)
    return bytetext.mix(value[at]), at


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...], min_words: int) -> tuple[DataFrame, DataFrame]:
    """Words of each item (``item_id, words``) and its seeds (``h, item_id, at``)."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed=6), bytetext.letters_and_digits()
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, wordy)
                words = bytetext.list_column(bytetext.signed(hasher.words(data, starts, ends)), firsts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], words], ["item_id", "words"])

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            firsts = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy().view(np.uint64)[firsts[0] : firsts[-1]]
            firsts -= firsts[0]
            text = np.repeat(np.arange(len(ids)), np.diff(firsts))
            for mask in masks:
                h, at = seed_hashes(words, firsts, mask)
                made = (bytetext.signed(h), ids[text[at]], (at - firsts[text[at]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["h", "item_id", "at"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    words = rows.mapInArrow(words_of, "item_id long, words array<long>").where(F.size("words") >= min_words)
    words = staged(words.dropDuplicates(), "benchmark-words")
    return words, staged(words.mapInArrow(seeds_of, "h long, item_id long, at int"), "benchmark-seeds")


def document_hits(docs: DataFrame, masks: tuple[str, ...], seen: np.ndarray | None) -> DataFrame:
    """``h, doc_id, place`` of the seeds in documents that pass the filter (all seeds without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(seen) if seen is not None else None

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed=6), bytetext.letters_and_digits()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, wordy)
                words = hasher.words(data, starts, ends)
                text = np.repeat(np.arange(end - row), np.diff(firsts))
                for mask in masks:
                    h, at = seed_hashes(words, firsts, mask)
                    if shared is not None:
                        ok = bitmap.passes(shared.value, h)
                        h, at = h[ok], at[ok]
                    if len(h):
                        made = (bytetext.signed(h), ids[row:end][text[at]], (at - firsts[text[at]]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["h", "doc_id", "place"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(hits, "h long, doc_id long, place int")


def best_stretch(equal: np.ndarray, min_share: float, min_words: int = 1) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with most weight among those of at least ``min_words``, where a match
    weighs ``1 - min_share`` and a difference ``-min_share``. A stretch has at least that share of matches if it
    weighs nothing or more; zeros if there is none."""
    if len(equal) < min_words:
        return 0, 0, 0
    weight = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - min_share, -min_share))])
    least = np.minimum.accumulate(weight)[: len(weight) - min_words]
    last = int(np.argmax(weight[min_words:] - least))
    end = last + min_words
    start = int(np.flatnonzero(weight[: last + 1] == least[last])[-1])
    same = int(equal[start:end].sum())
    return (start, end, same) if same / (end - start) >= min_share else (0, 0, 0)


RESULT = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_matched int, share double"


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per document and benchmark item that overlap: where in both, how many words, how many equal.

    An overlap is a stretch of at least ``min_words`` words on one diagonal of which ``min_share`` are equal;
    the one of most weight (``best_stretch``) is returned, of several diagonals that with most equal words. Words are runs of ASCII letters and digits and all signs outside ASCII, in lower
    case (A-Z). Items with fewer words never match, nor do null or empty texts or null ids. Rows with equal
    doc_id count as one document, repeated items as one. Other columns are not read. Empty tables: no rows.

    Seeds are joined by hash; a bitmap of fixed size drops seeds without a partner before. Hits are reduced to
    distinct (document, item, diagonal) before texts are joined, so a passage that a third of all documents
    holds adds rows in proportion to its occurrences only.
    """
    words, seeds = benchmark_seeds(items, masks, min_words)
    hits = document_hits(docs, masks, bitmap.build(seeds, "h", FILTER_BITS))
    diagonal = (F.col("place") - F.col("at")).alias("shift")
    candidates = hits.join(seeds, "h").select("doc_id", "item_id", diagonal).distinct()
    per_item = candidates.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")).join(words, "item_id")
    found = per_item.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("found"))
    names = [part.split()[0] for part in RESULT.split(", ")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed=6), bytetext.letters_and_digits()
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
        for batch in batches:
            out, ids, lists = [], batch.column(0).to_pylist(), batch.column(2)
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, wordy)
                hashed = hasher.words(data, starts, ends)
                for i in range(row, end):
                    text = hashed[firsts[i - row] : firsts[i - row + 1]]
                    for candidate in lists[i].as_py():
                        item = np.array(candidate["words"], np.int64).view(np.uint64)
                        best = (0, 0, 0, 0, 0.0)
                        for shift in sorted(candidate["shifts"]):
                            low, high = max(0, -shift), min(len(item), len(text) - shift)
                            if high - low < min_words:
                                continue
                            a, b, same = best_stretch(item[low:high] == text[low + shift : high + shift], min_share, min_words)
                            if same > best[3]:
                                best = (low + a + shift, low + a, b - a, same, same / (b - a))
                        if best[3]:
                            out.append((ids[i], candidate["item_id"], *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    found = staged(found, "benchmark-found")
    texts = bitmap.rows_with_ids(docs, found.select("doc_id")).join(found, "doc_id").select("doc_id", "text", "found")
    verified = texts.mapInArrow(verify, RESULT)
    best = F.max(F.struct("n_matched", *[n for n in names[2:] if n != "n_matched"])).alias("best")
    return verified.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"best.{n}" for n in names[2:]])
