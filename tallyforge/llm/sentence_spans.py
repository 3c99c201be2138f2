"""Removing passages that repeat, sentence by sentence.

Every run of several consecutive sentences is hashed; runs are joined over all documents, and the sentences
covered by any but the first occurrence of a repeated run go.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, bytetext
from .storage import row_key, short_batches, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCES = 3
WORDS = 12
FILTER_BITS = 27

# What ends a sentence, and what may follow an end. Clauses count as sentences, so that a passage pasted into
# the middle of a sentence still has whole ones of its own.
ENDS, AFTER = b".!?\n,;:", b".!?\n,;: \t\r"


def sentence_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence starts (in bytes, one more at the end), and each text's first sentence.

    A sentence reaches to the last of the end signs and blanks that follow it; the sentences of a text
    make up the whole text.
    """
    n = len(data)
    is_end, is_tail = np.zeros(256, bool), np.zeros(256, bool)
    is_end[list(ENDS)] = is_tail[list(AFTER)] = True
    at = np.arange(n)
    tail = is_tail[data]
    last_end = np.maximum.accumulate(np.where(is_end[data], at, -1)) if n else at
    last_other = np.maximum.accumulate(np.where(tail, -1, at)) if n else at
    start = np.zeros(n, bool)
    text_start = np.repeat(bounds[:-1], np.diff(bounds))
    start[1:] = ~tail[1:] & tail[:-1] & (last_end[:-1] > last_other[:-1]) & (last_end[:-1] >= text_start[1:])
    filled = bounds[:-1][np.diff(bounds) > 0]
    start[filled] = True
    starts = np.flatnonzero(start)
    return np.append(starts, n), np.searchsorted(starts, bounds)


def sentence_hashes(hasher: bytetext.Hasher, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each sentence without the blanks around it."""
    blank = ~bytetext.not_blank()[data]
    at = np.arange(len(data))
    next_word = np.minimum.accumulate(np.where(blank, len(data), at)[::-1])[::-1]
    last_word = np.maximum.accumulate(np.where(blank, -1, at))
    first = np.minimum(next_word[starts[:-1]], starts[1:])
    end = np.maximum(last_word[starts[1:] - 1] + 1, first)
    return hasher.words(data, first, end)


def runs_of(words_before: np.ndarray, firsts: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and the one after the last of every run.

    A run starts at a sentence and is the shortest with at least ``sentences`` sentences and ``words`` words,
    or ends at a sentence and is the shortest such run. So any repeated stretch of that size is covered whole
    by repeated runs.
    """
    n = len(words_before) - 1
    counts = np.diff(firsts)
    low, high = np.repeat(firsts[:-1], counts), np.repeat(firsts[1:], counts)
    at = np.arange(n)
    end = np.maximum(np.searchsorted(words_before, words_before[:-1] + words, "left"), at + sentences)
    ok = end <= high
    a, b = at[ok], end[ok]
    begin = np.minimum(np.searchsorted(words_before, words_before[1:] - words, "right") - 1, at + 1 - sentences)
    ok = begin >= low
    pairs = np.unique(np.concatenate([a * (n + 1) + b, begin[ok] * (n + 1) + at[ok] + 1]))
    return pairs // (n + 1), pairs % (n + 1)


def sentence_runs(docs: DataFrame, sentences: int, words: int, known: np.ndarray | None = None) -> DataFrame:
    """``h1, h2, key, doc_id, first, last`` of every run (two hashes of 64 bits name a run's sentences, ``key`` its
    row), or of those whose ``h1`` passes a filter."""
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None
    names = ["h1", "h2", "key", "doc_id", "first", "last"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed=10), bytetext.not_blank()
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1)
            for row, end, data, bounds in bytetext.pieces(batch.column(2)):
                starts, firsts = sentence_bounds(data, bounds)
                if len(starts) < 2:
                    continue
                word_starts, _, _ = bytetext.word_bounds(data, bounds, wordy)
                before = np.searchsorted(word_starts, starts)
                a, b = runs_of(before, firsts, sentences, words)
                if not len(a):
                    continue
                whole = sentence_hashes(hasher, data, starts)
                text = np.repeat(np.arange(end - row), np.diff(firsts))[a]
                made = []
                for base in (bytetext.BASE, bytetext.COMBINE | 5):
                    up, down = bytetext.powers(base, len(whole)), bytetext.powers(pow(base, -1, 1 << 64), len(whole))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole * up)])
                    made.append(bytetext.signed(bytetext.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))))
                places = [(x - firsts[text]).astype(np.int32) for x in (a, b - 1)]
                if shared is not None:
                    passed = bitmap.passes(shared.value, made[0].view(np.uint64))
                    text, made, places = text[passed], [x[passed] for x in made], [x[passed] for x in places]
                named = [pa.array(keys[row:end][text]), ids.take(pa.array(row + text))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), *named, *map(pa.array, places)], names)

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(runs, "h1 long, h2 long, key long, doc_id long, first int, last int")


def repeated_runs(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """Runs that occur before, as ``key, first, last``: all but the first by document and place.

    First only the names of runs are counted, combined before their shuffle, so a run found in a third of all
    documents is no hot group. Runs are then made again and those without a repeated name are dropped by a
    filter of fixed size; the join that settles the rest is left to adaptive execution, which splits large
    partitions.
    """
    counts = sentence_runs(docs, sentences, words).groupBy("h1").agg(F.count("*").alias("n"))
    names = staged(counts.where("n > 1").select("h1"), "sentence-names")
    runs = sentence_runs(docs, sentences, words, bitmap.build(names, "h1", FILTER_BITS))
    runs = staged(runs.join(names, "h1", "left_semi"), "sentence-runs")
    place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "key", "first")
    known = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n")
    known = staged(known, "sentence-origins")  # read by its own shuffle, so that the join can split hot runs
    again = runs.join(known, ["h1", "h2"]).where(place != F.col("origin"))
    return again.select("key", "first", "last")


RESULT = "doc_id long, n_sentences int, n_removed int, removed array<int>, kept_text string, kept_sha256 string"


def remove_repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """One row per document: its sentences, those removed (numbers from 0) and the text that is left.

    A run has at least ``sentences`` sentences and ``words`` words. The first occurrence is the one with the
    smallest (doc_id, place), null ids last, so a passage stays once in the corpus. Sentences compare without the
    blanks around them. Empty or null text: no sentences, kept text empty. Rows with one doc_id and different
    texts are judged each for itself, in an order by their texts' hashes; rows equal in doc_id and text count as
    one and share their result. Empty table: no rows. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    gone = repeated_runs(docs, sentences, words).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = staged(gone.withColumnRenamed("key", "doc_id"), "sentence-gone")
    names = [part.split()[0] for part in RESULT.split(", ")]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]
        for batch in batches:
            ids, spans = batch.column(0).to_pylist(), batch.column(2)
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                rows = []
                starts, firsts = sentence_bounds(data, bounds)
                for i in range(row, end):
                    a, b = int(firsts[i - row]), int(firsts[i - row + 1])
                    covered = np.zeros(b - a + 1, np.int64)
                    for span in spans[i].as_py() or ():
                        if span["last"] < b - a:
                            covered[span["first"]] += 1
                            covered[span["last"] + 1] -= 1
                    out = np.flatnonzero(np.cumsum(covered)[: b - a])
                    whole = data[bounds[i - row] : bounds[i - row + 1]].tobytes()
                    if len(out):
                        edges = starts[a : b + 1] - bounds[i - row]
                        edges[-1] = len(whole)
                        whole = b"".join(whole[edges[k] : edges[k + 1]] for k in np.setdiff1d(np.arange(b - a), out))
                    rows.append((ids[i], b - a, len(out), out, whole.decode(), hashlib.sha256(whole).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    keyed = docs.select(row_key().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own_id"))
    affected, others = bitmap.split_by_ids(keyed, gone.select("doc_id"), more=("own_id",))
    joined = affected.join(gone, "doc_id", "left").select("own_id", "text", "gone")
    unharmed = others.select("own_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    return joined.unionByName(unharmed).mapInArrow(remove, RESULT)
