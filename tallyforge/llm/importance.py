"""Resampling documents toward a target distribution by the importance of their hashed word features.

Texts are handled batch by batch: one string of all texts with a separator between them, one regex pass for its
words, their documents by binary search in the texts' offsets. Features that would span two texts are masked.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .storage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
NGRAM_WORDS = 2
SEED = 7
SCALE = 1000  # gains, weights and scores are integers, in thousandths
LEAST_WORDS = 20
PERCENT = 25
SEPARATOR = b"\x00"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in lower case; all characters outside ASCII belong to words
PIECE_BYTES = 1 << 19
LONG_WORD = 64  # bytes; longer words are few, each is finished by itself
SCORE_BIN = 256


def crc_table() -> np.ndarray:
    """The byte table of the usual reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


class Features:
    """Buckets of all runs of 1 to ``ngram_words`` words of a batch's texts."""

    def __init__(self, ngram_words: int = NGRAM_WORDS, buckets: int = BUCKETS):
        self.ngram_words, self.buckets, self.table = ngram_words, np.uint32(buckets), crc_table()

    def _fed(self, register: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.table[(register ^ byte) & np.uint32(0xFF)] ^ (register >> np.uint32(8))

    def _words_fed(self, register: np.ndarray, joined: bytes, data: np.ndarray, starts: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC register after its word; all words advance together, byte by byte, the longest first."""
        falling, first, out = -lengths[order], starts[order], register[order]
        for k in range(min(LONG_WORD, int(lengths.max(initial=0)))):
            live = int(np.searchsorted(falling, -k, "left"))
            out[:live] = self._fed(out[:live], data[first[:live] + k])
        for i in range(int(np.searchsorted(falling, -LONG_WORD, "left"))):
            rest = memoryview(joined)[first[i] + LONG_WORD : first[i] - falling[i]]
            out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        fed = np.empty_like(out)
        fed[order] = out
        return fed

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text number and bucket of every feature, one pair of arrays for each length of run; the first pair
        has one entry per word."""
        joined = SEPARATOR.join(texts).lower()
        offsets = np.concatenate([[0], np.cumsum([len(t) + len(SEPARATOR) for t in texts])[:-1]]).astype(np.int64)
        spans = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(joined))), np.int64)
        starts, lengths = spans[::2], spans[1::2] - spans[::2]
        text = np.searchsorted(offsets, starts, "right") - 1
        data = np.frombuffer(joined, np.uint8).astype(np.uint32)
        order = np.argsort(-lengths, kind="stable")
        register = self._words_fed(np.full(len(starts), 0xFFFFFFFF, np.uint32), joined, data, starts, order, lengths)
        yield text, (register ^ np.uint32(0xFFFFFFFF)) % self.buckets
        for n in range(2, self.ngram_words + 1):
            # the run that ends at word i goes on with a space and word i + 1
            spaced = self._fed(np.concatenate([np.full(1, 0xFFFFFFFF, np.uint32), register[:-1]]), np.uint32(32))
            register = self._words_fed(spaced, joined, data, starts, order, lengths)
            inside = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) + n - 1
            yield text[inside], (register[inside] ^ np.uint32(0xFFFFFFFF)) % self.buckets


def batch_texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for row, end, data, bounds in bytetext.pieces(column, PIECE_BYTES):
        raw = data.tobytes()
        yield row, end, [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def bucket_counts(rows: DataFrame, ngram_words: int = NGRAM_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds its texts up and hands on one row per
    bucket; the driver gets ``buckets`` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(ngram_words, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in batch_texts(batch.column(0)):
                for _, found in features.of(texts):
                    sums += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(sums[filled])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed target and source shares of each bucket, in thousandths, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, ngram_words: int = NGRAM_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row: the mean gain of its features, rounded down."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(ngram_words, len(gains))
        for batch in batches:
            for row, end, texts in batch_texts(batch.column(1)):
                words, total, gained = None, np.zeros(end - row, np.int64), np.zeros(end - row, np.int64)
                for text, bucket in features.of(texts):
                    n = np.bincount(text, minlength=end - row)
                    words = n if words is None else words
                    upto = np.concatenate([[0], np.cumsum(gains[bucket])])
                    last = np.cumsum(n)
                    gained += upto[last] - upto[last - n]
                    total += n
                weight = gained // np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], *map(pa.array, (words, total, weight))], names)

    names = ["doc_id", "n_words", "n_features", "weight"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def with_ranks(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Number the drawn rows of ``scored`` (a staged frame) from the highest score on.

    Scores are whole numbers: rows are counted per score, counts are summed up inside bins of scores and over
    the bins (a few hundred, whatever the table's size), and only rows of one score are put in order together.
    """
    candidates = F.col("n_words") >= least_words
    counts = scored.where(candidates).groupBy("score").agg(F.count("*").alias("n"))
    counts = staged(counts.withColumn("bin", F.floor(F.col("score") / F.lit(SCORE_BIN))), "importance-scores")
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    above = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("n").over(above().orderBy(F.desc("bin"))), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    inside = F.coalesce(F.sum("n").over(above("bin").orderBy(F.desc("score"))), F.lit(0))
    starts = counts.withColumn("inside", inside).join(bins, "bin")
    starts = starts.select(F.col("score").alias("s"), (F.col("before") + F.col("inside")).alias("start"), F.floor(F.col("all") * percent / 100).alias("drawn"))
    starts = starts.where("start < drawn")
    joined = scored.join(starts, (F.col("score") == F.col("s")) & candidates, "left")
    place = F.col("start") + F.row_number().over(Window.partitionBy("score", F.col("start").isNull()).orderBy("doc_id"))
    return joined.withColumn("rank", F.when(place <= F.col("drawn"), place).cast("long")).drop("s", "start", "drawn")


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    ngram_words: int = NGRAM_WORDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document.

    Features are all runs of 1 to ``ngram_words`` words, named by CRC-32 modulo ``buckets``. A bucket's gain is
    the log ratio of its share in ``target`` (column ``text``) and in ``docs``; a document's weight is the mean
    gain of its features. The score adds a Gumbel number drawn from the seed and the doc_id, so that the highest
    scores are a draw without replacement in proportion to exp(weight / 1000). Of the documents with at least
    ``least_words`` words, ``percent`` in a hundred are drawn and numbered.

    Null or empty text: no features, weight 0, never drawn while ``least_words`` is above 0. A null doc_id draws
    by the empty name and comes first among ties. Repeated rows are rows of their own; which of equal rows gets
    which number does not show. An empty target gives gains by the source alone; an empty table no rows. Other
    columns are not read. The two passes over the texts need no shuffle of them.
    """
    gains = bucket_gains(bucket_counts(docs, ngram_words, buckets), bucket_counts(target, ngram_words, buckets))
    weighed = importance_weights(docs, gains, ngram_words)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
    return with_ranks(staged(scored, "importance"), percent, least_words)
