"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

All grades share one weight per feature; ordered thresholds turn the weighted sum into P(grade > k), and the
expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .storage import discard, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 5_000  # labelled documents of each class that the model is fitted on, at most
FEATURES = 4_000  # weights of the model, at most
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features beside the word
GRADE_CUTS = (4, 8)  # telling features (words and beginnings) up to which a toxic document has grade 1, 2; more is grade 3
LEAST_Z = 3.0  # standard errors by which a feature must differ between the classes
TELLING_ODDS = 8.0  # a feature is telling if it is so many times as frequent in toxic documents
PENALTY = 1e-4
REJECT_OVER = 0.25  # P(grade > 0) over which a document is rejected


@dataclass
class SeverityModel:
    hashes: np.ndarray  # features, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one column per threshold."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features_of(hasher: bytetext.Hasher, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, the text of each, and each text's number of words."""
    starts, ends, firsts = bytetext.word_bounds(data, bounds, bytetext.letters_and_digits())
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    sums = hasher.sums(data)
    hashes, texts = [hasher.spans(sums, starts, ends)], [text]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        begun = hasher.spans(sums, starts[longer], starts[longer] + size)
        hashes.append(bytetext.mix(begun + np.uint64(size)))
        texts.append(text[longer])
    return np.concatenate(hashes), np.concatenate(texts), counts


def present(hashes: np.ndarray, texts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which known features each text has: (text, feature number, occurrences)."""
    place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    ok = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
    pairs, n = np.unique(texts[ok] * max(len(known), 1) + place[ok], return_counts=True)
    return pairs // max(len(known), 1), pairs % max(len(known), 1), n


def fit_ordinal(rows, columns, grades, weights, n_features: int, n_grades: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the penalised proportional-odds loss, by Adam over all rows.
    ``rows, columns``: places of the ones in the feature matrix."""
    share = np.array([weights[grades <= k].sum() for k in range(n_grades - 1)]) / weights.sum()
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([np.zeros(n_features), first[:1], steps])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    total = weights.sum()
    for t in range(1, rounds + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[columns], minlength=len(grades))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = (np.clip(edges[grades + k] - score, -40, 40) for k in (1, 0))
        p_upper, p_lower = np.where(grades < n_grades - 1, sigmoid(upper), 1.0), np.where(grades > 0, sigmoid(lower), 0.0)
        p = np.maximum(p_upper - p_lower, 1e-12)
        d_upper, d_lower = p_upper * (1 - p_upper) / p, p_lower * (1 - p_lower) / p
        slope = weights * (d_upper - d_lower) / total
        by_cut = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            by_cut[k] = (weights * (d_lower * (grades == k + 1) - d_upper * (grades == k))).sum() / total
        gradient = np.concatenate([
            np.bincount(columns, slope[rows], minlength=n_features) + PENALTY * w,
            [by_cut.sum()],
            [by_cut[k + 1 :].sum() * gaps[k] for k in range(n_grades - 2)],
        ])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    cuts = theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])
    return theta[:n_features], cuts


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts of up to ``most`` toxic and ``most`` other labelled documents, chosen by a hash of doc_id. The
    chosen ids are at most twice ``most``, so they are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(3), "doc_id")
    picked = known.where("toxic = 1").orderBy(order).limit(most).unionByName(known.where("toxic = 0").orderBy(order).limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit_severity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> SeverityModel:
    """Fit on a bounded sample of labelled documents (``sample_rows`` of each class at most).

    Labels only say toxic or not. Grade 0 is not toxic; a toxic document's grade 1 to 3 is the number of its
    telling words, features far more frequent in toxic documents of the sample, cut at ``GRADE_CUTS``. The
    features of the model are those whose presence tells the classes apart best (by their difference over its
    error). Rows are weighted back to the classes' shares of all labels. Without labels of both classes every
    document has severity 0.
    """
    sample = staged(labelled_sample(docs, labels, sample_rows), "toxic-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bytetext.Hasher(seed=3)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for row, end, data, bounds in bytetext.pieces(batch.column(0), 1 << 20):
                hashes, texts, _ = features_of(hasher, data, bounds)
                known, place = np.unique(hashes, return_inverse=True)
                pairs = np.unique(place * (end - row) + texts)
                feature, text = pairs // (end - row), pairs % (end - row)
                seen = np.bincount(feature, minlength=len(known))
                bad = np.bincount(feature, toxic[row:end][text], minlength=len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bytetext.signed(known)), pa.array(seen), pa.array(bad)], ["h", "seen", "bad"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {r["toxic"]: r["n"] for r in labels.where("doc_id is not null and toxic is not null").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        discard(sample)
        return SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.full(len(GRADE_CUTS) + 1, 40.0))
    counted = sample.select("text", "toxic").mapInArrow(tally, "h long, seen long, bad long")
    counted = counted.groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).where("seen >= 3")
    in_bad, in_good = (F.col("bad") + 0.5) / (sizes[1] + 1), (F.col("seen") - F.col("bad") + 0.5) / (sizes[0] + 1)
    error = F.sqrt(in_bad * (1 - in_bad) / sizes[1] + in_good * (1 - in_good) / sizes[0])
    ranked = counted.select("h", (in_bad / in_good).alias("odds"), F.abs((in_bad - in_good) / error).alias("z"))
    chosen = ranked.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(n_features).collect()
    known = np.array([r["h"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(known)
    known, telling = known[order], np.array([r["odds"] >= TELLING_ODDS for r in chosen])[order]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bytetext.Hasher(seed=3)
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(0)):
                hashes, texts, _ = features_of(hasher, data, bounds)
                text, feature, n = present(hashes, texts, known)
                told = np.bincount(text, n * telling[feature], minlength=end - row).astype(np.int64)
                lists = bytetext.list_column(feature.astype(np.int32), np.searchsorted(text, np.arange(end - row + 1)))
                yield pa.RecordBatch.from_arrays([batch.column(1)[row:end], pa.array(told), lists], ["toxic", "told", "features"])

    rows = sample.select("text", "toxic").mapInArrow(vectors, "toxic int, told long, features array<int>").toArrow()
    discard(sample)
    toxic, told, lists = rows["toxic"].to_numpy(), rows["told"].to_numpy(), rows["features"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    grades = np.where(toxic == 0, 0, 1 + np.searchsorted(np.array(GRADE_CUTS), told, "left"))
    weight = np.where(toxic == 1, shares[1] / sizes[1], shares[0] / sizes[0])
    places, columns = np.repeat(np.arange(len(grades)), lengths), lists.flatten().to_numpy()
    w, cuts = fit_ordinal(places, columns, grades, weight / weight.mean(), len(known), len(GRADE_CUTS) + 2)
    return SeverityModel(known, w, cuts)


RESULT = "doc_id long, n_words long, grade int, p_toxic double, severity double, rejected boolean"


def score_severity(docs: DataFrame, model: SeverityModel, limit: float = REJECT_OVER) -> DataFrame:
    """One row per document: most probable grade, P(grade > 0), expected severity (0 to 3), and whether
    P(grade > 0) is over ``limit``.

    Texts are read whole. Null or empty text: no features, which is the score of clean text. Repeated rows
    give repeated rows; null ids stay. Empty table: no rows. The model has a bounded number of weights and
    travels with the task; nothing is shuffled.
    """
    names = [part.split()[0] for part in RESULT.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bytetext.Hasher(seed=3)
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                hashes, texts, counts = features_of(hasher, data, bounds)
                text, feature, _ = present(hashes, texts, model.hashes)
                value = np.bincount(text, model.weights[feature], minlength=end - row)
                over = model.exceed(value)
                each = -np.diff(np.concatenate([np.ones((len(value), 1)), over, np.zeros((len(value), 1))], axis=1), axis=1)
                made = (counts.astype(np.int64), each.argmax(1).astype(np.int32), over[:, 0], over.sum(1), over[:, 0] > limit)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], *map(pa.array, made)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, RESULT)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_severity(docs, fit_severity(docs, labels))


def keep_clean(docs: DataFrame, model: SeverityModel, limit: float = REJECT_OVER) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Rows are scored where they lie, so texts are not shuffled and repeated or null ids do no harm.
    """

    def filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bytetext.Hasher(seed=3)
        for batch in batches:
            clean = []
            for row, end, data, bounds in bytetext.pieces(batch.column("text")):
                text, feature, _ = present(*features_of(hasher, data, bounds)[:2], model.hashes)
                clean.append(model.exceed(np.bincount(text, model.weights[feature], minlength=end - row))[:, 0] <= limit)
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(filter_rows, docs.schema)
