"""Near-duplicate documents by circulant MinHash."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_links
from .storage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
PERCENT = 80
COORDINATES = 128
ROWS = 4  # 32 bands: a pair of likeness 0.8 shares none with probability 5e-8
SEED = 4


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit values (the public murmur3 finalizer), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(sets: np.ndarray, firsts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash with two permutations: the first scatters the shingles over a circle of 2**32 places, the second
    is turned by one place for every further coordinate, whose value is the least over the set."""
    if not len(firsts):
        return np.zeros((0, coordinates), np.uint32)
    scattered = permuted((sets ^ (sets >> np.uint64(32))).astype(np.uint32))
    out = np.empty((len(firsts), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(permuted(scattered + np.uint32(k)), firsts)
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are what blanks separate, A-Z in lower case; a document's set holds its distinct shingles of
    ``shingle_words`` words, or all its words as one if there are fewer. Documents whose sets overlap by at
    least ``percent`` of their union are linked, on full sets; ``component_id`` is the smallest doc_id that
    links reach, and that document is kept.

    Empty or null texts have no shingles, are linked with nothing and kept. A null doc_id has a null component
    and is kept. Repeated rows are rows of one document. Empty table: no rows. Other columns are not read.
    """
    prints = staged(near_links.shingle_prints(docs, shingle_words, "not_blank", circulant_signature, ROWS, SEED), "near-prints")

    def sets_of(ids: DataFrame) -> DataFrame:
        return near_links.shingle_sets(docs, ids, shingle_words, "not_blank", SEED)

    found = near_links.near_components(prints, sets_of, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
