"""Grouping spelling variants: words one edit apart, found by common prefixes and suffixes of code-point matrices."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
BLOCK_ROWS = 512
BLOCK_BYTES = 1 << 20
DROP_EVERY = 31
ROUNDS = 8  # doublings of the chains of forms: a form is ten times as frequent, so chains have under 20 steps


def damaged(run: Column, doc_id: Column) -> Column:
    """The run without one of its code points, where its name's CRC-32 says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of all texts. Shorter runs can give no word, so they are not even listed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    lowered = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, upper.lower()))
    words = runs.select("doc_id", lowered.alias("run")).select(damaged(F.col("run"), F.col("doc_id")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def tile_keys(words: DataFrame) -> DataFrame:
    """``key, m, side, word, n``: where a word may meet its near words.

    Near words have a common prefix and suffix that reach together the longer length m less one. With k about
    a third of m, the common prefix has at least 2k code points (side 0), or at least k, so that at least
    m - 2k are common at the end (side 1), or fewer, so that m - k are (side 2). The common parts are the key.
    A word is the longer one (m is its length) or the shorter (m is one more); no near pair is missed.
    """
    length = F.length("word")
    ms = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    k = F.expr("(m + 1) div 3").cast("int")
    at_end = lambda n: F.right("word", n)
    whole = ms.select("*", k.alias("k")).select(
        "word",
        "n",
        "m",
        F.posexplode(
            F.array(
                F.xxhash64(F.lit(0), "m", F.left("word", F.col("k") * 2)),
                F.xxhash64(F.lit(1), "m", F.left("word", F.col("k")), at_end(F.col("m") - F.col("k") * 2)),
                F.xxhash64(F.lit(2), "m", at_end(F.col("m") - F.col("k"))),
            )
        ).alias("side", "key"),
    )
    return whole.select("key", F.col("m").cast("int").alias("m"), F.col("side").cast("int").alias("side"), "word", "n")


def common_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many columns agree from the first on, for each row of two matrices."""
    differ = left != right
    return np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])


def near_rows(words: list[bytes], m: np.ndarray, side: np.ndarray, group: np.ndarray, block: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words that meet in a group; ``group`` is ascending. Where a group is of two blocks (``two``)
    only words of different blocks are compared.

    Words are padded code-point rows, once from the left and once from the right; row i is compared with row
    i + d for every distance d inside its group, all groups of a chunk at once.
    """
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max(initial=1)) + 1
    ahead, behind = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ahead[row, column] = data
    behind[row, np.repeat(lengths, lengths) - 1 - column] = data
    sizes = np.bincount(group - group[0]) if len(group) else np.zeros(1, np.int64)
    found = []
    for d in range(1, int(sizes.max())):
        a = np.flatnonzero(group[d:] == group[:-d])
        b = a + d
        longer = np.maximum(lengths[a], lengths[b])
        ok = (longer == m[a]) & ((block[a] != block[b]) | ~two[a])
        a, b, longer = a[ok], b[ok], longer[ok]
        prefix = np.minimum(common_lengths(ahead[a], ahead[b]), np.minimum(lengths[a], lengths[b]))
        suffix = np.minimum(common_lengths(behind[a], behind[b]), np.minimum(lengths[a], lengths[b]))
        k = (longer + 1) // 3
        part = np.where(prefix >= 2 * k, 0, np.where(prefix >= k, 1, 2))
        near = (prefix + suffix >= longer - 1) & (part == side[a])
        found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``word, near, near_n``: every near pair of distinct words, once in each direction.

    Words that share a key are cut into blocks of bounded rows and bytes, and each pair of blocks is one group
    of the shuffle; a key that many words share is thus many tasks.
    """
    keyed = tile_keys(words)
    longest = F.count_if(F.length("word") == F.col("m"))
    full = keyed.groupBy("key").agg(F.count("*").alias("members"), longest.alias("longest")).where("members > 1 and longest > 0")
    rows_of = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.lit(BLOCK_BYTES) / F.col("m")))
    met = keyed.join(full.select("key", "members"), "key").withColumn("blocks", F.ceil(F.col("members") / rows_of).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    met = met.select("key", "m", "side", "word", "n", "block", F.inline(others))
    met = met.repartition("key", "i", "j").sortWithinPartitions("m", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in _and_then_none(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                kept = table if kept is None else pa.concat_tables([kept, table])
            if kept is None or not kept.num_rows:
                continue
            m, key, i, j = (kept[c].to_numpy() for c in ("m", "key", "i", "j"))
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (m[1:] != m[:-1])])
            group = np.cumsum(first) - 1
            edges = np.append(np.flatnonzero(first), len(group))
            done = edges[-1] if batch is None else edges[-2]
            at = 0
            while at < done:  # chunks of whole groups
                end = int(edges[np.searchsorted(edges, at + max(1, BLOCK_BYTES // int(m[at])), "right") - 1])
                end = min(end if end > at else int(edges[np.searchsorted(edges, at, "right")]), int(done))
                part = kept.slice(at, end - at)
                words_, n = part["word"].to_pylist(), part["n"].to_numpy()
                latin = [w.encode("latin-1") for w in words_]
                a, b = near_rows(latin, m[at:end], part["side"].to_numpy(), group[at:end], part["block"].to_numpy(), i[at:end] != j[at:end])
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
                if len(a):
                    column = part["word"].combine_chunks()
                    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b)), pa.array(n[b])], ["word", "near", "near_n"])
                at = end
            kept = kept.slice(done)

    return met.mapInArrow(compare, "word string, near string, near_n long")


def _and_then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def group_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``.

    Words are maximal runs of letters (A-Z lower-cased), of which one in 31, by the CRC-32 of doc_id and run,
    loses one code point; words of at least ``least_length`` code points that occur ``least_count`` times count.
    A word's form is its near word (one edit) that occurs most, ties to the smaller, if that is ``factor`` times
    as frequent; ``root`` is where its forms end.

    Null or empty texts have no words; a null doc_id is the empty name; repeated rows count as often as they
    come. Empty table, or no word often enough: no rows. Other columns are not read. Words of any length are
    compared whole; a very long one is a block of its own.
    """
    words = staged(vocabulary(docs, least_length, least_count), "spelling-words")
    best = near_words(words, block_rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best")["less"])
    known = F.coalesce(F.col("form_n") >= F.col("n") * factor, F.lit(False))
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(known, F.col("best")["near"]).alias("form"),
        F.when(known, F.col("form_n")).alias("form_n"),
    )
    formed = staged(formed, "spelling-forms")
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            break
        longer = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps = staged(longer, "spelling-roots")
    discard(words)
    rooted = formed.join(steps, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
