"""From signature bands to exact near-duplicate components.

Documents are nodes only once per distinct shingle set. Within a bucket of equal bands all are compared with
one pivot; what is then still apart and cannot be ruled out is compared pair by pair.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, bytetext
from .components import components
from .storage import discard, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RARE = 50  # sets that may have a shingle that counts as rare
FILTER_BITS = 27
ID_BITS = 24
PRINTS = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def shingle_prints(docs: DataFrame, shingle_words: int, word_table: str, signature: Callable, rows: int, seed: int) -> DataFrame:
    """Size, two hashes and signature bands of each document's shingle set (no bands for an empty set).

    ``signature(sets, firsts)`` returns one row of 32-bit coordinates per non-empty set; ``rows`` coordinates
    make a band.
    """
    names = [part.split()[0] for part in PRINTS.split(", ")]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed), getattr(bytetext, word_table)()
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, wordy)
                runs, firsts = bytetext.shingles(hasher.words(data, starts, ends), firsts, shingle_words)
                sets, firsts = bytetext.distinct_runs(runs, firsts)
                sizes = np.diff(firsts)
                filled = np.flatnonzero(sizes)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (sets, bytetext.mix(sets))]
                h1, h2 = (bytetext.signed(s[firsts[1:]] - s[firsts[:-1]]) for s in sums)
                coordinates = signature(sets, firsts[:-1][filled])
                bands = band_keys(coordinates, rows)
                n_bands = bands.shape[1] if len(filled) else 0
                lists = bytetext.list_column(bytetext.signed(bands.reshape(-1)), np.concatenate([[0], np.cumsum((sizes > 0) * n_bands)]))
                made = (sizes.astype(np.int64), h1, h2)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], *map(pa.array, made), lists], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, PRINTS)


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One key per band, different for equal coordinates of different bands."""
    n, k = coordinates.shape
    parts = coordinates.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to((np.arange(k // rows, dtype=np.uint64) + np.uint64(1)) * np.uint64(bytetext.STEP), (n, k // rows))
    for j in range(rows):
        key = bytetext.mix(key * np.uint64(bytetext.COMBINE) + parts[:, :, j])
    return np.ascontiguousarray(key)


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle_words: int, word_table: str, seed: int) -> DataFrame:
    """``doc_id, grams`` (distinct shingle hashes) of the documents named in ``ids``."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wordy = bytetext.Hasher(seed), getattr(bytetext, word_table)()
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, wordy)
                runs, firsts = bytetext.shingles(hasher.words(data, starts, ends), firsts, shingle_words)
                sets, firsts = bytetext.distinct_runs(runs, firsts)
                lists = bytetext.list_column(bytetext.signed(sets), firsts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], lists], ["doc_id", "grams"])

    chosen = bitmap.rows_with_ids(docs, ids).join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(sets_of, "doc_id long, grams array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, both, union`` of each pair (a staged frame), from the full sets. Sets in no pair stay out of the shuffles."""
    nodes = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = bitmap.rows_with_keys(sets, nodes, "doc_id", ID_BITS, spread_out=False)
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("a_grams"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("b_grams"))
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    out = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("a_grams") + F.size("b_grams")).alias("sum"))
    return out.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("union"))


def rare_shingles(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, rare``: how many of its shingles at most ``RARE`` sets have, and ``node, gram`` of those that
    some other set has too."""
    grams = sets.select(F.col("doc_id").alias("node"), F.explode("grams").alias("gram"))
    seen = grams.groupBy("gram").agg(F.count("*").alias("seen"), F.min("node").alias("node")).where(F.col("seen") <= RARE)
    seen = staged(seen, "near-seen")
    shared = staged(seen.where("seen > 1").select("gram"), "near-shared")
    known = bitmap.build(shared, "gram", FILTER_BITS)
    spread = sets.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            if spread is not None:
                ok = bitmap.passes(spread.value, found.view(np.uint64))
                found, node = found[ok], node[ok]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found)], ["node", "gram"])

    held = staged(sets.select("doc_id", "grams").mapInArrow(passing, "node long, gram long").join(shared, "gram"), "near-held")
    counts = seen.where("seen = 1").groupBy("node").agg(F.count("*").alias("n"))
    counts = counts.unionByName(held.groupBy("node").agg(F.count("*").alias("n")))
    rare = staged(counts.groupBy("node").agg(F.sum("n").alias("rare")), "near-rare")
    discard(seen)
    discard(shared)
    return rare, held


def possible_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` in different parts that may be linked; ``placed`` has ``band, node, n, part``.

    Of a set's shingles at most ``n - o`` may miss in the other, where ``o`` is the overlap a link of two sets
    of their sizes needs. That holds for rare shingles alone. Either both have so few rare ones that none needs
    to be shared; such pairs are found by their band, where members of its most frequent part are not compared
    with one another. Or they share rare ones; such pairs are found by these, of which each is in ``RARE`` sets
    at most. Both ways are exact and list few pairs however large a group of copies is.
    """
    low_high = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    open_ = staged(placed.join(low_high.select("band"), "band"), "near-open")
    nodes = open_.select("node", "n", "part").distinct()
    rare, held = rare_shingles(sets.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    counted, nodes = rare, staged(nodes.join(rare, "node", "left").withColumn("rare", F.coalesce("rare", F.lit(0))), "near-nodes")
    discard(counted)

    def sides(keyed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        return tuple(keyed.select(key, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "part", "rare")]) for x in "ab")

    def few_missing(shared) -> Column:
        whole = (F.col("n_a") + F.col("n_b")) * percent  # of which 1 / (100 + percent) must be shared
        fits = [(F.col(f"n_{x}") - F.col(f"rare_{x}") + shared) * (100 + percent) >= whole for x in "ab"]
        return (F.col("part_a") != F.col("part_b")) & fits[0] & fits[1]

    calm = open_.select("band", "node").join(nodes.where((F.col("n") - F.col("rare")) * 100 >= F.col("n") * percent), "node")
    per_part = calm.groupBy("band", "part").agg(F.count("*").alias("size"))
    main = per_part.groupBy("band").agg(F.count("*").alias("parts"), F.max_by("part", "size").alias("main")).where("parts > 1")
    main = staged(main.select("band", "main"), "near-main")
    calm = staged(calm.join(main, "band"), "near-calm")
    discard(main)
    left, right = sides(calm.where("part <> main"), "band")[0], sides(calm, "band")[1]
    right = right.join(calm.select("band", "main").distinct(), "band")
    once = (F.col("part_b") == F.col("main")) | (F.col("part_a") < F.col("part_b"))
    by_band = left.join(right.withColumnRenamed("band", "band_b"), (F.col("band") == F.col("band_b")) & once & few_missing(F.lit(0)))
    left, right = sides(held.join(nodes, "node"), "gram")
    pairs = left.join(right.withColumnRenamed("gram", "gram_b"), (F.col("gram") == F.col("gram_b")) & (F.col("part_a") < F.col("part_b")))
    fields = [f"{c}_{x}" for x in "ab" for c in ("node", "n", "part", "rare")]
    by_rare = pairs.groupBy(*fields).agg(F.count("*").alias("shared")).where(few_missing(F.col("shared")))
    both = by_band.select("node_a", "node_b").unionByName(by_rare.select("node_a", "node_b"))
    both = staged(both.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct(), "near-possible")
    for used in (open_, nodes, held, calm):
        discard(used)
    return both


def near_components(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``doc_id, component_id, n_shingles`` for every row of ``prints`` (a staged frame).

    Documents with equal sets are one node, the smallest doc_id. Nodes that share a band form a bucket.
    First every node is compared with its buckets' pivots (the member in the fullest buckets, the centre of a
    group of copies), on full sets. Then, where a bucket still spans components, its members are compared with
    members of other components, but only pairs whose rare shingles allow a link (``possible_links``). No link
    between these members is lost, without listing all pairs of a bucket; no bucket is capped.
    """
    linked = F.col("both") * F.lit(100) >= F.col("union") * F.lit(percent)
    named = prints.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"))
    classes = staged(classes, "near-classes")  # read by its own shuffle, so that joins can split hot classes
    classed = named.join(classes, ["h1", "h2", "n_shingles"])
    nodes = classed.where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "bands")
    entries = nodes.select("node", "n", F.explode("bands").alias("band"))
    full = entries.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    full = staged(full, "near-full")
    members = staged(entries.join(full, "band"), "near-members")
    central = members.groupBy("node").agg(F.sum("members").alias("central"))
    ranked = members.join(central, "node")
    pivots = ranked.groupBy("band").agg((-F.max(F.struct("central", (-F.col("node")).alias("node")))["node"]).alias("pivot"))
    placed = staged(members.join(pivots, "band").select("band", "node", "n", "pivot"), "near-placed")
    sets = staged(sets_of(members.select(F.col("node").alias("doc_id")).distinct()), "near-sets")
    pairs = placed.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = staged(pairs, "near-pairs")
    first = staged(compared(pairs, sets), "near-compared")
    parts = components(first.where(linked))
    known = placed.join(parts, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("part"))
    known = staged(known, "near-known")
    for used in (full, members, placed, pairs):
        discard(used)
    possible = possible_links(known, sets, percent)
    done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = staged(possible.join(done, ["a", "b"], "left_anti"), "near-rest")
    second = staged(compared(rest, sets), "near-compared")
    for used in (known, possible, rest, sets):
        discard(used)
    late = second.where(linked)
    if not late.isEmpty():
        parts = components(first.where(linked).select("a", "b").unionByName(late.select("a", "b")))
    by_node = parts.select("node", "component")
    result = classed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    others = prints.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(others)
