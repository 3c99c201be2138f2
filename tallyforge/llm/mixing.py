"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, staged

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
CHUNK_ROWS = 4096
OFFSETS = 16  # random offsets tried for each source
BROADCAST_BYTES = 8 << 20  # of sources
ROW_BYTES = 64  # of a source besides its name
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, most=MOST_COPIES) -> DataFrame:
    """Target words of each source (``source, source_size``): one row per source, so this table is small.

    Weights repeat over the sources in code-point order, null last. All sources share ``total_share`` of all
    words by weight; a target stops at ``most`` times its source's size and the excess is shared by weight
    among the others. In order of size per weight, the sources before the first that keeps its share are the
    capped ones: if that one gets less than it may, so does every later one.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(ordered) - 1) % F.lit(len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double")
    limited = sources.select("source", "source_size", weight.alias("weight")).select(
        "*", (F.col("source_size") * F.lit(most)).alias("limit")
    )
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.sum("source_size").over(everything) * F.lit(total_share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per_weight = limited.select("*", (left / rest).alias("share")).select(
        "*", F.when(F.col("share") * F.col("weight") < F.col("limit"), F.col("share")).alias("free_share")
    )
    level = F.first("free_share", ignorenulls=True).over(everything)
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return per_weight.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, seed: int = 0, weights=WEIGHTS, total_share=TOTAL_SHARE, most=MOST_COPIES, chunk_rows=CHUNK_ROWS
) -> DataFrame:
    """Copies of each document: ``doc_id, size, source_size, target, copies, taken``, one row per input row.

    Every document of a source expects target / source_size copies. These are summed up along the source, a
    random offset is added, and a document is emitted once per integer boundary its stretch crosses. Of a few
    offsets (evenly apart, the first from the seed and the source's name) each source uses the one whose words
    come nearest its target, which matters where a single long document is a large part of a small source. Documents are summed in order of size, so that the words taken come
    near the target, not only the number of documents.

    The prefix sum has two levels: a source is split by a hash of doc_id into chunks of about ``chunk_rows``
    rows, ranks are windows within a chunk, and chunk starts are windows over one row per chunk. A source
    with a third of all rows is thus many tasks. Rows are counted once and kept in a narrow table.

    Null text: size 0; such rows get copies like others, of no words. Null source: a source of its own, the
    last. A source without words has target 0 and no copies. Repeated rows are rows of their own; which of
    equal rows is copied does not show. Null doc_id: sorted first. Empty table: no rows.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sized(sizes, seed, weights, total_share, most, chunk_rows).drop("s")


def small_side(sources: DataFrame) -> DataFrame:
    """``sources`` (a staged frame, one row per ``s``), to be broadcast if its rows and names are few; else the
    join shuffles and adaptive execution splits its hot sources."""
    size = sources.agg(F.coalesce(F.sum(F.octet_length("s") + F.lit(ROW_BYTES)), F.lit(0))).first()[0]
    return F.broadcast(sources) if size <= BROADCAST_BYTES else sources


def mix_sized(
    sizes: DataFrame, seed: int = 0, weights=WEIGHTS, total_share=TOTAL_SHARE, most=MOST_COPIES, chunk_rows=CHUNK_ROWS
) -> DataFrame:
    """``mix_sources`` for rows whose ``size`` is known, with the source as ``s`` too ("=" and the name, null "-")."""
    sized = staged(sizes.select("doc_id", "source", "size"), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(sources.select("source", "source_size"), weights, total_share, most)
    plan = (
        sources.drop("source_size")
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("s"),
            F.col("source_size"),
            F.col("target"),
            F.ceil(F.col("source_rows") / F.lit(chunk_rows)).alias("chunks"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"),
        )
        .withColumn("offset", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "s"), 11) / F.lit(float(1 << 53)))
    )
    plan = staged(plan, "mix-plan")
    named = sized.select("doc_id", "size", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("s"))
    placed = named.join(small_side(plan), "s").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("chunks")))
    placed = placed.repartition("s", "chunk")  # else the windows keep the join's partitions, one for a whole source
    along = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("s", "chunk").count().select(
        F.col("s"), F.col("chunk"), F.coalesce(F.sum("count").over(along), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("s", "chunk").orderBy("size", "doc_id")
    ranked = placed.withColumn("place", F.row_number().over(within)).join(starts, ["s", "chunk"])
    ranked = ranked.select("doc_id", "s", "size", "source_size", "target", "expected", "offset", (F.col("start") + F.col("place")).alias("rank"))
    ranked = staged(ranked, "mix-ranks")

    def copies_with(offset: Column) -> Column:
        upto, since = (F.floor(rank * F.col("expected") + offset) for rank in (F.col("rank"), F.col("rank") - 1))
        return (upto - since).cast("long")

    offsets = [F.pmod(F.col("offset") + F.lit(j / OFFSETS), F.lit(1.0)) for j in range(OFFSETS)]
    words = [F.sum(F.col("size") * copies_with(u)).alias(f"words_{j}") for j, u in enumerate(offsets)]
    tried = ranked.groupBy("s", "target", "offset").agg(*words)
    errors = [F.struct(F.abs(F.col(f"words_{j}") - F.col("target")).alias("error"), u.alias("chosen")) for j, u in enumerate(offsets)]
    best = staged(tried.select("s", F.array_min(F.array(*errors))["chosen"].alias("chosen")), "mix-offsets")
    discard(sized)
    discard(plan)
    copies = copies_with(F.col("chosen"))
    return ranked.join(small_side(best), "s").select(
        "doc_id", "s", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat_mixed(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Copies are joined back by doc_id, source and size; rows equal in these are numbered, and each takes its
    own count. Null ids and sources are values like others.
    """
    key = ["__mix_id", "__mix_source", "__mix_size"]
    text_or = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    keyed = docs.withColumns(dict(zip(key, (text_or("doc_id"), text_or("source"), word_count(F.col("text"))), strict=True)))
    mixed = mix_sized(keyed.select("doc_id", "source", F.col(key[2]).alias("size")), seed, **options)
    mixed = mixed.select(text_or("doc_id").alias(key[0]), "s", F.col("size").alias(key[2]), "copies")
    counts = mixed.withColumnRenamed("s", key[1]).groupBy(*key).agg(F.collect_list("copies").alias("__mix_counts"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    rows = keyed.join(counts, key).withColumn("__mix_copies", F.element_at("__mix_counts", number))
    again = rows.withColumn("__mix_again", F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies").cast("int"))))
    return again.select(*docs.columns)
