"""A corpus pipeline over ``documents``: reject toxic texts, keep one of each near-duplicate group, drop
documents with benchmark passages, mix the sources to target weights, and deal the rest to shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, mixing, near_dedup, resharding, toxicity
from tallyforge.llm.storage import discard, row_key, short_batches, staged

SHINGLE_WORDS = 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose P(toxic) stays under the model's limit; the model is fitted on the labels of this stage's
    input."""
    short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit_severity(docs, labels))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows named by their id and text, so that decisions fall on rows: ids may be null or stand at several texts."""
    return docs.select(row_key().alias("doc_id"), "text", F.col("doc_id").alias("own_id"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id (null ids last); rows equal in id
    and text once."""
    short_batches(spark)
    keyed = _keyed(docs)
    groups = near_dedup.near_duplicates(keyed, SHINGLE_WORDS).select("doc_id", "component_id").distinct()
    named = keyed.select("doc_id", F.col("own_id").cast("long").alias("own_id")).distinct()
    members = staged(groups.join(named, "doc_id"), "group-members")
    place = F.struct(F.col("own_id").isNull(), F.coalesce("own_id", F.lit(0)), "doc_id")
    first = members.groupBy("component_id").agg(F.min(place)["doc_id"].alias("row"))
    kept = docs.withColumn("__row", row_key()).join(first.select(F.col("row").alias("__row")), "__row", "left_semi")
    return kept.dropDuplicates(["__row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    short_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_contamination(_keyed(docs), items).select(F.col("doc_id").alias("__row")).distinct()
    return docs.withColumn("__row", row_key()).join(leaks, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row: moved from shards by source hash to 16 shards of equal bytes."""
    sized = docs.select(
        "doc_id",
        "source",
        resharding.byte_size().alias("size"),
        F.pmod(F.xxhash64("source"), F.lit(16)).cast("int").alias("old_shard"),
    )
    return resharding.reshard(sized, 16).select("doc_id", "source", "size", "old_shard", "shard", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
