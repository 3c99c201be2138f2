"""Price table, overrides and exchange rate as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import canonical_model_key

_POINT = "input_per_m double, cache_hit_per_m double, output_per_m double"
_WRITES = "cache_write_per_m double, cache_write_1h_per_m double, cache_storage_per_m double"

PRICE_TABLE = f"""
schema bigint, updated_at string,
fx_fallback struct<usd_cny double, date string, source string>,
entries array<struct<
  provider string, display_name string, provider_match array<string>,
  models array<struct<
    model string, aliases array<string>, currency string,
    pricing struct<type string, rule string, {_POINT}, {_WRITES},
                   peak struct<{_POINT}>, offpeak struct<{_POINT}>>,
    reasoning_policy string, source_url string, updated_at string,
    promo struct<active_until string, note string, list struct<{_POINT}>>,
    input_schema string, notes array<string>>>>>
"""

OVERRIDE = f"currency string, {_POINT}, {_WRITES}, source_url string, note string"
FX = "usd_cny double, updated_at string, source string"


def parse_price_table(documents: DataFrame) -> DataFrame:
    """Whole-document JSON text (column ``value``) to one nested row."""
    return documents.select(F.from_json("value", PRICE_TABLE).alias("t")).select("t.*")


def read_price_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_price_table(spark.read.text(path, wholetext=True))


def price_rules(table: DataFrame) -> DataFrame:
    """Flatten to one row per lookup key (model name or alias) and tier.

    A flat entry is one row with NULL tier; a tiered entry is a peak and an offpeak row without a
    cache-write price. ``rank`` keeps table order, so the first entry naming a key can win.
    """
    models = table.select(
        F.col("updated_at").alias("table_updated_at"), F.posexplode("entries").alias("p_pos", "p")
    ).select("table_updated_at", "p_pos", "p", F.posexplode("p.models").alias("m_pos", "m"))
    names = F.concat(F.array("m.model"), F.coalesce("m.aliases", F.array().cast("array<string>")))
    keyed = models.select("*", F.posexplode(names).alias("k_pos", "name"))
    flat = F.struct(
        F.lit(None).cast("string").alias("tier"),
        *[
            F.col(f"m.pricing.{f}").alias(f)
            for f in (
                "input_per_m", "cache_hit_per_m", "output_per_m",
                "cache_write_per_m", "cache_write_1h_per_m", "cache_storage_per_m",
            )
        ],
    )

    def tier(name: str):
        return F.struct(
            F.lit(name).alias("tier"),
            *[F.col(f"m.pricing.{name}.{f}").alias(f) for f in ("input_per_m", "cache_hit_per_m", "output_per_m")],
            F.lit(None).cast("double").alias("cache_write_per_m"),
            F.lit(None).cast("double").alias("cache_write_1h_per_m"),
            F.col("m.pricing.cache_storage_per_m").alias("cache_storage_per_m"),
        )

    rows = F.when(F.col("m.pricing.type") == "tiers", F.array(tier("peak"), tier("offpeak"))).otherwise(F.array(flat))
    return keyed.select("*", F.explode(rows).alias("r")).select(
        F.lower("name").alias("match_key"),
        F.struct("p_pos", "m_pos", "k_pos").alias("rank"),
        F.col("p.provider").alias("provider"),
        F.col("p.display_name").alias("display_name"),
        F.col("m.model").alias("model"),
        (F.col("k_pos") == 0).alias("is_model_name"),
        F.col("m.currency").alias("currency"),
        "r.*",
        F.col("m.promo.active_until").alias("promo_until"),
        *[
            F.col(f"m.promo.list.{f}").alias(f"list_{f}")
            for f in ("input_per_m", "cache_hit_per_m", "output_per_m")
        ],
        F.col("m.input_schema").alias("input_schema"),
        F.col("m.updated_at").alias("entry_updated_at"),
        "table_updated_at",
        F.col("m.notes").alias("notes"),
    )


def parse_overrides(documents: DataFrame) -> DataFrame:
    """JSON object of model name to override (column ``value``) to one row per key."""
    parsed = documents.select(F.from_json("value", f"map<string, struct<{_colons(OVERRIDE)}>>").alias("o"))
    return parsed.select(F.explode("o").alias("name", "o")).select(
        canonical_model_key(F.col("name")).alias("match_key"), "o.*"
    )


def _colons(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in fields.split(",")))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return parse_overrides(spark.read.text(path, wholetext=True))


def set_overrides(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by model key; a change whose ``currency`` is NULL clears the override."""
    changes = changes.withColumn("match_key", canonical_model_key(F.col("match_key")))
    kept = current.join(changes, "match_key", "left_anti")
    return kept.unionByName(changes.where(F.col("currency").isNotNull()))


def latest_fx(table: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """One row: the newest cached rate, else the fallback carried in the price table."""
    fallback = table.select(
        F.col("fx_fallback.usd_cny").alias("usd_cny"),
        F.col("fx_fallback.date").alias("updated_at"),
        F.lit("builtin fallback").alias("source"),
    )
    if cached is None:
        return fallback
    newest = cached.agg(F.max_by(F.struct("usd_cny", "updated_at", "source"), "updated_at").alias("c"))
    joined = fallback.crossJoin(F.broadcast(newest))
    return joined.select(*[F.coalesce(F.col(f"c.{f}"), F.col(f)).alias(f) for f in fallback.columns])
