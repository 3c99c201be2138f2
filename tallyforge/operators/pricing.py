"""Estimated cost from a price table with aliases, tiers, promotions, overrides and an exchange rate.

Price is linear in tokens once the entry, the tier and the input split are known. So usage rows are first
folded to one row per model and tier (map-side combined, no join), and prices are joined to those few rows.
Only ``record_cost`` joins prices to usage rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import caliber
from tallyforge.functions.text import canonical_model_key
from tallyforge.functions.times import peak_tier
from tallyforge.plans.staging import broadcast_if_small

PRICE_FIELDS = ["input_per_m", "cache_hit_per_m", "cache_write_per_m", "cache_storage_per_m", "output_per_m"]
TIERS = ["peak", "offpeak"]

# Cost lines in display order.
COST_LINES = ["input", "cache_hit", "cache_write", "cache_storage", "output", "reasoning"]


def promo_active(now_ms: int) -> Column:
    """Judged at the time of asking. An end date that does not parse is over."""
    end = F.unix_millis(F.try_to_timestamp(F.col("promo_until")))
    dated = F.col("promo_until").rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.coalesce(dated & (F.lit(now_ms) < end), F.lit(False))


def first_rules(rules: DataFrame) -> DataFrame:
    """One price per key and tier: the first table row that names the key wins."""
    order = Window.partitionBy("match_key").orderBy("rank")
    return rules.withColumn("place", F.dense_rank().over(order)).where("place = 1").drop("place")


def effective_prices(rules: DataFrame, overrides: DataFrame, now_ms: int) -> DataFrame:
    """Price in effect per ``match_key`` and time tier: override, else promotion, else base.

    Every key has a row for both time tiers, so the join to usage is a plain equality; ``tier`` is the tier
    to show and is NULL for prices that do not vary. ``rules`` and ``overrides`` are small dimension tables.
    """
    base = first_rules(rules)
    times = F.when(F.col("tier").isNull(), F.array(*map(F.lit, TIERS))).otherwise(F.array("tier"))
    base = base.withColumn("time_tier", F.explode(times))
    o = overrides.select(
        "match_key", F.lit(True).alias("o_found"), F.col("currency").alias("o_currency"),
        *[F.col(f).alias(f"o_{f}") for f in PRICE_FIELDS],
    )
    o = o.withColumn("time_tier", F.explode(F.array(*map(F.lit, TIERS))))
    joined = base.join(o, ["match_key", "time_tier"], "full")

    overridden = F.coalesce("o_found", F.lit(False))
    has_promo = F.col("promo_until").isNotNull()
    active = has_promo & promo_active(now_ms)
    expired = has_promo & ~active
    listed = {"input_per_m", "cache_hit_per_m", "output_per_m"}

    def price(field: str) -> Column:
        plain = F.col(field)
        if field in listed:
            plain = F.when(expired, F.col(f"list_{field}")).otherwise(plain)
        return F.when(overridden, F.col(f"o_{field}")).otherwise(plain).alias(field)

    return joined.select(
        "match_key",
        "time_tier",
        F.when(~overridden & ~expired, F.col("tier")).alias("tier"),
        F.when(overridden, F.col("o_currency")).otherwise(F.col("currency")).alias("currency"),
        *[price(f) for f in PRICE_FIELDS],
        "input_schema",
        overridden.alias("overridden"),
        F.when(has_promo, active & ~overridden).alias("promo_current"),
    )


def price_basis(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Billable token sums per model and time tier, for each way an entry may split the input."""
    zero = F.lit(0).cast("bigint")

    def total(col: Column, name: str) -> Column:
        return F.coalesce(F.sum(col), zero).alias(name)

    return (
        usage.withColumn("time_tier", peak_tier(F.col("ts_ms")))
        .groupBy(*(keys or []), "model", "time_tier")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            total(caliber.display_total(), "total"),
            total(caliber.hit_denominator(), "hit_input_total"),
            total(caliber.billable_input("exclusive"), "input_exclusive"),
            total(caliber.billable_input("inclusive"), "input_inclusive"),
            total(caliber.billable_input(None), "input_auto"),
            total(F.col("cache_read_tokens"), "cache_read"),
            total(F.col("cache_write_tokens"), "cache_write"),
            total(F.col("output_tokens"), "output"),
            total(F.col("reasoning_tokens"), "reasoning"),
        )
    )


def _priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    keyed = rows.withColumn("match_key", canonical_model_key(F.col("model")))
    billed = (
        F.when(F.col("input_schema") == "exclusive", F.col("input_exclusive"))
        .when(F.col("input_schema") == "inclusive", F.col("input_inclusive"))
        .otherwise(F.col("input_auto"))
    )
    return (
        keyed.join(prices, ["match_key", "time_tier"], "left")
        .withColumn("billed_input", billed)
        .withColumn("priced", F.col("currency").isNotNull())
    )


def line_cost(tokens: Column, per_m: Column, usd_cny: float) -> Column:
    rate = F.when(F.col("currency") == "USD", F.lit(float(usd_cny))).otherwise(F.lit(1.0))
    return tokens / F.lit(1_000_000.0) * per_m * rate


def cost_cny(usd_cny: float) -> Column:
    """Input, cache hits, cache writes and output; reasoning and storage are never billed."""
    parts = [
        ("billed_input", "input_per_m"),
        ("cache_read", "cache_hit_per_m"),
        ("cache_write", "cache_write_per_m"),
        ("output", "output_per_m"),
    ]
    cost = F.lit(0.0)
    for tokens, price in parts:
        cost = cost + F.coalesce(line_cost(F.col(tokens), F.col(price), usd_cny), F.lit(0.0))
    return cost


def record_cost(usage: DataFrame, prices: DataFrame, usd_cny: float) -> DataFrame:
    """Usage rows with ``cost_cny`` and ``priced``. The price table is broadcast after its rows were counted,
    and joined by shuffle when there are too many."""
    rows = usage.select(
        "*",
        peak_tier(F.col("ts_ms")).alias("time_tier"),
        caliber.billable_input("exclusive").alias("input_exclusive"),
        caliber.billable_input("inclusive").alias("input_inclusive"),
        caliber.billable_input(None).alias("input_auto"),
        caliber.zero_if_null("cache_read_tokens").alias("cache_read"),
        caliber.zero_if_null("cache_write_tokens").alias("cache_write"),
        F.col("output_tokens").alias("output"),
    )
    priced = _priced(rows, broadcast_if_small(prices))
    return priced.select(*[priced[c] for c in usage.columns], cost_cny(usd_cny).alias("cost_cny"), "tier", "priced")


def priced_models(usage: DataFrame, prices: DataFrame, usd_cny: float, keys: list[str] | None = None) -> DataFrame:
    """Per raw model: tokens, cache figures, cost and whether it has a price, from one scan."""
    keys = keys or []

    def total(name: str, out: str) -> Column:
        return F.sum(name).cast("bigint").alias(out)

    return (
        _priced(price_basis(usage, keys), prices)
        .groupBy(*keys, "model")
        .agg(
            F.sum(cost_cny(usd_cny)).alias("cost_cny"),
            F.bool_or("priced").alias("priced"),
            total("total", "total_tokens"),
            total("requests", "requests"),
            total("cache_read", "cache_read_sum"),
            total("hit_input_total", "hit_input_total"),
        )
    )


def cost_by_model(usage: DataFrame, prices: DataFrame, usd_cny: float, keys: list[str] | None = None) -> DataFrame:
    """Cost and priced flag per raw model, dearest first."""
    keys = [*(keys or []), "model"]
    models = priced_models(usage, prices, usd_cny, keys[:-1])
    return models.select(*keys, "cost_cny", "priced", "total_tokens").orderBy(F.desc("cost_cny"), *keys)


def cost_summary(usage: DataFrame, prices: DataFrame, usd_cny: float) -> DataFrame:
    """One row: totals, whether everything had a price, and the sorted names that had none."""
    models = priced_models(usage, prices, usd_cny)
    return models.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        (F.coalesce(F.sum("cost_cny"), F.lit(0.0)) + F.lit(0.0)).alias("total_cost_cny"),
        F.coalesce(F.bool_and("priced"), F.lit(True)).alias("fully_priced"),
        F.array_sort(F.collect_set(F.when(~F.col("priced"), F.col("model")))).alias("unknown_models"),
    )


def cost_detail(usage: DataFrame, prices: DataFrame, usd_cny: float, model: str | None = None) -> DataFrame:
    """Cost lines per model (matched without regard to case), line and tier, in display order."""
    rows = usage
    if model is not None:
        rows = usage.where(canonical_model_key(F.col("model")) == canonical_model_key(F.lit(model)))
    priced = _priced(price_basis(rows), prices).where("priced")

    def line(name: str, tokens: Column, price: str, cost: Column, include: Column) -> Column:
        return F.when(
            include,
            F.struct(
                F.lit(COST_LINES.index(name)).alias("line_order"),
                F.lit(name).alias("line"),
                tokens.cast("bigint").alias("tokens"),
                F.col(price).alias("per_m"),
                cost.alias("cost_cny"),
            ),
        )

    def billed(name: str, tokens: str, price: str) -> Column:
        return line(
            name, F.col(tokens), price, line_cost(F.col(tokens), F.col(price), usd_cny), F.col(price).isNotNull()
        )

    free = F.lit(0.0)
    lines = F.array(
        billed("input", "billed_input", "input_per_m"),
        billed("cache_hit", "cache_read", "cache_hit_per_m"),
        billed("cache_write", "cache_write", "cache_write_per_m"),
        line("cache_storage", F.lit(0), "cache_storage_per_m", free, F.col("cache_storage_per_m").isNotNull()),
        billed("output", "output", "output_per_m"),
        line("reasoning", F.col("reasoning"), "output_per_m", free, F.col("reasoning") > 0),
    )
    long = priced.select("match_key", "tier", "currency", F.explode(F.array_compact(lines)).alias("l"))
    tier_order = F.when(F.col("tier") == "peak", 0).when(F.col("tier") == "offpeak", 1).otherwise(2)
    return (
        long.groupBy("match_key", "l.line_order", "l.line", "tier", "currency")
        .agg(
            F.sum("l.tokens").cast("bigint").alias("tokens"),
            F.max("l.per_m").alias("per_m"),
            F.sum("l.cost_cny").alias("cost_cny"),
        )
        .withColumn("included_in", F.when(F.col("line") == "reasoning", F.lit("Output")))
        .orderBy("match_key", "line_order", tier_order)
        .drop("line_order")
    )


def unknown_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Names in the data that neither the table nor an override prices, sorted."""
    names = usage.select("model").distinct().withColumn("match_key", canonical_model_key(F.col("model")))
    known = prices.select("match_key").distinct()
    return names.join(known, "match_key", "left_anti").select("model").distinct().orderBy("model")


def price_listing(rules: DataFrame, overrides: DataFrame, now_ms: int) -> DataFrame:
    """The price table as shown: each entry with its effective price, then override-only models.

    Tiered entries show their tier prices in ``tiers`` and NULL in the flat fields, unless overridden or
    replaced by an expired promotion's list price. Only an override on the entry's own name applies.
    """
    tier_row = F.struct("tier", "input_per_m", "cache_hit_per_m", "output_per_m")
    entries = (
        rules.where("is_model_name")
        .groupBy("provider", "display_name", "model", "rank", "entry_updated_at", "table_updated_at", "currency")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("tier").isNotNull(), tier_row)), asc=False).alias("tiers"),
            *[F.max(F.when(F.col("tier").isNull(), F.col(f))).alias(f) for f in PRICE_FIELDS if f != "cache_storage_per_m"],
            F.max("cache_storage_per_m").alias("cache_storage_per_m"),
            F.first("promo_until").alias("promo_until"),
            *[F.first(f"list_{f}").alias(f"list_{f}") for f in ("input_per_m", "cache_hit_per_m", "output_per_m")],
        )
        .withColumn("match_key", F.lower("model"))
    )
    o = overrides.select(
        "match_key", F.lit(True).alias("o_found"), F.col("currency").alias("o_currency"),
        *[F.col(f).alias(f"o_{f}") for f in PRICE_FIELDS],
    )
    joined = entries.join(o, "match_key", "full")
    overridden = F.coalesce("o_found", F.lit(False))
    has_promo = F.col("promo_until").isNotNull()
    active = has_promo & promo_active(now_ms)
    expired = has_promo & ~active
    tiered = F.size("tiers") > 0

    def price(field: str) -> Column:
        plain = F.col(field)
        if field == "cache_storage_per_m":
            plain = F.when(~(tiered & active), plain)
        if f"list_{field}" in entries.columns:
            plain = F.when(expired, F.col(f"list_{field}")).otherwise(plain)
        return F.when(overridden, F.col(f"o_{field}")).otherwise(plain).alias(field)

    return joined.select(
        F.coalesce("provider", F.lit("override")).alias("provider"),
        F.coalesce("display_name", "match_key").alias("display_name"),
        F.coalesce("model", "match_key").alias("model"),
        F.when(overridden, F.col("o_currency")).otherwise(F.col("currency")).alias("currency"),
        *[price(f) for f in PRICE_FIELDS],
        F.when(~overridden & tiered, F.col("tiers")).alias("tiers"),
        overridden.alias("overridden"),
        F.when(has_promo, active & ~overridden).alias("promo_current"),
        F.when(overridden | expired, F.col("table_updated_at")).otherwise(F.col("entry_updated_at")).alias("updated_at"),
        F.col("rank").alias("table_rank"),
    ).orderBy(F.asc_nulls_last("table_rank"), "model")
