"""Price snapshots: extraction, universe, staleness, diffs and valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def extract_prices(payload: Column) -> Column:
    """STRUCT(usd_low, usd_high, eur_trend) of a JSON payload: min and max numeric
    ``market_price``, first numeric ``trend``. Quoted numbers are not numbers, so the
    price rows are read as variants and typed by ``schema_of_variant``."""
    v = F.try_parse_json(payload)

    def numbers(path: str, field: str) -> Column:
        rows = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
        numeric = F.filter(rows, lambda r: F.schema_of_variant(F.try_variant_get(r, f"$.{field}", "variant"))
                           .rlike("^(BIGINT|DOUBLE|DECIMAL)"))
        return F.transform(numeric, lambda r: F.try_variant_get(r, f"$.{field}", "double"))

    market = numbers("$.tcgplayer.prices", "market_price")
    return F.struct(F.array_min(market).alias("usd_low"), F.array_max(market).alias("usd_high"),
                    F.get(numbers("$.cardmarket.prices", "trend"), F.lit(0)).alias("eur_trend"))


def card_universe(confirmed: DataFrame, derived: DataFrame) -> DataFrame:
    """One (match_id, set_id, card_number, name) per card; derived metadata win."""
    cols = ["match_id", "set_id", "card_number", "name"]
    both = (confirmed.select(*cols, F.lit(1).alias("pref"))
            .unionByName(derived.select(*cols, F.lit(0).alias("pref")))
            .filter(F.col("match_id").isNotNull()))
    best = F.min(F.struct("pref", "set_id", "card_number", "name")).alias("m")
    return both.groupBy("match_id").agg(best).select("match_id", "m.set_id", "m.card_number", "m.name")


def needs_refresh(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: newest done snapshot, and whether a new one is due at ``now``."""
    newest = log.filter(F.col("status") == "done").agg(F.max("created_at").alias("newest"))
    return newest.withColumn("due", F.col("newest").isNull() |
                             (now >= F.col("newest") + F.make_dt_interval(F.lit(days))))


def current_snapshot(log: DataFrame) -> DataFrame:
    """One row with the newest ``done`` snapshot id."""
    return (log.filter(F.col("status") == "done")
               .agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id")))


def in_snapshot(facts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Facts of the one snapshot named by a single-row frame (scalar subquery)."""
    return facts.where(F.col("snapshot_id") == snapshot.select("snapshot_id").scalar())


def midpoint(low: Column, high: Column) -> Column:
    """NULL unless both bounds are known."""
    return (low + high) / 2


def price_diff(previous: DataFrame, current: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Cards whose midpoint moved by at least ``threshold`` between two snapshots."""
    mid = midpoint(F.col("usd_low"), F.col("usd_high"))
    old = previous.select("match_id", mid.alias("old")).filter(F.col("old").isNotNull() & (F.col("old") != 0))
    new = current.select("match_id", "set_id", mid.alias("new")).filter(F.col("new").isNotNull())
    return (new.join(old, "match_id").withColumn("pct", (F.col("new") - F.col("old")) / F.col("old"))
               .filter(F.abs("pct") >= threshold).withColumn("severity", F.abs("pct")))


def enrich(cards: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join of price bounds. Prices are one row per card, so AQE broadcasts
    them when their measured size allows and shuffles otherwise."""
    return cards.join(prices.select("match_id", "usd_low", "usd_high"), "match_id", "left")


def pull_value(cards: DataFrame, prices: DataFrame, by: str = "pull_id", digits: int = 2) -> DataFrame:
    """Sum of midpoints per pull, NULL when nothing is priced."""
    mid = midpoint(F.col("usd_low"), F.col("usd_high"))
    return enrich(cards, prices).groupBy(by).agg(F.round(F.sum(mid), digits).alias("value"))


def collection_value(rows: DataFrame, prices: DataFrame, as_of: Column, digits: int = 2) -> DataFrame:
    """Per trainer: total quantity, value, and the price date if anything is priced."""
    mid = midpoint(F.col("usd_low"), F.col("usd_high"))
    out = enrich(rows, prices).groupBy("trainer_id").agg(
        F.sum("qty").alias("total_qty"), F.round(F.sum(mid * F.col("qty")), digits).alias("value"))
    return out.withColumn("priced_as_of", F.when(F.col("value").isNotNull(), as_of))
