"""Collections: save guard, identity, species log and encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.plans.skew import running_sum


def is_flagged(needs_review: Column, reason: Column, state: Column) -> Column:
    return (F.coalesce(needs_review, F.lit(False)) | reason.isNotNull()
            | F.coalesce(state.isin("pending_vlm", "vlm_failed"), F.lit(False)))


def save_guard(cards: DataFrame) -> DataFrame:
    """Adds ``skip_reason``: degenerate key first, then flagged and not confirmed."""
    flagged = is_flagged(F.col("needs_review"), F.col("reason"), F.col("state"))
    return cards.withColumn(
        "skip_reason", F.when(S.is_degenerate_key(F.col("identity_key")), "degenerate_key")
                        .when(flagged & ~F.coalesce("confirmed", F.lit(False)), "flagged_unconfirmed"))


def catalog_card_id(cards: DataFrame, sets: DataFrame, set_id: str, set_code: str,
                    numerator: str) -> DataFrame:
    """Catalog card id through the set row found by id, else by upper-cased code."""
    dim = sets.select("set_id", F.upper("set_code").alias("set_code"), "promo_prefix",
                      "local_id_prefixed", F.coalesce("catalog_id", "set_code").alias("catalog"))
    row = F.struct("promo_prefix", "local_id_prefixed", "catalog")
    by_id = dim.select(F.col("set_id").alias(set_id), row.alias("__i"))
    by_code = dim.select(F.col("set_code").alias("__code"), row.alias("__c"))
    found = (cards.withColumn("__code", F.upper(F.col(set_code)))
             .join(by_id, set_id, "left").join(by_code, "__code", "left")
             .withColumn("__s", F.coalesce("__i", "__c")))
    local = N.catalog_local_id(F.col(numerator), F.col("__s.promo_prefix"), F.col("__s.local_id_prefixed"))
    return (found.withColumn("card_id", F.concat(F.col("__s.catalog"), F.lit("-"), local))
                 .drop("__i", "__c", "__s", "__code"))


def dex(pull_cards: DataFrame, collection: DataFrame) -> DataFrame:
    """Species log per trainer over pulls and collection.

    ``pull_cards``: trainer_id, species, image_url, created_at, tie;
    ``collection``: same plus qty. Count adds card rows and quantities; art is the
    newest from pulls, else from the collection."""
    def side(df, amount, p):
        return (df.filter(F.col("species").isNotNull()).groupBy("trainer_id", "species")
                  .agg(amount.alias(f"{p}_count"), F.min("created_at").alias(f"{p}_first"),
                       F.max(F.when(F.col("image_url").isNotNull(),
                                    F.struct("created_at", "tie", "image_url"))).alias(f"{p}_art")))

    a = side(pull_cards, F.count(F.lit(1)), "p")
    b = side(collection, F.sum("qty"), "c")
    return a.join(b, ["trainer_id", "species"], "full").select(
        "trainer_id", "species",
        (F.coalesce("p_count", F.lit(0)) + F.coalesce("c_count", F.lit(0))).alias("count"),
        F.least("p_first", "c_first").alias("first_seen"),
        F.coalesce("p_art.image_url", "c_art.image_url").alias("image_url"))


def encounters(events: DataFrame, bucket: Column) -> DataFrame:
    """Per pull and species: lifetime count as of that pull, and whether it is new.

    ``events``: trainer_id, species, created_at, pull_id (one row per card). Cards are
    counted per pull first; the running total is a two-level scan by time."""
    per = (events.filter(F.col("species").isNotNull())
           .groupBy("trainer_id", "species", "created_at", "pull_id")
           .agg(F.count(F.lit(1)).alias("in_pull")))
    seen = running_sum(per, ["trainer_id", "species"], ["created_at", "pull_id"], [bucket],
                       F.col("in_pull"), "lifetime")
    return seen.withColumn("is_new", F.col("lifetime") == F.col("in_pull"))


def natural_order(set_code: Column, numerator: Column) -> list[Column]:
    """Collection order: set, digits first, numeric value, text."""
    digits = F.coalesce(numerator.rlike(r"^\d+$"), F.lit(False))
    return [F.coalesce(set_code, F.lit("")), F.when(digits, 0).otherwise(1),
            F.when(digits, numerator.cast("bigint")).otherwise(0), F.coalesce(numerator, F.lit(""))]


def backfill_species(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Fill a missing species from the card name; adds ``changed`` and ``candidate``."""
    keyed = cards.withColumn("__key", S.species_key(F.col("name")))
    out = keyed.join(known.select(F.col("key").alias("__key"), F.col("display").alias("__sp")),
                     "__key", "left")
    candidate = F.col("species").isNull() & F.col("name").isNotNull()
    return (out.withColumns({"candidate": candidate, "changed": candidate & F.col("__sp").isNotNull()})
               .withColumn("species", F.coalesce("species", "__sp")).drop("__key", "__sp"))
