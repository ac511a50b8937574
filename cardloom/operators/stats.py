"""Pull-rate statistics: modal sets, hit rates, prior blending, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardloom.plans.skew import mode_per, top_k

# Prior rates per rarity, prior strength, and the rate of every card
# and of an unknown rarity.
RARITY_RATES = {
    "Common": 0.99, "Uncommon": 0.95, "Rare": 0.5, "Double Rare": 0.33, "Ultra Rare": 0.16,
    "Illustration Rare": 0.2, "Special Illustration Rare": 0.05, "Hyper Rare": 0.04,
    "Shiny Rare": 0.08, "Promo": 0.0,
}
PRIOR_STRENGTH = 20.0
DEFAULT_RATE = 0.05

MIN_SAMPLE, Z_THRESHOLD, CONCENTRATION = 30, 3.0, 0.5


def modal_set(cards: DataFrame, group: str = "pull_id") -> DataFrame:
    """(pull, set_id): the pull's most frequent set; ties go to the set seen at the
    smallest ``row_index``, then to the smaller id. Pulls without a set are absent."""
    return mode_per(cards, [group], "set_id", "row_index").drop("votes")


def set_pack_counts(modal: DataFrame) -> DataFrame:
    return modal.groupBy("set_id").agg(F.count(F.lit(1)).alias("packs"))


def seed_priors(spark: SparkSession, rates: dict[str, float] | None = None,
                strength: float = PRIOR_STRENGTH) -> DataFrame:
    """(key, alpha, beta) per rarity from a rate table."""
    table = RARITY_RATES if rates is None else rates
    df = spark.createDataFrame(list(table.items()), "key string, rate double")
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rate")))
    return df.select("key", (rate * strength).alias("alpha"), ((1 - rate) * strength).alias("beta"))


def blend(hits: Column, packs: Column, alpha: Column, beta: Column,
          mode: str = "reference") -> Column:
    """``reference``: (a+hits)/(b+packs), which may exceed 1; ``beta_binomial``:
    (a+hits)/(a+b+packs). A denominator of zero or less gives 0."""
    below = beta + packs if mode == "reference" else alpha + beta + packs
    return F.when(below <= 0, F.lit(0.0)).otherwise((alpha + hits) / below)


def _rates(cards: DataFrame, modal: DataFrame, key: str, metadata: bool = False) -> DataFrame:
    """Packs of each modal set that contain each key; with ``metadata`` also ``m``, the first row of
    the key in its newest pack. One aggregate by pack and key serves both."""
    held = cards.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    hits = [F.count(F.lit(1)).alias("hits")]
    if metadata:
        held = held.groupBy("pull_id", key).agg(F.min(F.struct("row_index", "card_number", "name")).alias("m"))
        hits.append(F.max_by("m", "pull_id").alias("m"))
    else:
        held = held.select("pull_id", key).distinct()
    hits = held.join(modal, "pull_id").groupBy("set_id", key).agg(*hits)
    return (hits.join(set_pack_counts(modal), "set_id")
                .withColumn("raw_rate", F.col("hits") / F.col("packs")))


def card_rates(cards: DataFrame, modal: DataFrame, priors: DataFrame | None = None,
               mode: str = "reference", metadata: bool = True) -> DataFrame:
    """(set_id, match_id, hits, packs, raw_rate, blended_rate[, card_number, name]).

    ``priors`` (set_id, match_id, alpha, beta) overrides the generic card prior.
    Metadata come from the card's newest pack (largest pull id), first row in it."""
    rates = _rates(cards, modal, "match_id", metadata)
    if priors is not None:
        rates = rates.join(priors.select("set_id", "match_id", "alpha", "beta"),
                           ["set_id", "match_id"], "left")
    else:
        rates = rates.withColumns({"alpha": F.lit(None).cast("double"), "beta": F.lit(None).cast("double")})
    alpha = F.coalesce("alpha", F.lit(DEFAULT_RATE * PRIOR_STRENGTH))
    beta = F.coalesce("beta", F.lit((1 - DEFAULT_RATE) * PRIOR_STRENGTH))
    rates = rates.withColumn("blended_rate", blend(F.col("hits"), F.col("packs"), alpha, beta, mode))
    if metadata:
        rates = rates.withColumns({"card_number": F.col("m.card_number"), "name": F.col("m.name")}).drop("m")
    return rates.drop("alpha", "beta")


def rarity_rates(cards: DataFrame, modal: DataFrame, priors: DataFrame | None = None,
                 mode: str = "reference") -> DataFrame:
    """As ``card_rates`` per rarity; unknown rarities take the default rate."""
    priors = priors if priors is not None else seed_priors(cards.sparkSession)
    rates = _rates(cards, modal, "rarity").join(
        priors.withColumnRenamed("key", "rarity"), "rarity", "left")
    alpha = F.coalesce("alpha", F.lit(DEFAULT_RATE * PRIOR_STRENGTH))
    beta = F.coalesce("beta", F.lit((1 - DEFAULT_RATE) * PRIOR_STRENGTH))
    return rates.withColumn("blended_rate",
                            blend(F.col("hits"), F.col("packs"), alpha, beta, mode)).drop("alpha", "beta")


def z_score(raw: Column, prior: Column, packs: Column) -> Column:
    spread = F.greatest(prior * (1 - prior), F.lit(1e-9)) / F.greatest(packs, F.lit(1))
    return (raw - prior) / F.sqrt(spread)


def deviation_from_prior(rates: DataFrame, prior_rate: float = DEFAULT_RATE,
                         min_sample: int = MIN_SAMPLE, threshold: float = Z_THRESHOLD) -> DataFrame:
    z = z_score(F.col("raw_rate"), F.lit(prior_rate), F.col("packs"))
    return (rates.filter(F.col("packs") >= min_sample).withColumn("z", z)
                 .filter(F.abs("z") > threshold)
                 .withColumn("severity", F.abs("z")))


def submitter_concentration(modal: DataFrame, pulls: DataFrame, min_sample: int = MIN_SAMPLE,
                            share: float = CONCENTRATION) -> DataFrame:
    """Sets in which one trainer holds more than ``share`` of the packs."""
    by_trainer = (modal.join(pulls.select("pull_id", "trainer_id"), "pull_id")
                  .groupBy("set_id", "trainer_id").agg(F.count(F.lit(1)).alias("n")))
    per_set = by_trainer.groupBy("set_id").agg(
        F.sum("n").alias("packs"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("trainer_id").alias("t"))).alias("top"))
    return (per_set.select("set_id", "packs", F.col("top.t").alias("top_trainer"),
                           (-F.col("top.n") / F.col("packs")).alias("share"))
                   .filter((F.col("packs") >= min_sample) & (F.col("share") > share)))


def anomalies(rates: DataFrame, modal: DataFrame, pulls: DataFrame, **limits) -> DataFrame:
    """Both detectors as one fact table with a JSON ``detail``."""
    dev = deviation_from_prior(rates).select(
        F.lit("deviation_from_prior").alias("detector"), F.lit("card").alias("target_type"),
        "set_id", "match_id", "severity",
        F.to_json(F.struct(F.col("raw_rate").alias("observed"), F.lit(DEFAULT_RATE).alias("prior"),
                           "z", "packs")).alias("detail"))
    con = submitter_concentration(modal, pulls, **limits).select(
        F.lit("submitter_concentration").alias("detector"), F.lit("set").alias("target_type"),
        "set_id", F.lit(None).cast("string").alias("match_id"), F.col("share").alias("severity"),
        F.to_json(F.struct("top_trainer", "share", "packs")).alias("detail"))
    return dev.unionByName(con).withColumn("status", F.lit("open"))


def with_status(found: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Apply review decisions; anything but open/reviewed/dismissed is ignored."""
    legal = overrides.filter(F.col("status").isin("open", "reviewed", "dismissed"))
    return (found.join(legal.withColumnRenamed("status", "decided"), keys, "left")
                 .withColumn("status", F.coalesce("decided", "status")).drop("decided"))


def pending_derivations(pulls: DataFrame, limit: int = 200) -> DataFrame:
    """Oldest verified pulls still waiting for derivation (live ones excepted)."""
    return (pulls.filter((F.col("derive_status") == "pending") & (F.col("capture_path") != "live"))
                 .orderBy("created_at", "pull_id").limit(limit))


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Newest row per key."""
    return top_k(df, keys, [F.desc(order), F.desc(tie)], 1)
