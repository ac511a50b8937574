"""Duels: scoring, opponents, weighted draws, event folding and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.operators.prices import midpoint
from cardloom.plans.session import stage
from cardloom.plans.skew import global_ordinal, nearest_anchors, running_sum, top_k

_MOD = 2147483648


def hash_int(seed: Column, draw: Column) -> Column:
    """Deterministic integer in [0, 2^31); the seed is reduced first so that the product
    stays inside a BIGINT."""
    return F.pmod(F.pmod(seed, F.lit(_MOD)) * F.lit(2654435761) + F.pmod(draw, F.lit(_MOD)) * F.lit(40503),
                  F.lit(_MOD))


def hash_uniform(seed: Column, draw: Column) -> Column:
    return hash_int(seed, draw) / F.lit(float(_MOD))


def side_score(cards: DataFrame, prices: DataFrame, by: str = "pull_id", digits: int = 2) -> DataFrame:
    """Sum of known midpoints per pull, 0 when nothing is priced."""
    mid = midpoint(F.col("usd_low"), F.col("usd_high"))
    priced = prices.select("match_id", mid.alias("__m")).filter("__m IS NOT NULL")
    return (cards.select(by, "match_id").join(priced, "match_id", "left").groupBy(by)
            .agg(F.round(F.coalesce(F.sum("__m"), F.lit(0.0)), digits).alias("score")))


def score_duels(duels: DataFrame, scores: DataFrame) -> DataFrame:
    """``duels``: duel_id, challenger_pull, opponent_pull."""
    def side(name):
        return scores.select(F.col("pull_id").alias(f"{name}_pull"), F.col("score").alias(f"{name}_score"))

    j = duels.join(side("challenger"), "challenger_pull", "left").join(side("opponent"), "opponent_pull", "left")
    a, b = F.coalesce("challenger_score", F.lit(0.0)), F.coalesce("opponent_score", F.lit(0.0))
    return j.withColumns({"challenger_score": a, "opponent_score": b,
                          "winner": F.when(a > b, "challenger").when(b > a, "opponent").otherwise("tie")})


def random_opponents(challenges: DataFrame, pulls: DataFrame, seed: int = 7) -> DataFrame:
    """One pseudo-random verified pull of another trainer per challenge, any with equal chance.

    Pulls get positions in the order (trainer, pull), so a trainer's own pulls stand together. A
    challenge draws among the positions that are not its trainer's: a draw at or beyond the own
    block moves on by the block's length. Then it is one equi join on the position. NULL
    where no other trainer has a pull.

    ``challenges``: pull_id, trainer_id; ``pulls``: verified pull_id, trainer_id (unique)."""
    placed = global_ordinal(pulls.select("pull_id", "trainer_id"), "trainer_id", ["pull_id"], "at")
    own = placed.groupBy("trainer_id").agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__own"))
    total = pulls.agg(F.count(F.lit(1)).alias("n")).scalar()
    bits = hash_int(F.col("pull_id"), F.lit(seed)) * F.lit(_MOD) + hash_int(F.col("pull_id"), F.lit(seed + 1))
    others = F.col("__n") - F.coalesce("__own", F.lit(0))
    draw = F.when(others > 0, F.pmod(bits, others))
    asked = (challenges.select("pull_id", "trainer_id").join(own, "trainer_id", "left").withColumn("__n", total)
             .withColumn("__x", draw)
             .withColumn("__at", F.when(F.col("__x") < F.coalesce("__first", F.col("__n")), F.col("__x"))
                         .otherwise(F.col("__x") + F.col("__own"))))
    hit = placed.select(F.col("at").alias("__at"), F.col("pull_id").alias("opponent_pull"),
                        F.col("trainer_id").alias("opponent_id"))
    return asked.join(hit, "__at", "left").select("pull_id", "trainer_id", "opponent_pull", "opponent_id")


def weighted_draws(battles: DataFrame, candidates: DataFrame, rates: DataFrame,
                   default: float = 0.01, floor: float = 0.001, order: Column | None = None) -> DataFrame:
    """Draws with replacement from the priced cards of each battle's set (all sets when
    that set has none). Weights are pull rates if any candidate of the pool has one,
    else uniform; a card with several rates keeps the one with most packs.

    ``battles``: battle_id, set_id, n; ``candidates``: set_id, match_id, value;
    ``rates``: match_id, blended_rate, packs. Each draw's hash uniform is placed on the
    pool's cumulative weights (cards laid out by ``order``, default a hash of the id) by an
    as-of scan, so draws and cards are never paired."""
    rate = rates.groupBy("match_id").agg(
        F.max_by("blended_rate", F.struct("packs", "blended_rate")).alias("rate"))
    pools = candidates.select(F.col("set_id").alias("pool"), "match_id", "value").unionByName(
        candidates.select(F.lit("*").alias("pool"), "match_id", "value")).join(rate, "match_id", "left")
    pools = stage(pools, "pools")
    rated = pools.groupBy("pool").agg(F.bool_or(F.col("rate").isNotNull()).alias("any_rate"))
    w = F.when(F.col("any_rate"), F.greatest(F.coalesce("rate", F.lit(default)), F.lit(floor))).otherwise(1.0)
    pools = stage(pools.join(rated, "pool").withColumn("w", w), "pools")
    rank = F.pmod(F.crc32(F.col("match_id").cast("binary")), F.lit(4096)) if order is None else order
    cum = running_sum(pools.withColumn("__o", rank), ["pool"], ["__o", "match_id"], [F.floor(F.col("__o") / 16)],
                      F.col("w"), "below", inclusive=False)
    total = pools.groupBy("pool").agg(F.sum("w").alias("total"))
    have = candidates.select(F.col("set_id").alias("pool")).distinct().withColumn("__have", F.lit(True))
    draws = (battles.withColumn("draw", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1)))
             .withColumn("pool", F.col("set_id")).join(have, "pool", "left")
             .withColumn("pool", F.when(F.col("__have"), F.col("pool")).otherwise("*"))
             .join(total, "pool")
             .withColumn("u", hash_uniform(F.col("battle_id"), F.col("draw")) * F.col("total"))
             .select("pool", "battle_id", "draw", "u"))
    hit = nearest_anchors(draws, cum.withColumn("tag", F.struct("match_id", "value")), ["pool"],
                          "u", "below", "tag", width=0.25)
    return hit.select("battle_id", "draw", F.col("before.label.match_id").alias("match_id"),
                      F.col("before.label.value").alias("value"))


def fold_events(events: DataFrame, pulls: DataFrame, trainers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(battles, rejects) of a challenge event log.

    ``events``: event_id, battle_id, kind (challenge/accept/decline), actor, pull_id,
    handle, at. A challenge needs an owned verified pull, a known handle and another
    trainer; an accept or decline must come from the named opponent while pending, an
    accept with an owned verified pull. The first valid terminal event wins."""
    owned = pulls.select(F.col("pull_id").alias("__p"), F.col("trainer_id").alias("__owner"), "verified")
    who = trainers.select(F.col("handle").alias("__h"), F.col("trainer_id").alias("named"))
    e = (events.join(owned, F.col("pull_id") == F.col("__p"), "left")
         .withColumn("__h", F.lower(F.trim("handle"))).join(who, "__h", "left"))
    bad_pull = (F.when(F.col("__owner").isNull() | (F.col("__owner") != F.col("actor")), "pull_not_found")
                .when(~F.coalesce("verified", F.lit(False)), "unverified_pull"))
    opened = e.filter("kind = 'challenge'").withColumn(
        "reason", F.coalesce(bad_pull, F.when(F.col("named").isNull(), "unknown_handle")
                             .when(F.col("named") == F.col("actor"), "self_challenge")))
    start = top_k(opened.filter("reason IS NULL"), ["battle_id"], ["at", "event_id"], 1).select(
        "battle_id", F.col("actor").alias("challenger_id"), F.col("pull_id").alias("challenger_pull"),
        F.col("named").alias("opponent_id"), F.col("at").alias("opened_at"))
    answers = e.filter("kind <> 'challenge'").drop("named").join(start, "battle_id", "left").withColumn(
        "reason", F.when(F.col("opponent_id").isNull() | (F.col("opponent_id") != F.col("actor"))
                         | (F.col("at") < F.col("opened_at")), "challenge_not_found")
        .otherwise(F.when(F.col("kind") == "accept", bad_pull)))
    end = top_k(answers.filter("reason IS NULL"), ["battle_id"], ["at", "event_id"], 1).select(
        "battle_id", "kind", F.col("pull_id").alias("opponent_pull"), F.col("event_id").alias("__won"))
    late = answers.filter("reason IS NULL").join(end.select("battle_id", "__won"), "battle_id") \
                  .filter(F.col("event_id") != F.col("__won")).withColumn("reason", F.lit("challenge_not_found"))
    battles = start.join(end, "battle_id", "left").select(
        "battle_id", "challenger_id", "challenger_pull", "opponent_id",
        F.when(F.col("kind") == "accept", F.col("opponent_pull")).alias("opponent_pull"),
        F.when(F.col("kind") == "accept", "resolved").when(F.col("kind") == "decline", "declined")
         .otherwise("pending").alias("status"))
    cols = ["event_id", "battle_id", "kind", "reason"]
    rejects = (opened.filter("reason IS NOT NULL").select(*cols)
               .unionByName(answers.filter("reason IS NOT NULL").select(*cols))
               .unionByName(late.select(*cols)))
    return battles, rejects


def masked_view(battles: DataFrame, cards: DataFrame, trainers: DataFrame) -> DataFrame:
    """One row per battle and viewer with both sides' card totals and what the viewer
    may see: the opponent side is hidden while a friend challenge is pending, a random
    opponent stays anonymous, the outcome is relative to the viewer.

    ``cards``: pull_id, n_cards, value per pull; ``trainers``: trainer_id, handle."""
    def side(name):
        return cards.select(F.col("pull_id").alias(f"{name}_pull"), F.col("n_cards").alias(f"{name}_cards"),
                            F.col("value").alias(f"{name}_value"))

    names = trainers.select(F.col("trainer_id").alias("opponent_id"), F.col("handle").alias("opponent_handle"))
    j = (battles.join(side("challenger"), "challenger_pull", "left")
         .join(side("opponent"), "opponent_pull", "left").join(names, "opponent_id", "left"))
    viewers = F.explode(F.array(F.struct(F.col("challenger_id").alias("viewer"), F.lit("challenger").alias("role")),
                                F.struct(F.col("opponent_id").alias("viewer"), F.lit("opponent").alias("role"))))
    j = j.withColumn("__v", viewers).filter(F.col("__v.viewer").isNotNull())
    hidden = (F.col("mode") == "friend") & (F.col("status") == "pending")
    outcome = (F.when(F.col("status") != "resolved", None).when(F.col("winner") == "tie", "tie")
               .when(F.col("winner") == F.col("__v.role"), "win").otherwise("loss"))
    return j.select("battle_id", "mode", "status", "__v.viewer", "__v.role", "challenger_cards", "challenger_value",
                    F.when(~hidden, F.col("opponent_cards")).alias("opponent_cards"),
                    F.when(~hidden, F.col("opponent_value")).alias("opponent_value"),
                    F.when(F.col("mode") != "random", F.col("opponent_handle")).alias("opponent_handle"),
                    outcome.alias("outcome"))


def win_loss(view: DataFrame) -> DataFrame:
    """Wins, losses and ties over the battles a viewer can list: own challenges, and
    friend challenges against them that are no longer pending."""
    listed = view.filter((F.col("role") == "challenger") |
                         ((F.col("mode") == "friend") & (F.col("status") != "pending")))
    return listed.groupBy("viewer").agg(*[
        F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))])
