"""Pack-code claims: at most one verified pull per code, first writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardloom.plans.session import stage
from cardloom.plans.skew import top_k


def first_valid_claim(pulls: DataFrame, code: str = "code_normalized",
                      order: tuple[str, ...] = ("created_at", "pull_id")) -> DataFrame:
    """The verified pulls: earliest well-formed claim of each code.

    A rank limit, so a code claimed by millions still sends one row per map task."""
    ok = pulls.filter(F.col("code_format_ok") & F.col(code).isNotNull())
    return top_k(ok, [code], list(order), 1)


def mark_verified(pulls: DataFrame, code: str = "code_normalized") -> DataFrame:
    """All pulls with ``verified``; the join key is the pull id, never the code."""
    won = first_valid_claim(pulls, code).select("pull_id", F.lit(True).alias("verified"))
    return pulls.join(won, "pull_id", "left").withColumn(
        "verified", F.coalesce("verified", F.lit(False)))


def rescue_claims(claims: DataFrame, rereads: DataFrame, reread_id: str = "reread_id") -> DataFrame:
    """Replay first claims and later re-reads of unverified pulls over event time.

    ``claims`` is (pull_id, code_normalized, code_format_ok, created_at), ``rereads``
    is (reread_id, pull_id, code_normalized, code_format_ok, at), any number per pull. One outcome
    row per re-read, in the order of time then id:
    ``already_verified`` (the pull owned a code before), ``bad_format``, ``taken`` (another
    pull owns the code) or ``verified``. A pull wins one code, its first free one.

    Claims and re-reads are replayed together (claims first at one instant), so a re-read may take a
    code before a later claim. Whether an event wins depends on wins before it, so wins are found
    in rounds: the earliest open event of a code that is also its pull's earliest open one is
    certain; it closes the code and the pull. A round closes every code whose first event
    waits for nobody, so few are needed, and each reads only what is still open."""
    tries = stage(rereads.withColumn("ok", F.coalesce("code_format_ok", F.lit(False)) & F.col("code_normalized").isNotNull()), "tries")
    first = claims.filter(F.col("code_format_ok") & F.col("code_normalized").isNotNull()).select(
        F.lit(0).alias("kind"), F.col("pull_id").alias("id"), "pull_id", "code_normalized", F.col("created_at").alias("at"))
    again = tries.filter("ok").select(F.lit(1).alias("kind"), F.col(reread_id).alias("id"), "pull_id", "code_normalized", "at")
    events, won = stage(first.unionByName(again), "open"), None
    order, event = ["at", "kind", "id"], ["kind", "id"]
    while True:
        by_code = top_k(events, ["code_normalized"], order, 1).select(*event)
        by_pull = top_k(events, ["pull_id"], order, 1).select(*event)
        sure = stage(events.join(by_code, event, "left_semi").join(by_pull, event, "left_semi"), "won")
        if sure.isEmpty():
            break
        won = sure if won is None else stage(won.unionByName(sure), "won")
        events = stage(events.join(sure.select("pull_id"), "pull_id", "left_anti")
                       .join(sure.select("code_normalized"), "code_normalized", "left_anti"), "open")
    won = sure if won is None else won
    since = won.select("pull_id", F.struct(*order).alias("since"))
    now = F.struct("at", F.lit(1).alias("kind"), F.col(reread_id).alias("id"))
    return tries.join(since, "pull_id", "left").select(
        reread_id, "pull_id", "code_normalized",
        F.when(F.col("since") < now, "already_verified").when(~F.col("ok"), "bad_format")
         .when(F.col("since") == now, "verified").otherwise("taken").alias("outcome"))
