"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cardloom.llm.common import key_of, n_words, ranked, small
from cardloom.plans.session import stage

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Words of a block, and strips of a shard.
BLOCK, SHARD_STRIPS = 8, 1024


def targets(sizes: DataFrame, source: str = "source", size: str = "size",
            weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, key, source_size, target): sources by code point, NULL last, take ``weights`` in
    turn and share ``share`` of all words by weight; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight, until none is above.

    Each round of the sharing reads the table of sources once and brings two sums to the driver."""
    table = stage(sizes.groupBy(source).agg(F.sum(size).alias("source_size")), "sources")
    table = table.select("source_size", F.col(source).alias("source"), key_of(F.col(source)).alias("key"),
                         F.col(source).isNull().cast("int").alias("last"))
    table = ranked(table, "last", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    table = stage(table.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size")), "weights")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        # Sources at their cap keep it; the others share what is left.
        full = F.col("weight") * level > F.col("cap")
        left = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not left["weight"]:
            break
        now = (total - left["used"]) / left["weight"]
        if now <= level:
            break
        level = now
    return stage(table.select("source", "key", "source_size",
                              F.least(F.col("cap"), F.col("weight") * level).alias("target")), "targets")


def _bracket(share, total, n) -> tuple:
    """Seats that an item has surely and at most: rounding weight / divisor is the same method
    as taking the highest quotients, and under any divisor the seats of ``n`` items sum to their
    exact shares within n / 2. So two divisors give surely too few and surely enough."""
    few, many = F.greatest(total - n / 2 - 1, F.lit(0.0)), total + n / 2 + 1
    return F.floor(share * few + 0.5).cast("long"), F.floor(share * many + 0.5).cast("long")


def _next_quotients(seats: DataFrame, weight: str, *keep: str) -> DataFrame:
    """A row per seat between the two brackets, with its quotient weight / (2k + 1)."""
    return (seats.filter("_high > _low").select(*keep, weight, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
            .withColumn("_q", -F.col(weight) / (2 * F.col("_k") + 1)))


def apportion(items: DataFrame, total: int, weight: str, item: str) -> DataFrame:
    """Adds ``blocks``: ``total`` blocks go one by one to the item with the highest quotient
    weight / (2 blocks + 1), ties to the smaller ``item``. Only the last quotients are ranked,
    two or three an item, in a distributed sort."""
    whole = items.agg(F.sum(weight).alias("sum"), F.count(F.lit(1)).alias("n")).first()
    if not whole["sum"]:
        return items.withColumn("blocks", F.lit(0).cast("long"))
    low, high = _bracket(F.col(weight) / whole["sum"], F.lit(float(total)), F.lit(float(whole["n"])))
    df = items.withColumn("_low", low).withColumn("_high", high)
    rest = total - df.agg(F.sum("_low")).first()[0]
    won = (ranked(_next_quotients(df, weight, item), "_q", item, "_k", name="_place").filter(F.col("_place") < rest)
           .groupBy(item).agg(F.count(F.lit(1)).alias("_won")))
    return (df.join(won, item, "left").withColumn("blocks", F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_low", "_high", "_won"))


def apportion_by(items: DataFrame, by: str, total: str, weight: str, item: str) -> DataFrame:
    """``apportion`` in each group ``by`` with its own ``total``; a group's items are its shards,
    so their number is that of the shards at most."""
    group = Window.partitionBy(by)
    df = items.withColumn("_sum", F.sum(weight).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    share = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    low, high = _bracket(share, F.col(total), F.col("_n"))
    df = df.withColumn("_low", low).withColumn("_high", F.when(F.col("_sum") > 0, high).otherwise(low))
    df = stage(df.withColumn("_rest", F.col(total) - F.sum("_low").over(group)), "brackets")
    place = F.row_number().over(Window.partitionBy(by).orderBy("_q", item, "_k"))
    won = (_next_quotients(df, weight, by, item, "_rest").withColumn("_place", place).filter("_place <= _rest")
           .groupBy(by, item).agg(F.count(F.lit(1)).alias("_won")))
    return (df.join(won, [by, item], "left").withColumn("blocks", F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_sum", "_n", "_low", "_high", "_rest", "_won"))


def mix(strips: DataFrame, strip_id: str = "strip_id", text: str = "text", source: str = "source", seed: int = 7,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(strip_id, source, size, source_size, target, taken) for every strip transcript.

    ``size``: words of the text (NULL: 0). Blocks of ``BLOCK`` words are apportioned to the sources
    by their targets, then each source's blocks to its shards by their words. In a shard the
    strips of a source stand in seeded order; its blocks are taken from the front, and from the
    front again once all are taken, so no strip gives more than twice its size. The last block is cut
    where the words of the shard end. Shards have about ``SHARD_STRIPS`` strips by a hash of the
    id, so a source with a third of all rows is many groups. Reruns agree: order and shards
    depend on id, size and seed only; rows repeated under one id and size may swap."""
    rows = stage(strips.select(F.col(strip_id).alias("strip_id"), F.col(source).alias("source"),
                               n_words(F.col(text)).alias("size")), "sizes")
    return mix_sizes(rows, seed, weights, share, cap)


def mix_sizes(rows: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS,
              share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``mix`` for staged rows (strip_id, source, size)."""
    shards = max(1, -(-rows.count() // SHARD_STRIPS))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("strip_id").cast("string"), F.lit("null"))))
    rows = rows.withColumns({"key": key_of(F.col("source")), "mark": mark})
    rows = rows.withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % shards)
    goal = targets(rows, weights=weights, share=share, cap=cap)
    wanted = goal.agg(F.sum("target")).first()[0] or 0.0
    # Half a block counts as one; the targets sum to a multiple of a sixteenth, up to rounding.
    quota = apportion(goal, int(wanted / BLOCK + 0.5 + 1 / 32), "target", "key")
    held = stage(rows.groupBy("key", "shard").agg(F.sum("size").alias("words")), "held")
    split = apportion_by(held.join(quota.select("key", F.col("blocks").alias("source_blocks")), "key"),
                         "key", "source_blocks", "words", "shard")
    plan = stage(split.select("key", "shard", "words", (F.col("blocks") * BLOCK).alias("quota"))
                 .join(goal.select("key", "source_size", "target"), "key"), "plan")
    before = F.sum("size").over(Window.partitionBy("key", "shard").orderBy("mark", "size", "strip_id")
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(small(plan), ["key", "shard"])

    def part(quota):
        return F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("before")))
    return placed.select("strip_id", "source", "size", "source_size", "target",
                         (part(F.col("quota")) + part(F.col("quota") - F.col("words"))).cast("long").alias("taken"))
