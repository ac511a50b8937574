"""Pieces the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.plans.session import stage

#: A word is a longest run without these characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows a table may hold to be broadcast; it is counted first, and joined by shuffle beyond.
SMALL_ROWS = 20_000


def words(text: Column) -> Column:
    """The words of a text as an array (NULL and blank: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without making them: a word starts where no word went before."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def key_of(column: Column) -> Column:
    """A string that is never NULL and differs for NULL and every string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits, as an unsigned number, that are set in over half of the hashes (uint64): their SimHash."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A staged table, marked for broadcast when its counted rows stay below ``rows``; a
    larger one is joined by shuffle, where adaptive execution splits hot keys."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def ranked(table: DataFrame, *order: str, name: str = "rank", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the order of ``order`` (a total order, for
    repeatable results). Range partitions are sorted apart; only their row counts meet. ``keep`` names
    the columns to go on with, where some serve the order only."""
    parts = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stage(table.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
                   .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
                   .select(*(keep or table.columns))
                   .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = [(r["_part"], r["n"]) for r in
              placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).sort("_part").collect()]
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    offsets = table.sparkSession.createDataFrame(sorted(starts.items()) or [(0, 0)], "_part long, _start long")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft("_part", 33))
            .drop("_part", "_start", "_at"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for every node with
    a link. Links are undirected; loops and repeats do no harm.

    Rounds of contraction: each node points at its smallest neighbour (or itself), pointers
    are followed twice, links are rewritten to what their ends point at, loops vanish. Every
    round is written to the shared folder, so lineage stays short; only counts reach the
    driver. Minima are pre-aggregated, so a node with very many links is no hot group."""
    arcs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    arcs = stage(arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "arcs")
    roots = None
    while True:
        least = stage(arcs.groupBy("u").agg(F.min("v").alias("p"))
                      .select("u", F.least("u", "p").alias("p")), "least")
        second = least.select(F.col("u").alias("p"), F.col("p").alias("p2"))
        point = stage(least.join(second, "p", "left").select("u", F.coalesce("p2", "p").alias("p")), "point")
        if roots is None:
            roots = point.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = point.select(F.col("u").alias("root"), F.col("p").alias("next"))
            roots = stage(roots.join(step, "root", "left")
                          .select("node", F.coalesce("next", "root").alias("root")), "roots")
        tail = point.select(F.col("u").alias("u"), F.col("p").alias("pu"))
        head = point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        arcs = stage(arcs.join(tail, "u").join(head, "v").filter("pu <> pv")
                     .select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "arcs")
        if arcs.isEmpty():
            return roots
