"""Per-set similarity search: cosine top-k and perceptual-hash neighbours."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.plans.session import stage
from cardloom.plans.skew import top_k

ACCEPT_SCORE, ACCEPT_MARGIN = 0.85, 0.02
#: Segments of a hash and their bits; a probe must stand against so many references of a set to be cheaper than their product.
SEGMENTS, SEGMENT_BITS, PROBE_COST = 4, 16, 64
#: Probes that one task makes at a time.
PROBES = 1 << 20


def l2_normalize(v: Column, floor: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(floor)))


def blocked_products(queries: DataFrame, index: DataFrame, partition: str, score: Callable,
                     schema: str, block: int = 2048) -> DataFrame:
    """Run ``score(query block, index block)`` over every pair of blocks of a partition.

    Both sides of a partition are cut by id hash into blocks of about ``block`` rows and
    only blocks are replicated, so a hot partition becomes many equal tasks and no
    query-reference pair leaves a task unless ``score`` returns it."""
    sizes = (index.groupBy(partition).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__nr"))
             .join(queries.groupBy(partition).agg(
                 F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__nq")), partition))

    def cut(df, ident, mine, other, n_mine, n_other):
        return (df.join(sizes, partition)
                .withColumn(mine, F.pmod(F.xxhash64(ident), F.col(n_mine)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
                .drop("__nr", "__nq"))

    def renewed(df):    # fresh column identities: both sides may come from one table
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    keys = [partition, "__qb", "__rb"]
    q = renewed(cut(queries, "query_id", "__qb", "__rb", "__nq", "__nr"))
    i = renewed(cut(index, "ref_id", "__rb", "__qb", "__nr", "__nq"))
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(score, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _best_rows(k: int) -> Callable:
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "ref_id": [], "score": []})
        right = right.sort_values("ref_id")
        sims = np.round(np.stack(left["v"].to_numpy()).astype("float64")
                        @ np.stack(right["v"].to_numpy()).astype("float64").T, 9)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows, cols = np.repeat(np.arange(len(left)), best.shape[1]), best.ravel()
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows],
                             "ref_id": right["ref_id"].to_numpy()[cols], "score": sims[rows, cols]})
    return score


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _angle(a: Column, b: Column) -> Column:
    """The angle of two vectors of any length; of a vector without direction, none."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / norm)))).otherwise(0.0)


def pivot_blocks(index: DataFrame, partition: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(index with its block ``pb``, blocks): the references of a partition around pivots, one for every ``block`` of them.

    Pivots are the references with the smallest hashes of their ids; each reference goes to the pivot of the smallest angle. A block has its
    pivot, the largest angle ``spread`` of a member to it and the largest norm ``reach`` of a member, so the product of a
    query with any member is at most |q| * reach * cos(max(0, angle(q, pivot) - spread)), or 0 if that is below. A block of more
    than twice ``block`` members counts as several, dealt by hash (``slice``)."""
    sizes = index.groupBy(partition).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__np"))
    marked = index.withColumn("__mark", F.xxhash64("ref_id"))
    most = sizes.agg(F.max("__np")).first()[0] or 1
    picked = top_k(marked.select(partition, "ref_id", "__mark", "v"), [partition], ["__mark", "ref_id"], most, "__r") \
        .join(sizes, partition).filter(F.col("__r") <= F.col("__np")).select(partition, F.col("__r").alias("pb"), F.col("v").alias("__p"))
    picked = stage(picked, "pivots")
    met = index.join(picked, partition).select(*[F.col(c) for c in index.columns], "pb", _angle(F.col("v"), F.col("__p")).alias("__a"))
    near = met.groupBy(partition, "ref_id").agg(F.min(F.struct("__a", "pb")).alias("m"), F.first("v").alias("v"))
    placed = stage(near.select(partition, "ref_id", "v", "m.pb", F.col("m.__a").alias("__a"), F.sqrt(_dot(F.col("v"), F.col("v"))).alias("__norm")), "placed")
    blocks = placed.groupBy(partition, "pb").agg(F.max("__a").alias("spread"), F.max("__norm").alias("reach"),
                                                 F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("slices"))
    return placed.drop("__a", "__norm"), stage(blocks.join(picked, [partition, "pb"]), "blocks")


def top_k_cosine(queries: DataFrame, index: DataFrame, k: int = 5, partition: str = "set_id",
                 block: int = 2048, digits: int = 4) -> DataFrame:
    """Exact k nearest index vectors of the query's own set.

    ``queries``: query_id, partition, v; ``index``: ref_id, partition, v (unit vectors, or any: the score is their product).
    Partitions of one block are one matrix product. A larger one is cut around pivots (``pivot_blocks``): every query
    first meets the block of its best bound, then only the blocks whose bound reaches its k-th score, so no reference that could
    be among the k is left out. Each product keeps k rows per query and the final rank keeps k. Scores are compared at nine
    digits, ties go to the smaller ref_id."""
    schema = f"query_id {_type(queries, 'query_id')}, ref_id {_type(index, 'ref_id')}, score double"
    if not index.groupBy(partition).count().filter(F.col("count") > block).isEmpty():
        partial, _ = _pruned(queries, index, k, partition, block, schema)
    else:
        partial = blocked_products(queries, index, partition, _best_rows(k), schema, block)
    return top_k(partial, ["query_id"], [F.desc("score"), "ref_id"], k, "rank") \
        .withColumn("score", F.round("score", digits))


def _pruned(queries: DataFrame, index: DataFrame, k: int, partition: str, block: int, schema: str) -> tuple[DataFrame, dict]:
    """(best rows of the blocks visited, counts of visits possible and made)."""
    placed, blocks = pivot_blocks(index, partition, block)
    placed = placed.join(blocks.select(partition, "pb", "slices"), [partition, "pb"]).withColumn("slice", F.pmod(F.xxhash64("ref_id"), F.col("slices")).cast("int"))
    q = queries.select("query_id", partition, "v").join(blocks, partition)
    bound = F.greatest(F.lit(0.0), F.cos(F.greatest(F.lit(0.0), _angle(F.col("v"), F.col("__p")) - F.col("spread"))))
    # A little more than the bound, for the rounding of angles and scores.
    q = stage(q.select("query_id", partition, "pb", "slices", (F.sqrt(_dot(F.col("v"), F.col("v"))) * F.col("reach") * (bound + 1e-6) + 1e-8).alias("bound")), "bounds")

    def visit(wanted: DataFrame) -> DataFrame:
        asked = wanted.select("query_id", partition, "pb", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        turns = asked.groupBy(partition, "pb", "slice").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__turns"))
        left = asked.join(queries.select("query_id", partition, "v"), ["query_id", partition]).join(turns, [partition, "pb", "slice"]) \
            .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("__turns")).cast("int"))
        right = placed.join(turns, [partition, "pb", "slice"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("__turns") - 1)))
        keys = [partition, "pb", "slice", "turn"]
        pick = lambda df, c: df.select(*[F.col(x).alias(x) for x in (*keys, c, "v")])
        return pick(left, "query_id").groupBy(*keys).cogroup(pick(right, "ref_id").groupBy(*keys)).applyInPandas(_best_rows(k), schema)
    first = top_k(q, ["query_id", partition], [F.desc("bound"), "pb"], 1)
    met = stage(visit(first), "first")
    kth = top_k(met, ["query_id"], [F.desc("score"), "ref_id"], k, "r").groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    rest = q.join(first.select("query_id", partition, "pb"), ["query_id", partition, "pb"], "left_anti").join(kth, "query_id", "left")
    rest = stage(rest.filter(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("kth"))), "rest")
    counts = {"possible": q.count(), "visited": first.count() + rest.count()}
    return met.unionByName(stage(visit(rest), "more")), counts


def accept_with_margin(ranked: DataFrame, key: str = "query_id", accept: float = ACCEPT_SCORE,
                       margin: float = ACCEPT_MARGIN) -> DataFrame:
    """Best hit per query if it scores ``accept`` and leads the second by ``margin``."""
    two = ranked.filter("rank <= 2").groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("ref_id"))).alias("ref_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)
    return two.withColumn("accepted", (F.col("score") >= accept) & clear)


def sign_hash(v: Column, bits: int = 64) -> Column:
    """Bit i is set when the sum of the values i, i + bits, i + 2 bits, ... is positive: every
    value of the vector counts, and of 64 values each has its own bit."""
    zero = F.lit(0).cast("bigint")
    powers = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint") for i in range(bits)])
    last = F.size(v) - 1

    def signed(p, i):
        own = F.aggregate(F.sequence(i, last, F.lit(bits)), F.lit(0.0), lambda a, j: a + F.get(v, j))
        return F.when(i <= last, F.when(own > 0, p)).otherwise(zero)
    return F.aggregate(F.transform(powers, signed), zero, lambda a, x: a.bitwiseOR(F.coalesce(x, zero)))


def _segments(hash_: Column) -> Column:
    """(segment, value) of a hash."""
    part = lambda i: F.shiftrightunsigned(hash_, i * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return F.array(*[F.struct(F.lit(i).alias("segment"), part(i).alias("value")) for i in range(SEGMENTS)])


def probe_segments(asked: DataFrame, refs: DataFrame, cost: float = PROBE_COST) -> tuple[DataFrame, DataFrame]:
    """(found, open): multi-index hashing with a growing radius.

    Two hashes within ``SEGMENTS * (r + 1) - 1`` bits agree in some segment but for r bits. In round r, every query still open looks up its segments
    with r bits changed in the segment tables of its sets; once the best distance of a (query, set) is within the radius covered, it is
    exact, ties included. A round is made only in sets that are ``cost`` times larger than the probes of a
    query; ``open`` (query_id, set_id, hash) is what is left for full products. ``found``: query_id, set_id, d, ref_id, met."""
    sizes = stage(refs.groupBy("set_id").agg(F.count(F.lit(1)).alias("__refs")), "sizes")
    largest = sizes.agg(F.max("__refs")).first()[0] or 0
    table = refs.select("set_id", "ref_id", F.col("hash").alias("__h"), F.inline(_segments(F.col("hash"))))
    open_, best, found = asked.join(sizes, "set_id"), None, None
    for r in range(SEGMENT_BITS + 1):
        probes = SEGMENTS * comb(SEGMENT_BITS, r)
        if largest < cost * probes:
            break
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SEGMENT_BITS) if m.bit_count() == r])
        tried = stage(open_.filter(F.col("__refs") >= cost * probes), "tried")
        # The planner sees a small file, not the probes made of it: it is dealt out first, and the join is by merge at every size.
        dealt = tried.repartition(max(1, -(-tried.count() * probes // PROBES)), "query_id", "set_id", "hash")
        asked_ = dealt.select("query_id", "set_id", "hash", F.inline(_segments(F.col("hash")))).withColumn("__m", F.explode(masks)) \
            .withColumn("value", F.col("value").bitwiseXOR(F.col("__m")))
        met = asked_.join(table.hint("merge"), ["set_id", "segment", "value"]).groupBy("query_id", "set_id").agg(
            F.min(F.struct(F.bit_count(F.col("hash").bitwiseXOR(F.col("__h"))).alias("d"), "ref_id")).alias("b"), F.count(F.lit(1)).alias("met"))
        met = met if best is None else met.unionByName(best).groupBy("query_id", "set_id").agg(F.min("b").alias("b"), F.sum("met").alias("met"))
        best = stage(met, "probed")
        done = best.filter(F.col("b.d") <= SEGMENTS * (r + 1) - 1)
        done = stage(done.join(tried.select("query_id", "set_id").distinct(), ["query_id", "set_id"], "left_semi"), "done")
        found = done if found is None else found.unionByName(done)
        open_ = stage(open_.join(done.select("query_id", "set_id"), ["query_id", "set_id"], "left_anti"), "open")
    if found is None:
        found = asked.join(refs.select("set_id", "ref_id"), "set_id").limit(0).select(
            "query_id", "set_id", F.struct(F.lit(0).alias("d"), "ref_id").alias("b"), F.lit(0).cast("long").alias("met"))
    return found.select("query_id", "set_id", "b.d", "b.ref_id", "met"), open_.select("query_id", "set_id", "hash")


def nearest_hash_per_set(queries: DataFrame, refs: DataFrame, allowed: DataFrame,
                         block: int = 4096, cost: float = PROBE_COST) -> DataFrame:
    """Hamming nearest neighbour of each query among its allowed sets.

    ``queries``: query_id, hash (several candidate hashes per query allowed); ``refs``:
    set_id, ref_id, hash; ``allowed``: query_id, set_id. The second distance is that of
    the next best other set. Equal hashes of a set are folded to the smallest ref. Large sets are searched by
    multi-index hashing (``probe_segments``); what that leaves open, and small sets, by block products that return one row
    per query."""
    folded = stage(refs.groupBy("set_id", "hash").agg(F.min("ref_id").alias("ref_id")), "folded")
    asked = queries.join(allowed, "query_id").select("query_id", "set_id", "hash")
    probed, asked = probe_segments(asked, folded, cost)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "set_id": [], "d": [], "ref_id": []})
        right = right.sort_values("ref_id")
        bits = np.bitwise_count(left["hash"].to_numpy("int64").view("uint64")[:, None]
                               ^ right["hash"].to_numpy("int64").view("uint64")[None, :])
        best = bits.argmin(axis=1)
        out = pd.DataFrame({"query_id": left["query_id"].to_numpy(), "set_id": left["set_id"].to_numpy(),
                            "d": bits[np.arange(len(left)), best].astype("int32"),
                            "ref_id": right["ref_id"].to_numpy()[best]})
        return out.sort_values(["d", "ref_id"]).drop_duplicates("query_id")

    schema = (f"query_id {_type(queries, 'query_id')}, set_id {_type(refs, 'set_id')}, d int, "
              f"ref_id {_type(refs, 'ref_id')}")
    partial = blocked_products(asked, folded, "set_id", score, schema, block).unionByName(probed.drop("met"))
    per_set = partial.groupBy("query_id", "set_id").agg(F.min(F.struct("d", "ref_id")).alias("b"))
    two = top_k(per_set.select("query_id", "set_id", "b.d", "b.ref_id"), ["query_id"], ["d", "set_id"], 2, "rank")

    def at(rank, column):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return two.groupBy("query_id").agg(
        at(1, "set_id").alias("set_id"), at(1, "ref_id").alias("ref_id"),
        at(1, "d").alias("distance"), at(2, "d").alias("second")) \
        .withColumn("margin", F.col("second") - F.col("distance"))
