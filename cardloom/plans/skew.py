"""Skew-safe building blocks.

Every ordered or per-group operator of the package is made from these, so that
no single group, however hot, has to be sorted or held by one task:

* ``top_k``      - rank limit that Spark pushes below the shuffle
                   (WindowGroupLimit): each map task sends at most k rows per key.
* ``mode_per``   - two partial aggregates, no window.
* ``ordinal``, ``previous_value``, ``running_sum``, ``islands``, ``nearest_anchors`` -
                   two-level scans: every group is cut into coarse, order-preserving
                   buckets, each bucket is scanned on its own, and only one summary
                   row per bucket is combined per group; the data is shuffled once.
* ``global_ordinal`` - positions over a whole frame from sampled quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cardloom.plans.session import stage

_BUCKET = "__b"


def _plain(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1,
          rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per key under ``order`` (add a unique tiebreak column)."""
    name = rank_col or "__rank"
    w = W.partitionBy(*keys).orderBy(*_plain(order))
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def mode_per(df: DataFrame, group: Sequence[str], value: str, position: str | None = None,
             count_col: str = "votes") -> DataFrame:
    """Most frequent non-null ``value`` per group.

    Ties: smallest ``position`` at which the value occurs, then value ascending.
    """
    pos = F.min(position) if position else F.lit(0)
    counted = (df.filter(F.col(value).isNotNull())
                 .groupBy(*group, value)
                 .agg(F.count(F.lit(1)).alias("__n"), pos.alias("__p")))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__p").alias("p"),
                          F.col(value).alias("v")))
    return (counted.groupBy(*group).agg(best.alias("__best"))
                   .select(*group, F.col("__best.v").alias(value),
                           (-F.col("__best.n")).alias(count_col)))


def _bucketed(df: DataFrame, bucket: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Add bucket columns: every key is cut, whatever its size, so results and plans are alike
    at every size."""
    names = [f"{_BUCKET}{i}" for i in range(len(bucket))]
    return df.withColumns(dict(zip(names, bucket))), names


def _attach(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Left join on ``on`` in which NULL equals NULL."""
    side = side.select(*[F.col(c).alias(f"__on{i}") for i, c in enumerate(on)],
                       *[c for c in side.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__on{i}"))
    return df.join(side, same, "left").drop(*[f"__on{i}" for i in range(len(on))])


def _without_nulls(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add a value and a flag (known or not) per column, both never NULL, equal where the columns are equal or both NULL.

    Joins and windows by these names share one shuffle; a null-safe join hashes expressions of its own."""
    made = {}
    for c in columns:
        kind = df.schema[c].dataType
        blank = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None
        made[f"{c}__v"] = F.struct(c) if blank is None else F.coalesce(F.col(c), blank)
        made[f"{c}__known"] = F.col(c).isNotNull()
    return df.withColumns(made), list(made)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            bucket: Sequence[Column], name: str = "ordinal", start: int = 1) -> DataFrame:
    """row_number per key, exact, without gathering a hot key in one task.

    ``bucket`` holds coarse non-null columns that never decrease along ``order``."""
    b, bn = _bucketed(df, bucket)
    b, ks = _without_nulls(b, keys)
    b, bs = _without_nulls(b, bn)
    b = b.drop(*bn)
    sizes = b.groupBy(*ks, *bs).agg(F.count(F.lit(1)).alias("__size"))
    # Flags before values: NULL comes first among buckets, as in any ascending order.
    along = [c for v, known in zip(bs[::2], bs[1::2]) for c in (known, v)]
    before = W.partitionBy(*ks).orderBy(*along).rowsBetween(W.unboundedPreceding, -1)
    # Written first: what it shuffles is gone before the rows themselves are dealt.
    offsets = stage(sizes.select(*ks, *bs, F.sum("__size").over(before).alias("__off")), "offsets")
    local = W.partitionBy(*ks, *bs).orderBy(*_plain(order))
    return (b.join(offsets, [*ks, *bs], "left").select(*b.columns, "__off")
             .withColumn(name, (F.row_number().over(local) + F.coalesce("__off", F.lit(0))
                                + F.lit(start - 1)).cast("bigint"))
             .drop("__off", *ks, *bs))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   bucket: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``lag(value)`` per key as a two-level scan."""
    b, bn = _bucketed(df.withColumn("__val", value), bucket)
    tail = b.groupBy(*keys, *bn).agg(
        F.max_by("__val", F.struct(*_plain(order))).alias("__last"))
    carried = tail.select(
        *keys, *bn, F.lag("__last").over(W.partitionBy(*keys).orderBy(*bn)).alias("__carry"))
    local = W.partitionBy(*keys, *bn).orderBy(*_plain(order))
    return (_attach(b, carried, [*keys, *bn])
             .withColumn(name, F.when(F.row_number().over(local) == 1, F.col("__carry"))
                                .otherwise(F.lag("__val").over(local)))
             .drop("__val", "__carry", *bn))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                bucket: Sequence[Column], value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running total per key as a two-level scan (``order`` must be unique per key)."""
    b, bn = _bucketed(df.withColumn("__val", value), bucket)
    totals = b.groupBy(*keys, *bn).agg(F.sum("__val").alias("__total"))
    before = W.partitionBy(*keys).orderBy(*bn).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, *bn, F.sum("__total").over(before).alias("__base"))
    local = (W.partitionBy(*keys, *bn).orderBy(*_plain(order))
              .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    return (_attach(b, base, [*keys, *bn])
             .withColumn(name, F.coalesce(F.sum("__val").over(local), F.lit(0))
                         + F.coalesce("__base", F.lit(0)))
             .drop("__val", "__base", *bn))


def islands(df: DataFrame, keys: Sequence[str], coord: str, gap: Column | float,
            width: float, name: str = "island", inclusive: bool = False) -> DataFrame:
    """Gap clustering: a new island starts where the sorted coordinate jumps by more
    than ``gap`` (by at least ``gap`` when ``inclusive``).

    Islands depend on distinct coordinates only, so copies are folded first; the
    distinct coordinates of a hot key are scanned in tiles of ``width``. ``gap`` may be
    a column that is constant per key. Ids count from 0 per key."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    points, (b,) = _bucketed(df.groupBy(*keys, coord).agg(F.first(gap).alias("__gap")),
                             [F.floor(F.col(coord) / F.lit(width))])
    local = W.partitionBy(*keys, b).orderBy(coord)
    step = F.col(coord) - F.lag(coord).over(local)
    jump = (step >= F.col("__gap")) if inclusive else (step > F.col("__gap"))
    scanned = (points
               .withColumn("__jump", F.coalesce(jump.cast("bigint"), F.lit(0)))
               .withColumn("__in", F.sum("__jump").over(
                   local.rowsBetween(W.unboundedPreceding, 0))))
    tiles = scanned.groupBy(*keys, b).agg(
        F.min(coord).alias("__lo"), F.max(coord).alias("__hi"),
        F.sum("__jump").alias("__jumps"), F.first("__gap").alias("__gap"))
    over = W.partitionBy(*keys).orderBy(b)
    between = F.col("__lo") - F.lag("__hi").over(over)
    seam = (between >= F.col("__gap")) if inclusive else (between > F.col("__gap"))
    tiles = (tiles.withColumn("__seam", F.coalesce(seam.cast("bigint"), F.lit(0)))
                  .withColumn("__base", F.sum("__seam").over(
                      over.rowsBetween(W.unboundedPreceding, 0))
                      + F.coalesce(F.sum("__jumps").over(
                          over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                  .select(*keys, b, "__base"))
    labels = (_attach(scanned, tiles, [*keys, b])
                     .select(*keys, coord, (F.col("__in") + F.coalesce("__base", F.lit(0))).alias(name)))
    return _attach(df, labels, [*keys, coord])


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float], width: float,
                more: Sequence[Column] = ()) -> DataFrame:
    """Exact interpolated percentiles per key: ``wanted`` maps a column name to a fraction.

    Values are counted first, the counts are summed along the values in tiles of ``width``, and each
    percentile is read off by rank; so no task holds the distinct values of a key. ``more``:
    further aggregates over columns ``value`` and ``n`` (its count)."""
    counts = (df.select(*keys, value.alias("value")).filter(F.col("value").isNotNull())
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    upto = running_sum(counts, keys, ["value"], [F.floor(F.col("value") / F.lit(width))], F.col("n"), "__upto")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    placed = _attach(upto, total, list(keys))

    def at(rank):
        return F.max(F.when((F.col("__upto") - F.col("n") <= rank) & (rank < F.col("__upto")), F.col("value")))
    ranks = {name: F.lit(p) * (F.col("__total") - 1) for name, p in wanted.items()}
    found = placed.groupBy(*keys).agg(
        *[at(F.floor(r)).alias(f"__lo_{n}") for n, r in ranks.items()], *[at(F.ceil(r)).alias(f"__hi_{n}") for n, r in ranks.items()],
        *[F.max(r - F.floor(r)).alias(f"__f_{n}") for n, r in ranks.items()], *more)
    return found.withColumns({n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}") for n in wanted}) \
        .drop(*[f"__{s}_{n}" for s in ("lo", "hi", "f") for n in wanted])


def nearest_anchors(points: DataFrame, anchors: DataFrame, keys: Sequence[str], coord: str,
                    anchor: str, label: str | None = None, shift: Column | None = None,
                    width: float = 64.0) -> DataFrame:
    """As-of join both ways: each point gets ``before`` / ``after``, the closest anchor
    at or below / at or above its coordinate (STRUCT(at, label), NULL when none).

    Anchors and points are merged into one sequence and scanned in buckets of
    ``width``; no point-anchor pair is ever built. Anchors sharing a coordinate are
    folded to the smallest label.
    """
    tag = F.min(label) if label else F.lit(None).cast("string")
    anc = (anchors.groupBy(*keys, F.col(anchor).alias("__pos")).agg(tag.alias("__tag"))
           .select(*keys, "__pos", F.struct(F.col("__pos").alias("at"), F.col("__tag").alias("label"))
                   .alias("__anchor"), F.lit(None).alias("__row")))
    rest = [c for c in points.columns if c not in keys]
    pts = points.select(*keys, (F.col(coord) if shift is None else F.col(coord) + shift).alias("__pos"),
                        F.lit(None).cast(anc.schema["__anchor"].dataType).alias("__anchor"),
                        F.struct(*rest).alias("__row"))
    merged = anc.withColumn("__row", F.col("__row").cast(pts.schema["__row"].dataType)).unionByName(pts)
    merged, (b,) = _bucketed(merged, [F.floor(F.col("__pos") / F.lit(width))])
    tiles = merged.groupBy(*keys, b).agg(
        F.max("__anchor").alias("__hi"), F.min("__anchor").alias("__lo"))
    over = W.partitionBy(*keys)
    tiles = tiles.select(
        *keys, b,
        F.last("__hi", ignorenulls=True).over(
            over.orderBy(b).rowsBetween(W.unboundedPreceding, -1)).alias("__below"),
        F.last("__lo", ignorenulls=True).over(
            over.orderBy(F.desc(b)).rowsBetween(W.unboundedPreceding, -1)).alias("__above"))
    local = W.partitionBy(*keys, b)
    point_last = F.col("__row").isNotNull()          # anchors first at equal positions
    up = local.orderBy("__pos", point_last).rowsBetween(W.unboundedPreceding, 0)
    down = local.orderBy(F.desc("__pos"), point_last).rowsBetween(W.unboundedPreceding, 0)
    return (_attach(merged, tiles, [*keys, b])
            .withColumns({
                "before": F.coalesce(F.last("__anchor", ignorenulls=True).over(up), F.col("__below")),
                "after": F.coalesce(F.last("__anchor", ignorenulls=True).over(down), F.col("__above"))})
            .filter(point_last).select(*keys, "__row.*", "before", "after"))


def global_ordinal(df: DataFrame, by: str | Sequence[str], tie: Sequence[str] = (), name: str = "ordinal",
                   start: int = 0) -> DataFrame:
    """row_number over the whole frame ordered by ``by`` and ``tie`` (together unique).

    Rows are dealt by sampled quantiles of the order, so equal or skewed values spread like
    any; each part is sorted apart and only the parts' row counts meet."""
    order = [F.col(c).asc_nulls_first() for c in ([by] if isinstance(by, str) else list(by)) + list(tie)]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))    # a row per part
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (placed.join(offsets, "__part")
            .withColumn(name, F.col("__off") + F.col("__at") - F.shiftleft("__part", 33) + F.lit(start))
            .drop("__part", "__off", "__at"))
