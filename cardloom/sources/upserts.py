"""Keyed writes expressed as full-outer rewrites of the affected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.plans.skew import top_k


def _pair(table: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(*rest).alias("__old"))
    fresh = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("__new"))
    return old.join(fresh, keys, "full"), rest


def upsert_update(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str],
                  now: Column, order: list) -> DataFrame:
    """Insert, or overwrite ``update`` columns and bump ``updated_at``; everything else
    (``first_seen`` too) keeps its first value. The last row of a key by ``order`` wins."""
    new = top_k(rows, keys, order, 1)
    both, rest = _pair(table, new, keys)
    have = set(rows.columns)

    def value(c):
        old, fresh = F.col(f"__old.{c}"), F.col(f"__new.{c}") if c in have else None
        hit = F.col("__new").isNotNull()
        if c == "updated_at":
            return F.when(hit, now).otherwise(old)
        if c == "first_seen":
            return F.when(F.col("__old").isNull(), now).otherwise(old)
        if c in update:
            return F.when(hit, fresh).otherwise(old)
        return F.when(F.col("__old").isNull(), fresh).otherwise(old) if fresh is not None else old

    return both.select(*keys, *[value(c).alias(c) for c in rest])


def upsert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert rows whose key is complete and not present yet; existing rows win."""
    complete = rows
    for k in keys:
        complete = complete.filter(F.nullif(F.col(k).cast("string"), F.lit("")).isNotNull())
    fresh = top_k(complete, keys, order, 1).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert_count(table: DataFrame, saves: DataFrame, keys: list[str], order: list[str],
                 refresh: str = "species") -> DataFrame:
    """Counted insert: qty adds up, ``refresh`` takes the newest save, ``updated_at``
    the newest time, all other columns keep the first-inserted values.

    Extra column ``outcome``: added / incremented / kept."""
    rest = [c for c in table.columns if c not in keys + ["qty", "updated_at"]]
    o = F.struct(*order)
    new = saves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max("updated_at").alias("__at"),
        F.min_by(F.struct(*rest), o).alias("__first"), F.max_by(refresh, o).alias("__fresh"))
    old = table.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias("__old"))
    both = old.join(new, keys, "full")
    is_new, hit = F.col("__old").isNull(), F.col("__n").isNotNull()

    def value(c):
        if c == refresh:
            return F.when(hit, F.col("__fresh")).otherwise(F.col(f"__old.{c}"))
        return F.when(is_new, F.col(f"__first.{c}")).otherwise(F.col(f"__old.{c}"))

    return both.select(
        *keys, *[value(c).alias(c) for c in rest],
        (F.coalesce("__old.qty", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("qty"),
        F.coalesce("__at", "__old.updated_at").alias("updated_at"),
        F.when(is_new, "added").when(hit, "incremented").otherwise("kept").alias("outcome"))


def rebuild_dimension(new: DataFrame, old: DataFrame, key: str, carried: str) -> DataFrame:
    """Merge that never clobbers: new rows win, old-only rows stay, and ``carried``
    moves onto a new row lacking it."""
    both, rest = _pair(old, new, [key])
    return both.select(key, *[
        (F.coalesce(f"__new.{c}", f"__old.{c}") if c == carried else
         F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))).alias(c)
        for c in rest])
