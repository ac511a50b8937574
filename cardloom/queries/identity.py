"""Identity ladder, page pass and answer reconciliation over card readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import numbers as N
from cardloom.operators import identity, resolve
from cardloom.plans.session import stage
from cardloom.queries.fuzzy import TEXT, fuzzy_catalog
from cardloom.queries.registry import query


def sets(t):
    """Set dimension whose catalog id space is the stand-in catalog's own."""
    return stage(t.sets.withColumn("catalog_id", F.col("set_id")), "sets")


def inputs(t):
    r = t.readings
    cell = F.col("pull_id") * 100 + F.col("row_index")
    bare = F.col("num") % 7 == 3
    cells = r.select(
        cell.alias("cell_id"), F.col("pull_id").alias("page_id"), "true_set", "num", "name",
        F.when(bare, F.col("num").cast("string")).otherwise(F.col("numerator")).alias("numerator"), "denominator", "prefix",
        bare.alias("bare"), (bare | F.col("pattern_ok")).alias("has_reading"),
        F.lit(None).cast("string").alias("prior_set"), F.lit(None).cast("string").alias("prior_catalog"),
        F.lit(None).cast("string").alias("prior_denominator"))
    cells = stage(cells, "cells")
    lines = cells.select("cell_id", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.expr(TEXT.replace("set_id", "true_set")).alias("text")),
        F.struct(F.lit(1).alias("rank"), F.col("name").alias("text")))).alias("l")).select("cell_id", "l.*")
    cat = stage(fuzzy_catalog(t), "catalog")
    nums = resolve.set_numerators(sets(t).select("set_id", "catalog_id"), cat.withColumnRenamed("set_id", "catalog_id"))
    cached = t.cards_unordered.groupBy("set_id", F.col("num").cast("string").alias("numerator")).agg(F.max("name").alias("name"))
    return cells, lines, cat, stage(nums, "numerators"), stage(cached, "cached")


@query("C27", "resolve_identity")
def _ladder(t):
    cells, lines, cat, nums, cached = inputs(t)
    return identity.resolve_identity(cells, lines, cat, sets(t), nums, cached)


@query("C28", "apply_page_prior")
def _page(t):
    cells, lines, cat, nums, cached = inputs(t)
    dim = sets(t)
    first = stage(identity.resolve_identity(cells, lines, cat, dim, nums, cached), "first")
    voted = first.join(cells.select("cell_id", "page_id"), "cell_id").withColumn("needs_review", ~F.col("confident"))
    prior = resolve.page_modal(voted, dim, "page_id")
    return identity.apply_page_prior(cells, first, lines, prior, cat, dim, nums, cached)


@query("C30", "fuse_art_and_text", """
SELECT pull_id * 100 + row_index AS card_id, CASE WHEN hit THEN art ELSE shown END AS number,
  CASE WHEN hit THEN CASE WHEN agree THEN CAST(0.97 AS DOUBLE) ELSE round(greatest(0.9 * sc, 0.75), 3) END ELSE confidence END AS confidence,
  CASE WHEN hit AND NOT agree AND shown IS NOT NULL THEN 'art_ocr_disagree' END AS reason, CASE WHEN hit THEN NOT agree AND shown IS NOT NULL ELSE num % 2 = 0 END AS needs_review,
  CASE WHEN hit THEN match_id END AS match_id FROM (
  SELECT c.*, num % 3 <> 0 AS hit, lpad(CAST(CASE WHEN num % 5 = 0 THEN num + 1 ELSE num END AS VARCHAR), 3, '0') || '/050' AS art, CASE WHEN num % 4 <> 0 THEN card_number END AS shown,
    num % 5 <> 0 AND num % 4 <> 0 AS agree, CAST(85 + num % 15 AS DOUBLE) / 100 AS sc FROM pull_card c) x""")
def _fuse(t):
    num = F.col("num")
    cid = (F.col("pull_id") * 100 + F.col("row_index")).alias("card_id")
    cards = t.cards.select(cid, F.when(num % 4 != 0, F.col("card_number")).alias("shown_number"), "confidence",
                           F.lit(None).cast("string").alias("reason"), (num % 2 == 0).alias("needs_review"))
    read = F.when(num % 5 == 0, num + 1).otherwise(num)
    art = t.cards.filter("num % 3 <> 0").select(
        cid, ((F.lit(85) + num % 15).cast("double") / 100).alias("score"),
        F.concat(F.lpad(read.cast("string"), 3, "0"), F.lit("/050")).alias("art_number"), "match_id")
    return identity.fuse_art_and_text(cards, art)


@query("C29", "reconcile_answer")
def _reconcile(t):
    num, none = F.col("num"), F.lit(None).cast("string")
    cid = (F.col("pull_id") * 100 + F.col("row_index")).alias("card_id")
    dim = sets(t)
    base = stage(t.cards.select("pull_id", "row_index", "set_id", "num", "name", "card_number", "confidence"), "cards")
    cards = base.select(
        cid, F.when(num % 2 == 0, F.col("set_id")).alias("set_id"), none.alias("set_code"), none.alias("set_name"),
        F.when(num % 5 == 0, F.col("name")).alias("name"), none.alias("card_number"), F.lit(0.3).alias("confidence"),
        F.lit(True).alias("needs_review"), F.when(num % 3 == 0, F.array("card_number", "name")).alias("texts"))
    answers = base.select(
        cid, F.when(num % 10 != 9, N.zero_fill((num % 10).cast("string"))).alias("number"),
        F.when(num % 4 != 0, F.concat(F.lit("0"), (F.lit(50) + F.substring("set_id", 2, 2).cast("int") % 9).cast("string"))).alias("denominator"),
        F.when(num % 6 == 0, F.concat(F.lit("realm & rift "), F.substring("set_id", 2, 2).cast("int").cast("string"))).alias("answer_set"),
        F.when(num % 3 != 0, F.expr(TEXT)).alias("answer_name"), F.col("confidence").alias("answer_conf"))
    cat = stage(fuzzy_catalog(t).join(dim.select("set_id", "set_name"), "set_id"), "catalog")
    cached = t.cards_unordered.groupBy("set_id", F.col("num").cast("string").alias("numerator")).agg(F.max("name").alias("name"))
    return identity.reconcile_answer(cards, answers, cat, dim, cached)
