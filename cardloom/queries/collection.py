"""Collections, guards, species log and encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.operators import collection
from cardloom.plans.skew import ordinal
from cardloom.queries.registry import query

_SAVE = """s AS (SELECT pull_id, row_index, CASE num % 9 WHEN 0 THEN '?:' WHEN 1 THEN set_id || ':' WHEN 2 THEN '?:unknown'
    WHEN 3 THEN 'Sword & Shield: X:' || CAST(num AS VARCHAR) ELSE set_id || ':' || CAST(num AS VARCHAR) END AS identity_key,
  CASE WHEN num % 4 = 0 THEN TRUE WHEN num % 4 = 1 THEN FALSE END AS needs_review, CASE WHEN num % 11 = 0 THEN 'set_ambiguous' END AS reason,
  CASE num % 7 WHEN 0 THEN 'pending_vlm' WHEN 1 THEN 'vlm_failed' WHEN 2 THEN 'ok' END AS state, num % 3 = 0 AS confirmed FROM pull_card)"""
_FLAG = "(coalesce(needs_review, FALSE) OR reason IS NOT NULL OR coalesce(state IN ('pending_vlm', 'vlm_failed'), FALSE))"
_DEGEN = "(ends_with(identity_key, ':') OR identity_key = '?:unknown')"


def saves(t):
    num, n = F.col("num"), F.col("num").cast("string")
    key = (F.when(num % 9 == 0, "?:").when(num % 9 == 1, F.concat("set_id", F.lit(":"))).when(num % 9 == 2, "?:unknown")
           .when(num % 9 == 3, F.concat(F.lit("Sword & Shield: X:"), n)).otherwise(F.concat("set_id", F.lit(":"), n)))
    return t.cards.select(
        "pull_id", "row_index", key.alias("identity_key"),
        F.when(num % 4 == 0, True).when(num % 4 == 1, False).alias("needs_review"),
        F.when(num % 11 == 0, "set_ambiguous").alias("reason"),
        F.when(num % 7 == 0, "pending_vlm").when(num % 7 == 1, "vlm_failed").when(num % 7 == 2, "ok").alias("state"),
        (num % 3 == 0).alias("confirmed"))


@query("B7", "is_flagged", f"WITH {_SAVE} SELECT pull_id, row_index, {_FLAG} AS flagged FROM s")
def _flagged(t):
    return saves(t).select("pull_id", "row_index", collection.is_flagged(
        F.col("needs_review"), F.col("reason"), F.col("state")).alias("flagged"))


@query("B8", "save_guard", f"""WITH {_SAVE} SELECT pull_id, row_index, CASE WHEN {_DEGEN} THEN 'degenerate_key'
  WHEN {_FLAG} AND NOT confirmed THEN 'flagged_unconfirmed' END AS skip_reason FROM s""")
def _guard(t):
    return collection.save_guard(saves(t)).select("pull_id", "row_index", "skip_reason")


@query("B9", "is_degenerate_key", f"WITH {_SAVE} SELECT identity_key, {_DEGEN} AS degenerate, count(*) AS n FROM s GROUP BY 1, 2")
def _degenerate(t):
    return saves(t).groupBy("identity_key", S.is_degenerate_key(F.col("identity_key")).alias("degenerate")).agg(
        F.count(F.lit(1)).alias("n"))


@query("B16", "backfill_null", """
SELECT pull_id, row_index, CASE WHEN num % 3 <> 0 THEN species WHEN num % 10 = 0 THEN NULL ELSE species END AS species,
  num % 3 = 0 AND num % 2 = 1 OR num % 3 = 0 AND num % 10 <> 0 AS changed FROM pull_card""")
def _backfill(t):
    known = (t.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("display")).distinct()
             .withColumn("key", S.alnum_key(F.col("display"))))
    cards = t.cards.select("pull_id", "row_index", F.when(F.col("num") % 3 != 0, F.col("species")).alias("species"),
                           F.when(F.col("num") % 10 != 0, F.concat(F.initcap("species"), F.lit(" VMAX"))).alias("name"))
    return collection.backfill_species(cards, known).select("pull_id", "row_index", "species", "changed")


@query("D14", "dex", """
WITH ev AS (SELECT p.trainer_id, c.species, c.pull_id, c.row_index, p.created_at, c.num, c.match_id FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id),
a AS (SELECT trainer_id, species, count(*) AS n, min(created_at) AS first_at,
   arg_max(match_id, (created_at, pull_id * 100 + row_index)) FILTER (WHERE num % 4 = 0) AS url FROM ev WHERE pull_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT trainer_id, species, CAST(sum(num) AS BIGINT) AS n, min(created_at) AS first_at,
   arg_max(match_id, (created_at, pull_id * 100 + row_index)) FILTER (WHERE num % 5 <> 0) AS url FROM ev WHERE pull_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.trainer_id, b.trainer_id) AS trainer_id, coalesce(a.species, b.species) AS species, coalesce(a.n, 0) + coalesce(b.n, 0) AS count,
  least(a.first_at, b.first_at) AS first_seen, coalesce(a.url, b.url) AS image_url FROM a FULL JOIN b ON a.trainer_id = b.trainer_id AND a.species = b.species""")
def _dex(t):
    ev = t.cards.join(t.submissions.select("pull_id", "trainer_id", "created_at"), "pull_id").withColumn(
        "tie", F.col("pull_id") * 100 + F.col("row_index"))
    a = ev.filter("pull_id % 2 = 0").withColumn("image_url", F.when(F.col("num") % 4 == 0, F.col("match_id")))
    b = ev.filter("pull_id % 2 = 1").withColumn("image_url", F.when(F.col("num") % 5 != 0, F.col("match_id"))) \
        .withColumn("qty", F.col("num"))
    return collection.dex(a, b)


@query("D15", "encounters", """
WITH ev AS (SELECT p.trainer_id, c.species, p.created_at, c.pull_id, count(*) AS in_pull FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id GROUP BY 1, 2, 3, 4)
SELECT trainer_id, species, pull_id, in_pull, CAST(life AS BIGINT) AS lifetime, life = in_pull AS is_new FROM (
  SELECT *, sum(in_pull) OVER (PARTITION BY trainer_id, species ORDER BY created_at, pull_id) AS life FROM ev) x""")
def _encounters(t):
    ev = t.cards_unordered.select("pull_id", "species").join(
        t.submissions.select("pull_id", "trainer_id", "created_at"), "pull_id")
    out = collection.encounters(ev, F.date_trunc("month", F.col("created_at")))
    return out.select("trainer_id", "species", "pull_id", "in_pull", "lifetime", "is_new")


@query("F3", "collection_order", """
WITH c AS (SELECT DISTINCT set_id, CASE WHEN num % 6 = 0 THEN 'TG' || CAST(num AS VARCHAR) WHEN num % 7 = 0 THEN NULL ELSE CAST(num AS VARCHAR) END AS numerator FROM pull_card)
SELECT set_id, numerator, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN numerator IS NOT NULL AND numerator NOT LIKE 'TG%' THEN 0 ELSE 1 END,
  CASE WHEN numerator NOT LIKE 'TG%' THEN CAST(numerator AS INT) ELSE 0 END, coalesce(numerator, '')) AS position FROM c""")
def _order(t):
    num = F.col("num")
    c = t.cards_unordered.select("set_id", F.when(num % 6 == 0, F.concat(F.lit("TG"), num.cast("string")))
                                 .when(num % 7 == 0, None).otherwise(num.cast("string")).alias("numerator")).distinct()
    order = collection.natural_order(F.col("set_id"), F.col("numerator"))
    return ordinal(c, ["set_id"], order, [order[1], F.floor(order[2] / 100)], "position")


@query("F7", "pulls_newest_first", """
SELECT dense_rank() OVER (PARTITION BY trainer_id ORDER BY created_at DESC, p.pull_id DESC) AS pull_position, trainer_id, p.pull_id, row_index, match_id
FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id""")
def _newest(t):
    withc = t.submissions.join(t.cards_unordered.select("pull_id").distinct(), "pull_id", "left_semi")
    placed = ordinal(withc, ["trainer_id"], [F.desc("created_at"), F.desc("pull_id")],
                     [-F.year("created_at") * 12 - F.month("created_at")], "pull_position")
    return placed.join(t.cards.select("pull_id", "row_index", "match_id"), "pull_id").select(
        "pull_position", "trainer_id", "pull_id", "row_index", "match_id")
