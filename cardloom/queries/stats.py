"""Statistics, claims and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import claims, prices, stats
from cardloom.queries.registry import query

VERIFIED = """v AS (SELECT * FROM pull WHERE verified),
vc AS (SELECT c.*, v.trainer_id, v.created_at FROM pull_card c JOIN v ON c.pull_id = v.pull_id),
modal AS (SELECT pull_id, set_id FROM (SELECT pull_id, set_id, row_number() OVER (
    PARTITION BY pull_id ORDER BY count(*) DESC, min(row_index), set_id) AS r FROM vc GROUP BY pull_id, set_id) x WHERE r = 1),
packs AS (SELECT set_id, count(*) AS packs FROM modal GROUP BY set_id)"""
RATES = VERIFIED + """,
hits AS (SELECT m.set_id, c.match_id, count(DISTINCT c.pull_id) AS hits FROM vc c JOIN modal m ON c.pull_id = m.pull_id GROUP BY 1, 2),
rates AS (SELECT h.set_id, h.match_id, h.hits, p.packs, CAST(h.hits AS DOUBLE) / p.packs AS raw_rate,
    CAST(1.0 + h.hits AS DOUBLE) / (19.0 + p.packs) AS blended_rate FROM hits h JOIN packs p ON h.set_id = p.set_id),
zed AS (SELECT *, (raw_rate - 0.05) / sqrt(CAST(0.05 AS DOUBLE) * (1 - CAST(0.05 AS DOUBLE)) / packs) AS z FROM rates)"""

#: Two snapshots by order date stand in for the snapshot log.
LOG = """log AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS snapshot_id, max(o_orderdate) AS created_at,
    CASE WHEN year(o_orderdate) % 2 = 0 THEN 'done' ELSE 'running' END AS status FROM orders GROUP BY 1, 3)"""


def snapshot_log(t):
    year = F.year("o_orderdate")
    return t.table("orders").groupBy(year.cast("bigint").alias("snapshot_id")).agg(
        F.max("o_orderdate").alias("created_at")).withColumn(
        "status", F.when(F.col("snapshot_id") % 2 == 0, "done").otherwise("running"))


@query("A1", "table_scan", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' AND l_discount < 0.02""")
def _scan(t):
    from cardloom.sources.tables import scan
    where = (F.col("l_shipdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")) & (F.col("l_discount") < 0.02)
    return scan(t.spark, t.folder, "lineitem", where, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("B1", "verified_pulls", "SELECT pull_id, trainer_id, code_normalized FROM pull WHERE verified")
def _verified(t):
    return t.verified.select("pull_id", "trainer_id", "code_normalized")


@query("B2", "current_snapshot", f"""WITH {LOG}
SELECT snapshot_id, created_at FROM log WHERE status = 'done' ORDER BY created_at DESC, snapshot_id DESC LIMIT 1""")
def _current(t):
    log = snapshot_log(t)
    return log.where(F.col("snapshot_id") == prices.current_snapshot(log).scalar()).select("snapshot_id", "created_at")


@query("B3", "pending_derivations", """SELECT pull_id, created_at, capture_path FROM pull
WHERE verified AND derive_status = 'pending' AND capture_path <> 'live' ORDER BY created_at, pull_id LIMIT 200""")
def _pending(t):
    return stats.pending_derivations(t.verified).select("pull_id", "created_at", "capture_path")


@query("B4", "anomaly_review", f"""WITH {RATES}
SELECT set_id, match_id, round(abs(z), 6) AS severity,
   CASE WHEN hits % 3 = 0 THEN 'dismissed' WHEN hits % 3 = 1 THEN 'reviewed' ELSE 'open' END AS status
FROM zed WHERE packs >= 30 AND abs(z) > 3""")
def _review(t):
    found = stats.deviation_from_prior(stats.card_rates(t.verified_cards, t.modal, metadata=False)) \
        .withColumn("status", F.lit("open"))
    decided = found.select("set_id", "match_id", F.when(F.col("hits") % 3 == 0, "dismissed")
                           .when(F.col("hits") % 3 == 1, "reviewed").otherwise("bogus").alias("status"))
    return stats.with_status(found, decided, ["set_id", "match_id"]).select(
        "set_id", "match_id", F.round("severity", 6).alias("severity"), "status")


@query("B5", "search_users", """SELECT trainer_id, handle FROM trainer WHERE handle ILIKE '%12%' ORDER BY handle LIMIT 100""")
def _users(t):
    return t.trainers.filter(F.col("handle").ilike("%12%")).orderBy("handle").limit(100).select("trainer_id", "handle")


@query("C1", "pull_join_card", """SELECT p.pull_id, p.trainer_id, c.match_id, count(*) AS n
FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id WHERE p.verified GROUP BY 1, 2, 3""")
def _pull_card(t):
    return t.verified_cards.groupBy("pull_id", "trainer_id", "match_id").agg(F.count(F.lit(1)).alias("n"))


@query("D1", "modal_set", f"WITH {VERIFIED} SELECT pull_id, set_id FROM modal")
def _modal(t):
    return t.modal


@query("D2", "set_pack_counts", f"WITH {VERIFIED} SELECT set_id, packs FROM packs")
def _packs(t):
    return stats.set_pack_counts(t.modal)


@query("D3", "card_rates", f"""WITH {RATES},
meta AS (SELECT set_id, match_id, card_number, name FROM (SELECT m.set_id, c.match_id, c.card_number, c.name,
   row_number() OVER (PARTITION BY m.set_id, c.match_id ORDER BY c.pull_id DESC, c.row_index) AS r
   FROM vc c JOIN modal m ON c.pull_id = m.pull_id) x WHERE r = 1)
SELECT r.set_id, r.match_id, hits, packs, raw_rate, blended_rate, card_number, name
FROM rates r JOIN meta ON r.set_id = meta.set_id AND r.match_id = meta.match_id""")
def _card_rates(t):
    return stats.card_rates(t.verified_cards, t.modal).select(
        "set_id", "match_id", "hits", "packs", "raw_rate", "blended_rate", "card_number", "name")


_PRIOR_CASE = """CASE rarity WHEN 'Common' THEN 0.99 WHEN 'Uncommon' THEN 0.95 WHEN 'Rare' THEN 0.5
  WHEN 'Double Rare' THEN 0.33 ELSE 0.05 END"""


@query("D4", "rarity_rates", f"""WITH {VERIFIED},
h AS (SELECT m.set_id, c.rarity, count(DISTINCT c.pull_id) AS hits FROM vc c JOIN modal m ON c.pull_id = m.pull_id GROUP BY 1, 2)
SELECT h.set_id, rarity, hits, packs, CAST(hits AS DOUBLE) / packs AS raw_rate,
  round(CAST(20 * {_PRIOR_CASE} + hits AS DOUBLE) / (20 * (1 - {_PRIOR_CASE}) + packs), 6) AS blended_rate
FROM h JOIN packs p ON h.set_id = p.set_id""")
def _rarity_rates(t):
    return stats.rarity_rates(t.verified_cards, t.modal).select(
        "set_id", "rarity", "hits", "packs", "raw_rate", F.round("blended_rate", 6).alias("blended_rate"))


@query("D5", "rarity_prior", f"""SELECT rarity, round(20.0 * {_PRIOR_CASE}, 6)::DOUBLE AS alpha,
  round(20.0 * (1 - {_PRIOR_CASE}), 6)::DOUBLE AS beta, count(*) AS n FROM pull_card GROUP BY 1, 2, 3""")
def _prior(t):
    seen = t.cards_unordered.groupBy("rarity").agg(F.count(F.lit(1)).alias("n"))
    p = stats.seed_priors(t.spark).withColumnRenamed("key", "rarity")
    default = stats.DEFAULT_RATE * stats.PRIOR_STRENGTH
    return seen.join(p, "rarity", "left").select(
        "rarity", F.round(F.coalesce("alpha", F.lit(default)), 6).alias("alpha"),
        F.round(F.coalesce("beta", F.lit(stats.PRIOR_STRENGTH - default)), 6).alias("beta"), "n")


@query("D6", "blend_modes", f"""WITH {RATES}
SELECT set_id, match_id, blended_rate AS reference, CAST(1.0 + hits AS DOUBLE) / (20.0 + packs) AS beta_binomial FROM rates""")
def _blend(t):
    r = stats.card_rates(t.verified_cards, t.modal, metadata=False)
    a, b = F.lit(1.0), F.lit(19.0)
    return r.select("set_id", "match_id", stats.blend(F.col("hits"), F.col("packs"), a, b).alias("reference"),
                    stats.blend(F.col("hits"), F.col("packs"), a, b, "beta_binomial").alias("beta_binomial"))


@query("D7", "deviation_from_prior", f"""WITH {RATES}
SELECT set_id, match_id, packs, raw_rate, round(z, 6) AS z, round(abs(z), 6) AS severity
FROM zed WHERE packs >= 30 AND abs(z) > 3""")
def deviation(t):
    return stats.deviation_from_prior(stats.card_rates(t.verified_cards, t.modal, metadata=False)).select(
        "set_id", "match_id", "packs", "raw_rate", F.round("z", 6).alias("z"), F.round("severity", 6).alias("severity"))


@query("D8", "submitter_concentration", f"""WITH {VERIFIED},
t AS (SELECT m.set_id, v.trainer_id, count(*) AS n FROM modal m JOIN v ON m.pull_id = v.pull_id GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, trainer_id) AS r FROM t)
SELECT t.set_id, packs, trainer_id AS top_trainer, CAST(n AS DOUBLE) / packs AS share
FROM top t JOIN packs p ON t.set_id = p.set_id WHERE r = 1 AND packs >= 30 AND CAST(n AS DOUBLE) / packs > 0.5""")
def _concentration(t):
    return stats.submitter_concentration(t.modal, t.verified)


@query("E1", "first_valid_claim", "SELECT pull_id, code_normalized, created_at, verified FROM pull")
def _claims(t):
    return t.pulls.select("pull_id", "code_normalized", "created_at", "verified")


# Three re-reads per pull: its own code (taken by the first claimant), a code that two of its
# code's pulls share, and a third that mixes both; a third of the pulls re-reads all at one instant.
_REREADS = """t AS (SELECT pull_id * 10 + k AS reread_id, pull_id, code_normalized AS base,
   code_normalized || CASE k WHEN 0 THEN '' WHEN 1 THEN 'R' || CAST(pull_id % 2 AS VARCHAR) ELSE CASE WHEN pull_id % 4 = 0 THEN 'R0' ELSE 'S' END END AS code_normalized,
   (pull_id + k) % 7 <> 0 AS code_format_ok, created_at + to_days(CAST(3 + k * (pull_id % 3) AS INT)) AS moment
   FROM pull, (SELECT unnest([0, 1, 2]) AS k) ks WHERE NOT verified OR pull_id % 50 = 0)"""


@query("E2", "rescue_claim", f"""WITH RECURSIVE {_REREADS},
ev AS (SELECT base, 1 AS kind, reread_id AS id, pull_id, code_normalized, code_format_ok, moment FROM t
  UNION ALL SELECT code_normalized, 0, pull_id, pull_id, code_normalized, code_format_ok, created_at FROM pull WHERE code_normalized IN (SELECT base FROM t)),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY moment, kind, id) AS n FROM ev),
st AS (SELECT DISTINCT base, CAST(0 AS BIGINT) AS n, 0 AS kind, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS pull_id, CAST(NULL AS VARCHAR) AS code_normalized,
     CAST(NULL AS VARCHAR) AS outcome, CAST([] AS VARCHAR[]) AS codes, CAST([] AS BIGINT[]) AS pulls FROM t
 UNION ALL
 SELECT base, n, kind, id, pull_id, code_normalized, outcome, CASE outcome WHEN 'verified' THEN list_append(codes, code_normalized) ELSE codes END,
     CASE outcome WHEN 'verified' THEN list_append(pulls, pull_id) ELSE pulls END
   FROM (SELECT o.base, o.n, o.kind, o.id, o.pull_id, o.code_normalized, st.codes, st.pulls,
     CASE WHEN list_contains(st.pulls, o.pull_id) THEN 'already_verified' WHEN NOT o.code_format_ok THEN 'bad_format'
          WHEN list_contains(st.codes, o.code_normalized) THEN 'taken' ELSE 'verified' END AS outcome
     FROM st JOIN o ON o.base = st.base AND o.n = st.n + 1) x)
SELECT id AS reread_id, pull_id, code_normalized, outcome FROM st WHERE kind = 1""")
def _rescue(t):
    p, k = F.col("pull_id"), F.col("k")
    again = (t.pulls.filter(~F.col("verified") | (p % 50 == 0)).withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
             .select((p * 10 + k).alias("reread_id"), "pull_id",
                     F.concat("code_normalized", F.when(k == 0, "").when(k == 1, F.concat(F.lit("R"), (p % 2).cast("string")))
                              .otherwise(F.when(p % 4 == 0, "R0").otherwise("S"))).alias("code_normalized"),
                     ((p + k) % 7 != 0).alias("code_format_ok"),
                     (F.col("created_at") + F.make_dt_interval((3 + k * (p % 3)).cast("int"))).alias("at")))
    return claims.rescue_claims(t.submissions, again)


@query("E3", "latest_by_key", """SELECT set_id, num, pull_id, l_shipdate FROM (SELECT *, row_number() OVER (
  PARTITION BY set_id, num ORDER BY l_shipdate DESC, pull_id DESC) AS r FROM pull_card) x WHERE r = 1""")
def _latest(t):
    return stats.latest(t.cards_unordered, ["set_id", "num"], "l_shipdate", "pull_id").select(
        "set_id", "num", "pull_id", "l_shipdate")


@query("F1", "set_detail_order", f"""WITH {RATES}
SELECT set_id, match_id, raw_rate, row_number() OVER (PARTITION BY set_id ORDER BY raw_rate, match_id) AS position FROM rates""")
def _set_detail(t):
    from cardloom.plans.skew import ordinal
    r = stats.card_rates(t.verified_cards, t.modal, metadata=False)
    return ordinal(r, ["set_id"], ["raw_rate", "match_id"], [F.floor(F.col("raw_rate") * 100)], "position").select(
        "set_id", "match_id", "raw_rate", "position")


@query("F2", "anomalies_by_severity", f"""WITH {RATES}
SELECT 'deviation_from_prior' AS detector, set_id, match_id, round(abs(z), 6) AS severity FROM zed WHERE packs >= 30 AND abs(z) > 3
UNION ALL SELECT 'submitter_concentration', set_id, NULL, round(max(n) / sum(n), 6) FROM (
  SELECT m.set_id, v.trainer_id, CAST(count(*) AS DOUBLE) AS n FROM modal m JOIN v ON m.pull_id = v.pull_id GROUP BY 1, 2) t
  GROUP BY set_id HAVING sum(n) >= 30 AND max(n) / sum(n) > 0.5
ORDER BY severity DESC""")
def flagship(t):
    found = stats.anomalies(stats.card_rates(t.verified_cards, t.modal, metadata=False), t.modal, t.verified)
    return found.select("detector", "set_id", "match_id", F.round("severity", 6).alias("severity")) \
        .orderBy(F.desc("severity"), "set_id", "match_id")


@query("J1", "pluggable_prior", f"""WITH {RATES}
SELECT set_id, match_id, CASE WHEN length(match_id) % 2 = 0 THEN (3.0 + hits)::DOUBLE / (7.0 + packs) ELSE blended_rate END AS blended_rate FROM rates""")
def _custom_prior(t):
    rated = stats.card_rates(t.verified_cards, t.modal, metadata=False)
    prior = rated.filter(F.length("match_id") % 2 == 0)
    prior = prior.select("set_id", "match_id", F.lit(3.0).alias("alpha"), F.lit(7.0).alias("beta"))
    return stats.card_rates(t.verified_cards, t.modal, prior, metadata=False).select("set_id", "match_id", "blended_rate")


@query("A5", "published_snapshot", f"""WITH {VERIFIED} SELECT set_id, packs, CAST(2 AS BIGINT) AS snapshot_id, 'done failed' AS log FROM packs""")
def _snapshot(t):
    """Write two snapshots and one that fails on the way; read back the newest done one."""
    from pyspark.errors import PySparkException

    from cardloom.plans.session import fresh_folder
    from cardloom.sources.snapshots import read_snapshot, snapshot_status, write_snapshot
    root = fresh_folder(t.spark, "snapshots")
    packs = stats.set_pack_counts(t.modal)
    write_snapshot({"set_stat": packs.withColumn("packs", F.col("packs") + 1)}, root, 1, "2024-01-01 00:00:00")
    write_snapshot({"set_stat": packs}, root, 2, "2024-01-02 00:00:00")
    try:
        write_snapshot({"set_stat": packs.withColumn("packs", F.raise_error(F.lit("lost")).cast("bigint"))}, root, 3, "2024-01-03 00:00:00")
    except PySparkException:
        pass
    log = snapshot_status(t.spark, root).filter("snapshot_id > 1").agg(F.array_join(F.sort_array(F.collect_list("status")), " ").alias("l"))
    return read_snapshot(t.spark, root, "set_stat").select(
        "set_id", "packs", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), log.scalar().alias("log"))
