"""Duels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import duels, prices, stats
from cardloom.queries.prices import LATEST, latest_prices
from cardloom.queries.registry import query
from cardloom.queries.stats import RATES

_H = "((({0} % 2147483648) * 2654435761 + {1} * 40503) % 2147483648)"


@query("C21", "random_opponent", f"""WITH v AS (SELECT pull_id, trainer_id FROM pull WHERE verified),
o AS (SELECT *, row_number() OVER (ORDER BY trainer_id, pull_id) - 1 AS pos FROM v),
mine AS (SELECT v.*, (SELECT count(*) FROM v w WHERE w.trainer_id <> v.trainer_id) AS others FROM v),
drawn AS (SELECT pull_id, trainer_id, ({_H.format('pull_id', 7)} * 2147483648 + {_H.format('pull_id', 8)}) % others AS x FROM mine),
rest AS (SELECT d.pull_id, d.trainer_id, d.x, min(o.pos) AS f, count(*) AS n FROM drawn d JOIN o ON d.trainer_id = o.trainer_id GROUP BY 1, 2, 3)
SELECT r.pull_id, r.trainer_id, o.pull_id AS opponent_pull, o.trainer_id AS opponent_id
FROM rest r LEFT JOIN o ON o.pos = CASE WHEN x < f THEN x ELSE x + n END""")
def _opponent(t):
    v = t.verified.select("pull_id", "trainer_id")
    return duels.random_opponents(v, v)


_DUELS = f"""duel AS (SELECT pull_id AS duel_id, pull_id AS challenger_pull, trainer_id AS challenger_id, nxt AS opponent_pull, who AS opponent_id,
  CASE pull_id % 3 WHEN 0 THEN 'friend' WHEN 1 THEN 'random' ELSE 'friend' END AS mode,
  CASE WHEN pull_id % 3 = 0 AND pull_id % 2 = 0 THEN 'pending' ELSE 'resolved' END AS status
  FROM (SELECT pull_id, trainer_id, lead(pull_id) OVER (ORDER BY pull_id % 97, pull_id) AS nxt, lead(trainer_id) OVER (ORDER BY pull_id % 97, pull_id) AS who
        FROM pull WHERE verified) x WHERE nxt IS NOT NULL AND who <> trainer_id)"""
_SCORES = f"""{LATEST}, score AS (SELECT c.pull_id, round(coalesce(sum((usd_low + usd_high) / 2), 0), 8) AS score, count(*) AS n_cards
  FROM pull_card c LEFT JOIN latest l ON c.match_id = l.match_id GROUP BY 1)"""


def duel_table(t):
    """Verified pulls paired with their successor in a fixed order."""
    from cardloom.plans.skew import ordinal
    v = t.verified.select("pull_id", "trainer_id").withColumn("k", F.col("pull_id") % 97)
    pos = ordinal(v, [], ["k", "pull_id"], [F.col("k"), F.floor(F.col("pull_id") / 10000000)], "pos")
    nxt = pos.select((F.col("pos") - 1).alias("pos"), F.col("pull_id").alias("opponent_pull"),
                     F.col("trainer_id").alias("opponent_id"))
    p = F.col("pull_id")
    return (pos.join(nxt, "pos").filter(F.col("opponent_id") != F.col("trainer_id"))
            .select(p.alias("duel_id"), p.alias("challenger_pull"), F.col("trainer_id").alias("challenger_id"),
                    "opponent_pull", "opponent_id", F.when(p % 3 == 1, "random").otherwise("friend").alias("mode"),
                    F.when((p % 3 == 0) & (p % 2 == 0), "pending").otherwise("resolved").alias("status")))


def scores(t):
    return duels.side_score(t.cards_unordered, latest_prices(t), digits=8)


@query("D32", "score_duel", f"""WITH {_DUELS}, {_SCORES}
SELECT duel_id, coalesce(a.score, 0) AS challenger_score, coalesce(b.score, 0) AS opponent_score,
  CASE WHEN coalesce(a.score, 0) > coalesce(b.score, 0) THEN 'challenger' WHEN coalesce(b.score, 0) > coalesce(a.score, 0) THEN 'opponent' ELSE 'tie' END AS winner
FROM duel d LEFT JOIN score a ON a.pull_id = d.challenger_pull LEFT JOIN score b ON b.pull_id = d.opponent_pull""")
def _score(t):
    return duels.score_duels(duel_table(t), scores(t)).select("duel_id", "challenger_score", "opponent_score", "winner")


def view(t):
    s = scores(t)
    fights = duels.score_duels(duel_table(t), s).withColumnRenamed("duel_id", "battle_id")
    per = t.cards_unordered.groupBy("pull_id").agg(F.count(F.lit(1)).alias("n_cards")).join(
        s.withColumnRenamed("score", "value"), "pull_id")
    return duels.masked_view(fights, per, t.trainers)


_VIEW = f"""{_DUELS}, {_SCORES},
w AS (SELECT d.*, a.score AS s1, b.score AS s2, a.n_cards AS n1, b.n_cards AS n2, t.handle, CASE WHEN coalesce(a.score, 0) > coalesce(b.score, 0) THEN 'challenger'
   WHEN coalesce(b.score, 0) > coalesce(a.score, 0) THEN 'opponent' ELSE 'tie' END AS winner
  FROM duel d LEFT JOIN score a ON a.pull_id = d.challenger_pull LEFT JOIN score b ON b.pull_id = d.opponent_pull LEFT JOIN trainer t ON t.trainer_id = d.opponent_id),
s AS (SELECT duel_id, mode, status, winner, challenger_id AS viewer, 'challenger' AS role, n1, s1, n2, s2, handle FROM w
      UNION ALL SELECT duel_id, mode, status, winner, opponent_id, 'opponent', n1, s1, n2, s2, handle FROM w),
seen AS (SELECT duel_id AS battle_id, mode, status, viewer, role, n1 AS challenger_cards, s1 AS challenger_value,
  CASE WHEN NOT (mode = 'friend' AND status = 'pending') THEN n2 END AS opponent_cards, CASE WHEN NOT (mode = 'friend' AND status = 'pending') THEN s2 END AS opponent_value,
  CASE WHEN mode <> 'random' THEN handle END AS opponent_handle,
  CASE WHEN status <> 'resolved' THEN NULL WHEN winner = 'tie' THEN 'tie' WHEN winner = role THEN 'win' ELSE 'loss' END AS outcome FROM s)"""


@query("C31", "mask_pending", f"WITH {_VIEW} SELECT * FROM seen")
def _masked(t):
    return view(t)


@query("D31", "win_loss_summary", f"""WITH {_VIEW} SELECT viewer, count(*) FILTER (WHERE outcome = 'win') AS wins,
  count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'tie') AS ties
FROM seen WHERE role = 'challenger' OR (mode = 'friend' AND status <> 'pending') GROUP BY 1""")
def _win_loss(t):
    return duels.win_loss(view(t))


@query("D33", "weighted_draws", f"""WITH {RATES}, {LATEST},
cand AS (SELECT CASE WHEN split_part(match_id, '-', 1) = 'S05' THEN 'S95' ELSE split_part(match_id, '-', 1) END AS set_id, match_id, (usd_low + usd_high) / 2 AS value FROM latest),
rt AS (SELECT match_id, arg_max(blended_rate, (packs, blended_rate)) AS rate FROM rates GROUP BY 1),
pools AS (SELECT set_id AS pool, match_id, value FROM cand UNION ALL SELECT '*', match_id, value FROM cand),
w AS (SELECT p.*, CASE WHEN bool_or(r.rate IS NOT NULL) OVER (PARTITION BY pool) THEN greatest(coalesce(r.rate, 0.01), 0.001) ELSE 1.0 END AS w
      FROM pools p LEFT JOIN rt r ON p.match_id = r.match_id),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY pool ORDER BY num, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(w) OVER (PARTITION BY pool) AS total FROM (SELECT *, CAST(split_part(match_id, '-', 2) AS INT) AS num FROM w) x),
b AS (SELECT m.pull_id AS battle_id, CASE WHEN m.set_id = 'S05' THEN '*' ELSE m.set_id END AS pool, n.n FROM modal m JOIN (SELECT pull_id, count(*) AS n FROM pull_card GROUP BY 1) n ON m.pull_id = n.pull_id),
d AS (SELECT battle_id, pool, unnest(range(CAST(n AS BIGINT))) AS draw FROM b),
u AS (SELECT d.*, CAST(((battle_id % 2147483648) * 2654435761 + draw * 40503) % 2147483648 AS DOUBLE) / 2147483648.0 * t.total AS u FROM d JOIN (SELECT DISTINCT pool, total FROM c) t ON d.pool = t.pool)
SELECT u.battle_id, CAST(u.draw AS INT) AS draw, c.match_id, round(c.value, 6) AS value FROM u ASOF JOIN c ON u.pool = c.pool AND u.u >= c.below""")
def _draws(t):
    latest = latest_prices(t)
    cands = latest.select(
        F.when(F.col("set_id") == "S05", "S95").otherwise(F.col("set_id")).alias("set_id"), "match_id", ((F.col("usd_low") + F.col("usd_high")) / 2).alias("value"))
    n = t.cards_unordered.groupBy("pull_id").agg(F.count(F.lit(1)).alias("n"))
    fights = t.modal.join(n, "pull_id").select(F.col("pull_id").alias("battle_id"), "set_id", F.col("n").cast("int"))
    rates = stats.card_rates(t.verified_cards, t.modal, metadata=False)
    num = F.split_part("match_id", F.lit("-"), F.lit(2)).cast("int")
    return duels.weighted_draws(fights, cands, rates, order=num).withColumn("value", F.round("value", 6))


_EVENTS = """ev AS (
  SELECT pull_id * 4 AS event_id, pull_id AS battle_id, 'challenge' AS kind, CASE WHEN pull_id % 11 = 0 THEN trainer_id + 1 ELSE trainer_id END AS actor, pull_id,
     CASE WHEN pull_id % 13 = 0 THEN 'nobody' WHEN pull_id % 17 = 0 THEN (SELECT min(handle) FROM trainer t WHERE t.trainer_id = p.trainer_id)
          ELSE ' CUSTOMER_' || lpad(CAST(pull_id % 100 AS VARCHAR), 9, '0') END AS handle, created_at AS moment FROM pull p
  UNION ALL SELECT pull_id * 4 + 1, pull_id - pull_id % 7, CASE WHEN pull_id % 3 = 0 THEN 'decline' ELSE 'accept' END, trainer_id, pull_id, NULL, created_at + INTERVAL 4000 DAY FROM pull
  UNION ALL SELECT pull_id * 4 + 2, pull_id, CASE WHEN pull_id % 4 = 0 THEN 'decline' ELSE 'accept' END, pull_id % 100, pull_id, NULL, created_at + INTERVAL 5000 DAY FROM pull)"""


def challenge_events(t):
    p = t.submissions.join(t.trainers.select("trainer_id", "handle"), "trainer_id", "left")
    pid = F.col("pull_id")
    first = p.select((pid * 4).alias("event_id"), pid.alias("battle_id"), F.lit("challenge").alias("kind"),
                     F.when(pid % 11 == 0, F.col("trainer_id") + 1).otherwise(F.col("trainer_id")).alias("actor"), "pull_id",
                     F.when(pid % 13 == 0, "nobody").when(pid % 17 == 0, F.col("handle")).otherwise(
                         F.concat(F.lit(" CUSTOMER_"), F.lpad((pid % 100).cast("string"), 9, "0"))).alias("handle"),
                     F.col("created_at").alias("at"))
    none = F.lit(None).cast("string").alias("handle")
    second = p.select((pid * 4 + 1).alias("event_id"), (pid - pid % 7).alias("battle_id"),
                      F.when(pid % 3 == 0, "decline").otherwise("accept").alias("kind"), F.col("trainer_id").alias("actor"),
                      "pull_id", none, (F.col("created_at") + F.expr("INTERVAL 4000 DAYS")).alias("at"))
    third = p.select((pid * 4 + 2).alias("event_id"), pid.alias("battle_id"),
                     F.when(pid % 4 == 0, "decline").otherwise("accept").alias("kind"), (pid % 100).alias("actor"),
                     "pull_id", none, (F.col("created_at") + F.expr("INTERVAL 5000 DAYS")).alias("at"))
    return first.unionByName(second).unionByName(third)


@query("E18", "fold_battle_events", f"""WITH {_EVENTS},
e AS (SELECT ev.*, p.trainer_id AS owner, p.verified, t.trainer_id AS named FROM ev LEFT JOIN pull p ON ev.pull_id = p.pull_id LEFT JOIN trainer t ON t.handle = lower(trim(ev.handle))),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY battle_id ORDER BY moment, event_id) AS r FROM e
   WHERE kind = 'challenge' AND owner = actor AND verified AND named IS NOT NULL AND named <> actor) x WHERE r = 1),
fin AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.battle_id ORDER BY e.moment, e.event_id) AS r FROM e JOIN st s ON e.battle_id = s.battle_id
   WHERE e.kind <> 'challenge' AND e.actor = s.named AND e.moment >= s.moment AND (e.kind = 'decline' OR (e.owner = e.actor AND e.verified))) x WHERE r = 1)
SELECT s.battle_id, s.actor AS challenger_id, s.pull_id AS challenger_pull, s.named AS opponent_id, CASE WHEN f.kind = 'accept' THEN f.pull_id END AS opponent_pull,
  CASE f.kind WHEN 'accept' THEN 'resolved' WHEN 'decline' THEN 'declined' ELSE 'pending' END AS status FROM st s LEFT JOIN fin f ON s.battle_id = f.battle_id""")
def _fold(t):
    return duels.fold_events(challenge_events(t), t.pulls, t.trainers)[0]
