"""Evaluation and ratchets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import names as S
from cardloom.operators import evaluate
from cardloom.queries.registry import query
from cardloom.queries.vectors import _SIM, ranked


@query("D28", "calibration_report", """SELECT count(*) AS records, count(*) FILTER (WHERE NOT flagged) AS unflagged, count(*) FILTER (WHERE NOT correct) AS mistakes,
  CAST(count(*) FILTER (WHERE NOT flagged AND correct) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE NOT flagged)) AS precision,
  CAST(count(*) FILTER (WHERE flagged AND NOT correct) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE NOT correct)) AS flag_recall,
  (SELECT CAST(count(*) FILTER (WHERE code_format_ok) AS DOUBLE) / greatest(1, count(*)) FROM pull) AS code_rate FROM calibration""")
def _calibration(t):
    return evaluate.calibration_report(t.calibration, t.submissions.select(F.col("code_format_ok").alias("read_ok")))


@query("D29", "threshold_sweep", """WITH th AS (SELECT round(50 + k, 0) / 100.0 AS threshold, k FROM (SELECT unnest(range(0, 46)) AS k) x),
s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(count(*) FILTER (WHERE confidence >= threshold - 1e-9 AND correct) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE confidence >= threshold - 1e-9)) AS precision,
  CAST(count(*) FILTER (WHERE confidence < threshold - 1e-9 AND NOT correct) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE NOT correct)) AS flag_recall FROM th, calibration GROUP BY 1)
SELECT *, coalesce(threshold = (SELECT min(threshold) FROM s WHERE precision >= 0.6 AND flag_recall >= 0.5), FALSE) AS first_ok FROM s""")
def _sweep(t):
    return evaluate.threshold_sweep(t.calibration, precision=0.6, recall=0.5)


_STRIPS = """st AS (SELECT vec_id AS strip_id, vec_id // 15 AS photo_id, CASE WHEN (vec_id // 15) % 4 = 0 THEN label ELSE 0 END AS set_id, CASE WHEN vec_id % 10 <> 0 THEN vec_id - vec_id % 3 + 1 END AS card_key FROM embeddings WHERE vec_id % 5 = 0),
ph AS (SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'stress' ELSE 'standard' END AS tier, CASE WHEN photo_id % 5 = 0 THEN 'train' ELSE 'test' END AS split, photo_id % 7 <> 0 AS labeled FROM (SELECT DISTINCT photo_id FROM st) x)"""


@query("D25", "topk_accuracy", f"""WITH {_SIM}, {_STRIPS},
one AS (SELECT photo_id FROM st GROUP BY 1 HAVING count(DISTINCT set_id) = 1), rw AS (SELECT st.*, tier FROM st JOIN ph ON st.photo_id = ph.photo_id WHERE split = 'test' AND labeled AND st.photo_id IN (SELECT photo_id FROM one) AND card_key IS NOT NULL),
h AS (SELECT query_id, ref_id, rank FROM rk WHERE rank <= 3)
SELECT tier, count(*) FILTER (WHERE hit = 1) AS top1, count(*) FILTER (WHERE hit <= 3) AS top3, count(*) AS total FROM (SELECT rw.*, (SELECT min(rank) FROM h WHERE h.query_id = rw.strip_id AND h.ref_id = rw.card_key) AS hit FROM rw) x GROUP BY 1""")
def _accuracy(t):
    e, v = t.table("embeddings").filter("vec_id % 5 = 0"), F.col("vec_id")
    photo = F.floor(v / 15)
    strips = e.select(v.alias("strip_id"), photo.alias("photo_id"), F.when(photo % 4 == 0, F.col("label")).otherwise(0).alias("set_id"),
                      F.when(v % 10 != 0, v - v % 3 + 1).alias("card_key"))
    p = F.col("photo_id")
    photos = strips.select("photo_id").distinct().select(
        p, F.when(p % 2 == 0, "stress").otherwise("standard").alias("tier"),
        F.when(p % 5 == 0, "train").otherwise("test").alias("split"), (p % 7 != 0).alias("labeled"))
    return evaluate.topk_accuracy(strips, photos, ranked(t, 3).withColumnRenamed("query_id", "strip_id"))[0]


_CELLS = """c AS (SELECT pull_id, name, CAST(CASE WHEN confidence < 0.6 THEN num + 1 ELSE num END AS VARCHAR) AS number, confidence < 0.75 AND confidence >= 0.6 AS needs_review FROM pull_card),
t AS (SELECT pull_id, name, CASE WHEN num % 9 <> 0 THEN CAST(num AS VARCHAR) END AS number FROM pull_card)"""


def predictions(t):
    num, conf = F.col("num"), F.col("confidence")
    cells = t.cards_unordered.select("pull_id", "name", F.when(conf < 0.6, num + 1).otherwise(num).cast("string").alias("number"),
                                     ((conf < 0.75) & (conf >= 0.6)).alias("needs_review"))
    truth = t.cards_unordered.select("pull_id", "name", F.when(num % 9 != 0, num.cast("string")).alias("number"))
    return cells, truth


def _multiset_sql(key):
    return f"""WITH {_CELLS}, p AS (SELECT pull_id, coalesce({key}, '') AS k, count(*) FILTER (WHERE NOT needs_review) AS p, count(*) FILTER (WHERE needs_review) AS f FROM c GROUP BY 1, 2),
w AS (SELECT pull_id, coalesce({key}, '') AS k, count(*) AS t FROM t GROUP BY 1, 2)
SELECT coalesce(p.pull_id, w.pull_id) AS pull_id, CAST(sum(least(coalesce(p, 0), coalesce(t, 0))) AS BIGINT) AS correct, CAST(sum(coalesce(p, 0) - least(coalesce(p, 0), coalesce(t, 0))) AS BIGINT) AS wrong,
  CAST(sum(coalesce(f, 0)) AS BIGINT) AS flagged, CAST(sum(coalesce(t, 0) - least(coalesce(p, 0), coalesce(t, 0))) AS BIGINT) AS unmatched FROM p FULL JOIN w ON p.pull_id = w.pull_id AND p.k = w.k GROUP BY 1"""


@query("G1", "multiset_score", _multiset_sql("number || ':' || name"))
def _multiset(t):
    return evaluate.multiset_score(*predictions(t), "pull_id", F.concat("number", F.lit(":"), "name"))


@query("J4", "pluggable_keyer", _multiset_sql("upper(name)"))
def _keyer(t):
    return evaluate.multiset_score(*predictions(t), "pull_id", F.upper(S.normalize_name(F.col("name"))))


_TWO = _CELLS + """,
s AS (SELECT pull_id, name, number, row_number() OVER (PARTITION BY pull_id, name, number) AS i FROM c WHERE NOT needs_review),
w AS (SELECT pull_id, name, number, row_number() OVER (PARTITION BY pull_id, name, number) AS i FROM t),
x AS (SELECT s.pull_id, s.name, count(*) AS x FROM s JOIN w ON s.pull_id = w.pull_id AND s.name = w.name AND s.number = w.number AND s.i = w.i GROUP BY 1, 2),
n AS (SELECT coalesce(a.pull_id, b.pull_id) AS pull_id, coalesce(a.name, b.name) AS name, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(o, 0) AS o FROM (SELECT pull_id, name, count(*) AS p FROM s GROUP BY 1, 2) a
  FULL JOIN (SELECT pull_id, name, count(*) AS t, count(*) FILTER (WHERE number IS NULL) AS o FROM w GROUP BY 1, 2) b ON a.pull_id = b.pull_id AND a.name = b.name),
y AS (SELECT n.*, coalesce(x, 0) AS x, least(p - coalesce(x, 0), o) AS op FROM n LEFT JOIN x ON n.pull_id = x.pull_id AND n.name = x.name),
z AS (SELECT pull_id, sum(x + op) AS correct, sum(least(p - x - op, t - x - op)) AS numdiff, sum(p - x - op - least(p - x - op, t - x - op)) AS wrong FROM y GROUP BY 1),
f AS (SELECT pull_id, count(*) AS flagged, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pull_id = c.pull_id AND t.name = c.name)) AS misdisplay FROM c WHERE needs_review GROUP BY 1),
sc AS (SELECT z.pull_id, CAST(correct AS BIGINT) AS correct, CAST(numdiff AS BIGINT) AS numdiff, CAST(wrong AS BIGINT) AS wrong, coalesce(flagged, 0) AS flagged, coalesce(misdisplay, 0) AS misdisplay FROM z LEFT JOIN f ON z.pull_id = f.pull_id)"""


@query("G2", "two_tier_score", f"WITH {_TWO} SELECT * FROM sc")
def _two_tier(t):
    return evaluate.two_tier_score(*predictions(t), "pull_id")


@query("G3", "regression_ratchet", f"""WITH {_TWO} SELECT pull_id, numdiff, CASE WHEN pull_id % 3 = 0 THEN 1 ELSE 0 END AS pin,
  CASE WHEN numdiff > CASE WHEN pull_id % 3 = 0 THEN 1 ELSE 0 END THEN 'fail' WHEN numdiff < CASE WHEN pull_id % 3 = 0 THEN 1 ELSE 0 END THEN 'improved' ELSE 'pass' END AS verdict FROM sc""")
def _ratchet(t):
    score = evaluate.two_tier_score(*predictions(t), "pull_id")
    pins = t.submissions.filter("pull_id % 3 = 0").select("pull_id", F.lit(1).cast("bigint").alias("numdiff"))
    return evaluate.ratchet(score, pins, "pull_id", "numdiff").select(
        "pull_id", "numdiff", F.col("pin").cast("int").alias("pin"), "verdict")
