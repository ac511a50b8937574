"""Similarity search over the embeddings table (set = label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import vectors
from cardloom.queries.registry import query

_SIM = """s AS (SELECT q.vec_id AS query_id, i.vec_id AS ref_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 5 = 0 AND i.vec_id % 5 <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s)"""


def ranked(t, k=5):
    e = t.table("embeddings").select("vec_id", F.col("label").alias("set_id"), F.col("embedding").alias("v"))
    return vectors.top_k_cosine(e.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"),
                                e.filter("vec_id % 5 <> 0").withColumnRenamed("vec_id", "ref_id"), k)


@query("C17", "top_k_cosine", f"WITH {_SIM} SELECT query_id, ref_id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM rk WHERE rank <= 5")
def _cosine(t):
    return ranked(t).select("query_id", "ref_id", "rank", "score")


@query("F5", "top_3_per_query", f"WITH {_SIM} SELECT query_id, ref_id, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3")
def _top3(t):
    return ranked(t, 3).select("query_id", "ref_id", "rank")


@query("E9", "accept_with_margin", f"""WITH {_SIM}, two AS (SELECT query_id, max(CASE WHEN rank = 1 THEN ref_id END) AS ref_id, max(CASE WHEN rank = 1 THEN round(score, 4) END) AS score, max(CASE WHEN rank = 2 THEN round(score, 4) END) AS second FROM rk GROUP BY 1)
SELECT query_id, ref_id, score, second, score >= 0.5 AND (second IS NULL OR score - second >= 0.02) AS accepted FROM two""")
def _accept(t):
    return vectors.accept_with_margin(ranked(t, 2), accept=0.5)


_HASH = "CAST(list_sum([CASE WHEN embedding[i + 1] <= 0 THEN 0 WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(i AS INT) END FOR i IN range(64)]) AS BIGINT)"


@query("C16", "nearest_hash_per_set", f"""WITH h AS (SELECT vec_id, label, {_HASH} AS hash FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.label AS set_id, bit_count(xor(q.hash, r.hash)) AS d, r.vec_id AS ref_id FROM h q JOIN h r ON r.label IN (q.label, (q.label + 1) % 10, (q.label + 3) % 10) WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, set_id ORDER BY d, ref_id) AS r FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, set_id) AS rank FROM b WHERE r = 1),
t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN set_id END) AS set_id, max(CASE WHEN rank = 1 THEN ref_id END) AS ref_id, CAST(max(CASE WHEN rank = 1 THEN d END) AS INT) AS distance, CAST(max(CASE WHEN rank = 2 THEN d END) AS INT) AS second FROM k GROUP BY 1)
SELECT *, second - distance AS margin FROM t""")
def _hash(t):
    h = t.table("embeddings").select("vec_id", "label", vectors.sign_hash(F.col("embedding")).alias("hash"))
    q = h.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    allowed = q.select("query_id", F.explode(F.array(*[((F.col("label") + i) % 10) for i in (0, 1, 3)])).alias("set_id"))
    refs = h.filter("vec_id % 5 <> 0").select(F.col("label").alias("set_id"), F.col("vec_id").alias("ref_id"), "hash")
    return vectors.nearest_hash_per_set(q.select("query_id", "hash"), refs, allowed)
