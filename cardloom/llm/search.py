"""Exact top-k search over art vectors by the threshold algorithm on sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cardloom.plans.session import stage

#: Classes of equal vectors per block of candidates, and per block of queries.
BLOCK, QUERY_BLOCK = 8192, 1024
SCALE = 1024


def integer_vectors(vectors: DataFrame, card_key: str = "card_key", vector: str = "vector") -> DataFrame:
    """(id, vec): floor(1024 * x) of each component as double. Vectors that are NULL, or hold a
    NULL or non-finite component, and rows without id are left out; of an id with
    several vectors the smallest counts, so repeated rows are one."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(card_key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .groupBy("id").agg(F.min(F.transform("vector", lambda x: F.floor(x * SCALE).cast("long"))).alias("vec")))


def threshold_top(query: np.ndarray, matrix: np.ndarray, order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``matrix`` with the k highest inner products, ties to the smaller id, best first.

    ``order`` holds per dimension the rows by ascending component. Each dimension is read from the
    end that suits the query's sign, in steps of growing depth; every row met is scored whole. A
    row not met has at most the sum over dimensions of query times the component reached, so
    reading stops when the k-th score beats that bound; at equality an unmet row with a
    smaller id could still tie, so reading goes on."""
    n, d = matrix.shape
    if not n:
        return np.zeros(0, np.int64)
    used = np.nonzero(query)[0]
    q, met = query[used], np.zeros(n, bool)
    up = q > 0
    depth, step = 0, max(16, k)
    found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        reach = min(n, depth + step)
        read = np.zeros(n, bool)
        if len(used):
            rows = np.where(up, order[n - reach:n - depth][::-1][:, used], order[depth:reach][:, used])
            read[rows.ravel()] = True
        new = np.nonzero(read & ~met)[0] if len(used) else np.arange(n)
        met[new] = True
        found, score = np.concatenate((found, new)), np.concatenate((score, matrix[new] @ query))
        best = np.lexsort((ids[found], -score))[:k]
        found, score = found[best], score[best]
        depth, step = reach, step * 2
        if depth >= n or met.all():
            return found
        bound = int((q * matrix[rows[-1], used]).sum())
        if len(found) == k and score[-1] > bound:
            return found


def top_cards(vectors: DataFrame, queries, k: int = 10, card_key: str = "card_key", vector: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` cards with the highest integer inner product for each
    query, itself excluded, ties to the smaller id; fewer where there are fewer.

    ``queries``: condition on ``id`` that picks the query rows. Equal vectors are one class, of which the
    k + 1 smallest ids can matter (all of a class tie); queries of one class share one search. Classes
    are dealt in blocks of bounded size with own sorted lists, and each block of queries meets each
    block of candidates once. Scores are 64-bit; vectors of different lengths do not meet."""
    rows = stage(integer_vectors(vectors, card_key, vector).withColumn("is_query", queries), "integers")
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = rows.select("vec", "id", first.alias("place")).filter(F.col("place") <= k + 1)
    classes = members.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.groupBy("vec").agg(F.max("is_query").alias("asked"))
    classes = stage(classes.join(asked, "vec").select(
        F.element_at("ids", 1).alias("cid"), "vec", "ids", "asked", F.size("vec").alias("dim")), "classes")
    n_blocks = max(1, -(-classes.count() // BLOCK))
    n_query_blocks = max(1, -(-classes.filter("asked").count() // QUERY_BLOCK))

    def packed(df: DataFrame, n: int, name: str, *more) -> DataFrame:
        return (df.groupBy("dim", F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int").alias(name))
                .agg(F.sort_array(F.collect_list(F.struct("cid", "vec", *more))).alias("r")))

    cards = packed(classes, n_blocks, "block", "ids")
    cards = cards.select("dim", "block", F.col("r.cid").alias("cids"), F.flatten("r.vec").alias("vecs"), F.col("r.ids").alias("ids"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("query_block"))
    asks = packed(classes.filter("asked"), n_query_blocks, "query_block")
    asks = asks.select("dim", "query_block", F.col("r.cid").alias("query_cids"), F.flatten("r.vec").alias("query_vecs"))

    def numbers(array) -> np.ndarray:
        return array.values.to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim = col["dim"][i].as_py()
                cids, query_cids = numbers(col["cids"][i]), numbers(col["query_cids"][i])
                matrix = numbers(col["vecs"][i]).reshape(len(cids), dim)
                asked = numbers(col["query_vecs"][i]).reshape(len(query_cids), dim)
                ids, order = col["ids"][i].as_py(), np.argsort(matrix, axis=0, kind="stable")
                out = ([], [], [])
                for qid, q in zip(query_cids.tolist(), asked):
                    hits = threshold_top(q, matrix, order, cids, k + 1)
                    best = [(s, x) for s, h in zip((matrix[hits] @ q).tolist(), hits.tolist()) for x in ids[h]]
                    for s, x in sorted(best, key=lambda p: (-p[0], p[1]))[:k + 1]:
                        out[0].append(qid), out[1].append(x), out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cid", "id", "score"])

    met = cards.join(asks, ["dim", "query_block"]).select("dim", "cids", "vecs", "ids", "query_cids", "query_vecs")
    hits = met.repartition(n_blocks * n_query_blocks).mapInArrow(run, "cid long, id long, score long")
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "id")
    best = stage(hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
                 .groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("hits")), "hits")
    # The class of a query row by its vector; its own id leaves the list.
    asked_rows = rows.filter("is_query").select(F.col("id").alias("query_id"), "vec") \
        .join(classes.filter("asked").select("vec", "cid"), "vec").join(best, "cid")
    kept = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return (asked_rows.select("query_id", F.posexplode(kept).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score")))
