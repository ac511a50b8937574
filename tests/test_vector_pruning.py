"""Exact search with pruning: multi-index hashing and pivot blocks against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import vectors


def _hashes(rng, n, centres, flips):
    out = []
    for i in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randrange(flips + 1)):
            h ^= 1 << rng.randrange(64)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _nearest(queries, refs, allowed):
    out = {}
    for q in {q for q, _ in queries}:
        best = []
        for s in {s for x, s in allowed if x == q}:
            d = [(((h ^ g) & (1 << 64) - 1).bit_count(), r) for x, h in queries if x == q for t, r, g in refs if t == s]
            if d:
                best.append((min(d)[0], s, min(d)[1]))
        if best := sorted(best):
            out[q] = (best[0][1], best[0][2], best[0][0], best[1][0] if len(best) > 1 else None)
    return out


@pytest.mark.parametrize("cost", [0.01, 0.5, 1e9])
def test_probes_and_products_give_the_nearest_hash(spark, cost):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    refs = [(f"s{i % 3}", i, h) for i, h in enumerate(_hashes(rng, 240, centres, 6))] + [("s0", 900, 5), ("s0", 901, 5)]
    queries = [(i % 40, h) for i, h in enumerate(_hashes(rng, 55, centres, 9) + [rng.getrandbits(63) for _ in range(5)])]
    allowed = [(q, f"s{s}") for q in range(40) for s in range(3) if (q + s) % 4] + [(0, "none")]
    q, r, a = (spark.createDataFrame(*x) for x in ((queries, "query_id long, hash long"), (refs, "set_id string, ref_id long, hash long"), (allowed, "query_id long, set_id string")))
    got = {x["query_id"]: (x["set_id"], x["ref_id"], x["distance"], x["second"]) for x in vectors.nearest_hash_per_set(q, r, a, cost=cost).collect()}
    assert got == _nearest(queries, refs, allowed)


def test_near_queries_meet_few_references(spark):
    rng = random.Random(4)
    refs = [("s", i, rng.getrandbits(63)) for i in range(20_000)]
    queries = [(i, refs[i * 7][2] ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60)) for i in range(300)]
    q, r = spark.createDataFrame(queries, "query_id long, hash long"), spark.createDataFrame(refs, "set_id string, ref_id long, hash long")
    found, open_ = vectors.probe_segments(q.withColumn("set_id", F.lit("s")), r)
    rows = found.collect()
    assert open_.count() == 0 and {x["query_id"]: x["ref_id"] for x in rows} == {i: i * 7 for i in range(300)}
    assert sum(x["met"] for x in rows) < 300 * 20_000 / 1000        # of the pairs that products would make


def _brute(queries, refs, k):
    out = {}
    for i, s, v in queries:
        scored = sorted(((-round(float(np.dot(np.array(v, float), np.array(w, float))), 9), r) for r, t, w in refs if t == s))
        out[i] = [(r, round(-x, 4)) for x, r in scored[:k]]
    return {i: rows for i, rows in out.items() if rows}


@pytest.mark.parametrize("kind", ["clusters", "random", "adversarial"])
def test_pivot_blocks_lose_nothing(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        centres = rng.normal(size=(12, 16))
        refs, asked = (centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 16)) for n in (400, 30))
    elif kind == "random":
        refs, asked = rng.normal(size=(400, 16)), rng.normal(size=(30, 16))
    else:       # equal vectors, opposite ones, one far longer, one without direction
        refs = np.concatenate([np.repeat(rng.normal(size=(3, 16)), 100, 0), -np.repeat(rng.normal(size=(1, 16)), 80, 0), 50 * rng.normal(size=(2, 16)), np.zeros((2, 16))])
        asked = np.concatenate([refs[::40], -refs[:3], np.zeros((1, 16))])
    if kind != "adversarial":
        refs, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (refs, asked))
    r = [(i, "a" if i % 9 else "b", [float(x) for x in v]) for i, v in enumerate(refs)]
    q = [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(asked)] + [(999, "none", [0.5] * 16)]
    qd, rd = spark.createDataFrame(q, "query_id long, set_id string, v array<double>"), spark.createDataFrame(r, "ref_id long, set_id string, v array<double>")
    want = _brute(q, r, 4)
    for block in (25, 2048):
        got = {}
        for row in sorted(vectors.top_k_cosine(qd, rd, 4, block=block).collect(), key=lambda x: (x["query_id"], x["rank"])):
            got.setdefault(row["query_id"], []).append((row["ref_id"], row["score"]))
        assert got == want
    _, counts = vectors._pruned(qd, rd, 4, "set_id", 25, "query_id long, ref_id long, score double")
    print(kind, counts)
    assert counts["visited"] <= counts["possible"] and (kind != "clusters" or counts["visited"] < 0.5 * counts["possible"])
