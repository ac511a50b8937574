"""Blocking loses no pair that the token-aware score puts at the floor: equality with all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import fuzzy


def _edit(a, b):
    if not a and not b:
        return 100.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 100.0 * (1 - row[-1] / max(len(a), len(b)))


def score(a, b):
    """The token-aware score, spelled out."""
    ta, tb = a.split(), b.split()
    da, db = sorted(set(ta)), sorted(set(tb))
    shared = " ".join(t for t in da if t in db)
    left = " ".join(filter(None, [shared, *(t for t in da if t not in db)]))
    right = " ".join(filter(None, [shared, *(t for t in db if t not in da)]))
    sets = max(_edit(left, right), *((_edit(shared, left), _edit(shared, right)) if shared else (0,)))
    short, long = sorted((a, b), key=len)
    partial = 0.0
    if short and len(long) >= 1.5 * len(short):
        windows = [long[i:i + len(short)] for i in range(len(long) - len(short) + 1)]
        partial = (0.9 if len(long) <= 8 * len(short) else 0.6) * max(_edit(short, w) for w in windows)
    return max(_edit(a, b), 0.95 * _edit(" ".join(sorted(ta)), " ".join(sorted(tb))), 0.95 * sets, partial)


def _names(rng, n):
    words = ["vmax", "n", "s", "erika", "oddish", "klink", "klinklang", "pikachu", "surfing", "determination", "lillie", "of", "ex"]
    out = set()
    for _ in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 7])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(name) + 1)
            name = name[:i] + rng.choice(["", "x", " ", "k"]) + name[i + rng.choice([0, 1]):]
        out.add(" ".join(name.split()))
    return sorted(out - {""})


@pytest.mark.parametrize("floor", [82.0, 80.0])
def test_no_pair_at_the_floor_is_lost(spark, floor):
    rng = random.Random(int(floor))
    queries, keys = _names(rng, 150), _names(rng, 150) + ["a", "ab"]
    q, k = (spark.createDataFrame([(x,) for x in sorted(set(xs))], f"{c} string") for c, xs in (("q", queries), ("key", keys)))
    got = fuzzy.token_pairs(q, k, floor).withColumn("score", fuzzy.composite_score(F.col("q"), F.col("key"))).filter(F.col("score") >= floor - 1e-9)
    want = {(a, b): s for a in set(queries) for b in set(keys) if (s := score(a, b)) >= floor - 1e-9}
    have = {(r["q"], r["key"]): r["score"] for r in got.collect()}
    assert set(have) == set(want) and len(want) > 500
    assert all(have[p] == pytest.approx(want[p]) for p in want)


def test_a_short_name_stands_in_a_long_one(spark):
    pairs = [("oddish", "erika s oddish"), ("oddsh", "erika s oddish"), ("klink", "n s klinklang"), ("determinatoin", "lillie s determination"), ("ditto", "a b")]
    df = spark.createDataFrame(pairs, "q string, key string")
    got = {r["q"]: r["s"] for r in df.select("q", fuzzy.aligned_score(F.col("q"), F.col("key")).alias("s")).collect()}
    assert got["oddish"] == got["klink"] == 100 and got["oddsh"] == pytest.approx(60) and got["ditto"] < 50
    found = fuzzy.token_pairs(df.select("q"), df.select("key"), 82.0).collect()
    assert {("oddish", "erika s oddish"), ("klink", "n s klinklang")} <= {(r["q"], r["key"]) for r in found}


def test_scope_keeps_sets_apart(spark):
    q = spark.createDataFrame([("klink", "sv09"), ("klink", "sv10"), ("big red ring", "sv09")], "q string, scope string")
    k = spark.createDataFrame([("n s klink", "sv09"), ("n s klinklang", "sv09"), ("big rod ring", "sv09"), ("big rod ring", "sv10")], "key string, scope string")
    got = {tuple(r) for r in fuzzy.token_pairs(q, k, 80.0, ["scope"]).select("q", "key", "scope").collect()}
    assert got == {("klink", "n s klink", "sv09"), ("klink", "n s klinklang", "sv09"), ("big red ring", "big rod ring", "sv09")}


def test_pairs_met_do_not_grow_with_a_common_token(spark):
    """Half of the names hold one token; what the rarest tokens meet is what covers."""
    names = [(f"vmax w{i:04}q",) for i in range(800)] + [(f"plain{i:04} z{i}",) for i in range(800)]
    x, y = spark.createDataFrame(names, "x string"), spark.createDataFrame(names, "y string")
    need = 82.0 / fuzzy.TOKEN_WEIGHT
    assert fuzzy.covering_pairs(x, y, need, []).count() == len(names)
    q, k = x.withColumnRenamed("x", "q"), y.withColumnRenamed("y", "key")
    # 'vmax w0001q' and 'vmax w0002q' are close; all others that share the token only are never paired.
    assert fuzzy.split_pairs(q, k, 95.0, []).count() < 5 * len(names)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], "q string"), spark.createDataFrame([("pikachu",), ("",)], "key string")
    assert fuzzy.token_pairs(none, one, 82.0).collect() == []
