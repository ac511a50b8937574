import random

import numpy as np
import pytest

from cardloom.llm import common, search, simhash
from tests.llm import brute

STRIPS = "strip_id long, text string, source string"


def _words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(n)]


def test_fingerprints_and_classes_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for g in range(12):
        base = _words(rng, rng.choice([40, 300]))
        for _ in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = "edit"
            rows.append((len(rows) + 5, " ".join(text), "upload"))
    rows += [(900, None, None), (901, "", "x"), (902, " \t\n", "x"), (903, "One", "x"), (904, "one", "x"), (905, "Two Words", "x"),
             (906, "ÄÖ äö ß x", "x"), (907, "word " * 30000, "x")]
    got = {r["strip_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, STRIPS)).collect()}
    marks = {i: brute.fingerprint(t) for i, t, _ in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in marks.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute.classes(marks)
    assert got[900]["component_id"] == got[902]["component_id"] == 900 and got[904]["component_id"] == 903


@pytest.mark.parametrize("pairwise", [64, 2])
def test_ring_misses_no_link(spark, monkeypatch, pairwise):
    """Chains of fingerprints two bits apart, and a dense ball that fills large files."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng, marks = random.Random(9), {}
    for start in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            marks[len(marks)] = f
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                f ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(200):
        f = centre
        for b in rng.sample(range(22), 3):
            f ^= 1 << (42 + b)
        marks[len(marks)] = f
    signed = {f: f - (1 << 64) if f >> 63 else f for f in marks.values()}
    df = spark.createDataFrame([(s,) for s in set(signed.values())], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.ring_links(df)).collect()}
    want = brute.classes(marks)
    ours = {}
    for i, f in marks.items():
        ours.setdefault(roots.get(signed[f], signed[f]), set()).add(i)
    theirs = {}
    for i, c in want.items():
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_files_hold_what_the_pigeonring_promises():
    """Any two values within two bits share a file; two in one file keep the chain's budget."""
    rng = random.Random(1)

    def files(f):
        out = set()
        for start, (low, width) in enumerate(simhash.RING):
            nlow, nwidth = simhash.RING[(start + 1) % 3]
            for bit in range(nlow, nlow + nwidth):
                mask = (((1 << width) - 1) << low) | (((1 << nwidth) - 1) << nlow) & ~(1 << bit)
                out.add((start, bit, f & mask))
        return out
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice([1, 2])):
            b ^= 1 << bit
        assert files(a) & files(b)


def test_one_row_of_each_class_stays_for_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(_words(rng, 60)) for _ in range(4))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (7, c, "x"), (7, d, "x"), (8, d, "x"), (9, None, "x"), (None, "", "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, STRIPS)).collect()
    assert sorted((r["strip_id"] or 0, r["text"] or "") for r in got) == sorted([(0, a), (0, b), (7, c), (7, d), (9, "")])


def test_near_duplicates_edge_rows(spark):
    empty = spark.createDataFrame([], STRIPS)
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(4, "a b c d", "x"), (4, "a b c d", "x"), (None, "a b c d", "x"), (9, "e f g h i", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], STRIPS + ", fingerprint int")
    got = sorted((r["strip_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 4), (4, 4), (4, 4), (9, 9)]
    kept = simhash.keep_one(df).collect()
    assert sorted(r["strip_id"] for r in kept) == [4, 9] and "fingerprint" in kept[0].asDict()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(7000, 7000)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and 7000 not in got


def test_top_cards_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    v = {i: rng.normal(size=6).round(2) for i in range(300)}
    for i in range(100, 190):
        v[i] = v[100]          # a third of all rows are one vector
    rows = [(i, [float(x) for x in y], "a") for i, y in v.items()]
    odd = [(None, [1.0] * 6, "a"), (501, None, "a"), (502, [1.0, None] + [0.0] * 4, "a"), (503, [float("nan")] + [0.0] * 5, "a"),
           (504, [float("inf")] + [0.0] * 5, "a"), rows[3], rows[20]]
    df = spark.createDataFrame(rows + odd, "card_key long, vector array<double>, score string")
    from pyspark.sql import functions as F
    got = {}
    for r in search.top_cards(df, F.col("id") % 10 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    whole = {i: np.floor(1024 * y).astype(int) for i, y in v.items()}
    want = brute.top_k(whole, lambda q: q % 10 == 0, 10)
    assert {q: sorted(x) for q, x in got.items()} == {q: [(n + 1, *p) for n, p in enumerate(x)] for q, x in want.items()}


def test_top_cards_few_rows_other_lengths_and_none(spark):
    from pyspark.sql import functions as F
    kind = "card_key long, vector array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (10, [0.5]), (20, []), (21, [])], kind)
    got = sorted(tuple(r) for r in search.top_cards(df, F.col("id") % 10 == 0, 10).collect())
    assert got == [(0, 1, 1, 0), (20, 1, 21, 0)]
    assert search.top_cards(spark.createDataFrame([], kind), F.col("id") % 10 == 0).collect() == []


def test_threshold_stops_before_the_end_and_is_exact():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 50, (3000, 2))
    m[0] = (500, 500)
    order, ids = np.argsort(m, axis=0, kind="stable"), np.arange(3000)
    for q in ((3, 2), (-1, 4), (0, 0), (0, -2)):
        s = m @ np.array(q)
        assert search.threshold_top(np.array(q), m, order, ids, 7).tolist() == np.lexsort((ids, -s))[:7].tolist()


def test_masked_parts_miss_no_link(spark):
    """Every pair within two bits shares a file of runs too, whichever bits differ, and no other pair is linked."""
    rng = random.Random(12)
    pairs = []
    for i in range(64):
        for j in range(i, 64):
            f = rng.getrandbits(64)
            pairs.append((f, f ^ 1 << i ^ (1 << j if j > i else 0)))
        f = rng.getrandbits(64)
        pairs.append((f, f ^ 1 << i ^ 1 << (i + 1) % 64 ^ 1 << (i + 2) % 64))
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in pairs]
    df = spark.createDataFrame([(x,) for p in signed for x in p], "fp long")
    want = {frozenset(s) for p, s in zip(pairs, signed) if (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset((r["a"], r["b"])) for r in simhash.ring_links(df, simhash.PARTS).collect()} == want
