import zlib
from collections import defaultdict

import numpy as np
import pytest

from cardloom.llm import mixing, packing
from tests.llm import brute

STRIPS = "strip_id long, text string, source string"


def _strips():
    rows, i = [], 0
    for source, n in (("upload", 90), ("harvest", 30), ("b", 7), ("é", 3), (None, 20), ("zero", 1)):
        for k in range(n):
            rows.append((i, None if source == "zero" else "word " * (k % 9 * 11 + 1), source))
            i += 1
    return rows


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_STRIPS", 40)
    rows = _strips() + [_strips()[5]]
    got = mixing.mix(spark.createDataFrame(rows, STRIPS)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    shards = -(-len(rows) // 40)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK * (1 + shards / 2)
    again = mixing.mix(spark.createDataFrame(rows, STRIPS).repartition(7)).collect()
    assert sorted((r["strip_id"], r["taken"]) for r in got) == sorted((r["strip_id"], r["taken"]) for r in again)
    other = mixing.mix(spark.createDataFrame(rows, STRIPS), seed=8).collect()
    assert sorted((r["strip_id"], r["taken"]) for r in got) != sorted((r["strip_id"], r["taken"]) for r in other)


@pytest.mark.parametrize("total", [0, 1, 7, 100, 1001])
def test_apportion_is_sainte_lague(spark, total):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 53.0, "f": 1.5}
    df = spark.createDataFrame(list(weights.items()), "item string, weight double")
    got = {r["item"]: r["blocks"] for r in mixing.apportion(df, total, "weight", "item").collect()}
    assert got == brute.sainte_lague(weights, total)
    from pyspark.sql import functions as F
    two = df.withColumn("g", F.lit("x")).unionByName(df.withColumn("g", F.lit("y"))).withColumn("t", F.lit(total))
    by = mixing.apportion_by(two, "g", "t", "weight", "item").collect()
    assert {(r["g"], r["item"]): r["blocks"] for r in by} == {(g, i): n for g in "xy" for i, n in got.items()}


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], STRIPS)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b"), (None, "", None)], STRIPS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3


def test_mix_is_native(spark):
    df = mixing.mix(spark.createDataFrame(_strips(), STRIPS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def _check_pieces(rows, pieces):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in rows:
        ids, at = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], np.uint32), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes()) and list(part) == list(r["ids"])
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and {r["tier"] for r in pieces} == {at}
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return sequences, padding


def test_packing_covers_every_id_once(spark):
    rows = [(i, " ".join(f"card {i} row {k}" for k in range(i % 37 * 9))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "x" * 5000), (903, "a<|endoftext|>b"), (904, "word " * 60000), (905, "日本 \U0001f600")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "strip_id long, text string, tier int").repartition(3)
    sequences, padding = _check_pieces(rows, packing.pack(df).collect())
    assert padding <= 3 * 1024
    assert {1024, 512, 256, 128} <= {p[0]["tier"] for p in sequences.values()}


def test_steps_weigh_the_same(spark):
    rows = [(i, "strip text with words " * (i % 50)) for i in range(2000)]
    steps = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(rows, "strip_id long, text string").coalesce(1), with_ids=False).collect():
        steps[r["step_id"]].add((r["sequence_id"], r["tier"]))
    weights = [sum(t for _, t in s) for s in steps.values()]
    assert max(weights) == packing.STEP_TOKENS and sum(w < packing.STEP_TOKENS for w in weights) <= len(packing.TIERS) + 1
    assert all(len({t for _, t in s}) == 1 for s in steps.values())


def test_packing_lots_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT_TOKENS", 500)
    rows = [(i, "strip text " * (i % 23 * 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "strip_id long, text string").coalesce(1)
    _, padding = _check_pieces(rows, packing.pack(df).collect())
    assert padding <= 1024
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b")], "strip_id long, text string").coalesce(1)).collect()
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert packing.pack(spark.createDataFrame([], "strip_id long, text string")).collect() == []
