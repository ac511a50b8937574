import gc
import math
import random
import tracemalloc
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.llm import elias_fano, ngram_lm

STRIPS = "strip_id long, text string, n_tokens string"


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 1 << 62), (7, 3), (1000, 10), (1000, 5000), (5000, 1 << 40), (200_000, 1 << 21), (3000, 1 << 62)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    if n > 20:
        values[n // 2:n // 2 + 10] = values[n // 2]
    values = np.sort(values)
    seq = elias_fano.Monotone(elias_fano.Monotone.encode(values))
    assert (seq.access(np.arange(n)) == values).all()
    asked = np.unique(np.r_[values, values + 1, np.maximum(values, 1) - 1, rng.integers(0, top + 2, 500), 0])
    at, hit = seq.find(asked)
    assert (at == np.searchsorted(values, asked)).all() and (hit == np.isin(asked, values)).all()


def test_children_of_contexts():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 500) * rng.integers(0, 2, 500)
    children = [np.sort(rng.choice(300, c, replace=False)) for c in counts]
    level = elias_fano.Children(*elias_fano.Children.encode(counts, np.concatenate(children)))
    starts = np.cumsum(counts) - counts
    parents, asked = np.repeat(np.arange(500), 300), np.tile(np.arange(300), 500)
    at, hit = level.find(parents, asked)
    want = {(p, c): starts[p] + i for p, cs in enumerate(children) for i, c in enumerate(cs.tolist())}
    assert hit.sum() == len(want)
    assert all(want[p, c] == i for p, c, i in zip(parents[hit].tolist(), asked[hit].tolist(), at[hit].tolist()))
    assert (level.size(np.arange(500)) == counts).all()


def test_files_are_read_as_written(tmp_path):
    parts = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint8), np.arange(3, dtype=np.uint8)]
    elias_fano.make_folder(f"file://{tmp_path}/new")
    elias_fano.write_file(f"file://{tmp_path}/new", "x", parts)
    got = elias_fano.read_file(f"file://{tmp_path}/new", "x")
    assert [g.tobytes() for g in got] == [p.tobytes() for p in parts]
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["x"]


def test_codes_add_no_mass():
    p = np.random.default_rng(1).random(1000) ** 20
    told = ngram_lm.VALUES[ngram_lm.codes(p)]
    assert (told <= p * (1 + 1e-9)).all() and ((told > p * 2 ** (-1.01 / 8)) | (p < 2.0 ** -31)).all()


def _words(text):
    return [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]


def brute(training, texts):
    """(tokens, known, base, score) by counted n-grams in dictionaries, with the same bytes for shares."""
    grams = [Counter(), Counter(), Counter()]
    for t in training:
        seq = [b"", *_words(t), b""]
        grams[0].update(seq[1:])
        grams[1].update(zip(seq, seq[1:]))
        grams[2].update(zip(seq, seq[1:], seq[2:]))
    total, kinds = sum(grams[0].values()), len(grams[0])
    types = [None, Counter(g[:1] for g in grams[1]), Counter(g[:2] for g in grams[2])]
    uses = [None, Counter(), Counter()]
    for k in (1, 2):
        for g, n in grams[k].items():
            uses[k][g[:k]] += n
    told = lambda p: 2.0 ** (-math.ceil(-8 * math.log2(p) - 1e-9) / 8)

    def prob(context, w):
        if not context:
            return (grams[0][w] + 1) / (total + kinds + 1)
        k, g = len(context), (*context, w)
        below = prob(context[1:], w)
        if not uses[k][context]:
            return below
        share = told((grams[k][g] - 0.75) / uses[k][context]) if grams[k][g] else 0
        return share + told(0.75 * types[k][context] / uses[k][context]) * below
    out = []
    for t in texts:
        seq = [b"", *_words(t), b""]
        known = sum(grams[0][w] > 0 for w in seq[1:])
        base = sum(math.log10((grams[0][w] + 1) / (total + kinds + 1)) for w in seq[1:])
        out.append((len(seq) - 1, known, base, sum(math.log10(prob(tuple(seq[max(0, i - 2):i]), seq[i])) for i in range(1, len(seq)))))
    return out


@pytest.mark.parametrize("shard,chunk", [(1 << 21, 6 << 20), (37, 300)])
def test_scores_are_those_of_counted_grams(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    rng = random.Random(3)
    vocabulary = ["the"] * 40 + [f"w{i}" for i in range(60)] + ["Ünd", "ünd", "THE", "x" * 500]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(120)]
    texts += [None, "", "  ", "never seen words", "the never the w3", texts[5], texts[5], " ".join(["the"] * 3000)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "the w1 w2", "clash")]
    held = lambda i: i is not None and i % 7 == 2
    df = spark.createDataFrame(rows, STRIPS).repartition(3)
    strips = df.drop("n_tokens")
    model = ngram_lm.train(strips.filter("coalesce(strip_id % 7 <> 2, true)"), shard=shard)
    got = ngram_lm.score_texts(df, model, carry=(F.col("text").alias("of"),)).collect()
    want = dict(zip([r[1] or "" for r in rows], brute([t for i, t, _ in rows if not held(i)], [t for _, t, _ in rows])))
    assert len(got) == len(rows)
    for r in got:
        n, known, base, score = want[r["of"] or ""]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base, abs=1e-7) and r["score"] == pytest.approx(score, abs=1e-6)


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame([(2, "all held out"), (9, None)], "strip_id long, text string")
    rows = ngram_lm.score_strips(df, F.col("strip_id") % 7 == 2).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in sorted(rows)] == [(True, 4, 0, 0, 0, 0), (True, 1, 0, 0, 0, 0)]
    assert ngram_lm.score_strips(df.limit(0), F.lit(False)).collect() == []


def test_held_out_copies_and_grammar_score_above_single_words(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{a} {a}{rng.randrange(3)}" for a in rng.choices("pqrstu", k=30)) for _ in range(200)]
    rows = ngram_lm.score_strips(spark.createDataFrame(list(enumerate(texts)), "strip_id long, text string"), F.col("strip_id") % 7 == 2).filter("held_out").collect()
    assert rows and all(r["score"] > r["base_score"] + 10 for r in rows)


def test_files_that_cannot_be_mapped_are_not_all_held(tmp_path, monkeypatch):
    for i in range(12):
        elias_fano.write_file(f"file://{tmp_path}", f"x{i}", [np.full(1 << 17, i, np.uint64)])
    away = pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem())
    monkeypatch.setattr(elias_fano.pa.fs, "FileSystem", type("Away", (), {"from_uri": staticmethod(lambda uri: (away, ""))}))
    before = pa.total_allocated_bytes()
    for i in range(12):
        assert (elias_fano.read_file("away://", f"x{i}")[0].view(np.uint64) == i).all()
    assert pa.total_allocated_bytes() - before < 6 << 20


def _peak(run):
    gc.collect()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_task_stays_near_its_chunk_and_its_shard(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{w}" for w in rng.zipf(1.3, 400) % 5000) for _ in range(500)]
    n_tokens, n_bytes = 500 * 401, sum(map(len, texts))
    df = spark.createDataFrame(list(enumerate(texts)), "strip_id long, text string").repartition(2)
    one, many = ngram_lm.train(df), ngram_lm.train(df, shard=n_tokens // 40)
    column = pa.array(texts)
    shards = ngram_lm._gram_counts(one)(iter([pa.RecordBatch.from_arrays([column], names=["text"])]))
    packed = [b.as_py() for batch in shards for b in batch.column(1)]
    assert _peak(lambda: ngram_lm._write_shard(one, 99, packed * 3)) < 150 * n_tokens
    opened, most = weakref.WeakSet(), []

    class Counted(ngram_lm.Shard):
        def __init__(self, *args):
            gc.collect()
            super().__init__(*args)
            opened.add(self)
            most.append(len(opened))
    monkeypatch.setattr(ngram_lm, "Shard", Counted)
    scores = ngram_lm.score_chunk(many, column)[3]
    assert len(most) >= 40 and max(most) <= 2
    monkeypatch.undo()
    assert _peak(lambda: ngram_lm.score_chunk(many, column)) < 25 * n_bytes
    assert scores == pytest.approx(ngram_lm.score_chunk(one, column)[3])
