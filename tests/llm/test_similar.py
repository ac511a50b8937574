import random

from pyspark.sql import functions as F

from cardloom.llm import simhash, similar
from tests.llm import brute

STRIPS = "strip_id long, text string, source string"


def test_edited_copies_leave_one_row_as_by_brute_force(spark):
    rng, rows = random.Random(11), []
    for g in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 300]))]
        for k in range(6):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10 ** 6)}"
            rows.append((len(rows) + 1, " ".join(text), "x"))
    # Copies that each are near the original and not near each other.
    base = [f"v{i}" for i in range(400)]
    rows.append((500, " ".join(base), "x"))
    for k in range(8):
        rows.append((501 + k, " ".join(base[:40 * k + 1] + ["new%d" % k] * 30 + base[40 * k + 31:]), "x"))
    rows += [(900, None, "x"), (901, " ", "x"), (902, "one two", "x"), (903, "one two", "x"), (904, "one three", "x")]
    df, want = spark.createDataFrame(rows, STRIPS), brute.jaccard_classes({i: t for i, t, _ in rows})
    got = {r["strip_id"]: r["component_id"] for r in similar.similar_classes(df).collect()}
    assert got == want
    assert sorted(r["strip_id"] for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))
    # What two bits of three-word shingles leave is more: the edited copies.
    assert len({r["component_id"] for r in simhash.near_duplicates(df).collect()}) > len(set(want.values()))


def test_the_ring_links_first_and_bands_take_the_rest(spark, monkeypatch):
    """Long texts of one edit are within two bits and linked by the ring, each on the whole sets; bands check what is still apart."""
    rng, rows = random.Random(8), []
    for g in range(6):
        base = [f"r{rng.randrange(10 ** 6)}" for _ in range(3000)]
        rows.append((len(rows), " ".join(base), "x"))
        for edits in (1, 1, 1, 90):         # 90 edits: near 0.8, beyond two bits
            text = list(base)
            for at in rng.sample(range(0, 3000, 10), edits):
                text[at] = f"edit{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text), "x"))
    df, want = spark.createDataFrame(rows, STRIPS), brute.jaccard_classes({i: t for i, t, _ in rows})
    asked, ringed = [], []
    for module, name, seen in ((similar, "_checked", asked), (simhash, "alike", ringed)):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, seen=seen: (seen.append(a[0].collect()), seen.append((out := real(*a)).collect()), out)[2])
    assert sorted(r["strip_id"] for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))
    # Without the ring, bands would check 24 texts with the smallest of their class.
    assert len(ringed[1]) >= 9 and 0 < len(asked[0]) <= 15
    assert not {frozenset(r) for r in ringed[1]} & {frozenset(r) for r in asked[0]}
    # Two bits are no proof: the sets decide.
    marks = similar.marked_rows(spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z")], "strip_id long, text string"), "strip_id", "text")
    pair = marks.groupBy().agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
    assert similar.alike(pair, marks, spark.createDataFrame([("a b c d e f",), ("u v w x y z",)], "text string"), "text").collect() == []


def _family(rng, n, own, words=100):
    """Texts that each put ``own`` runs of five words of their own in a base."""
    base, out = [f"b{rng.randrange(10 ** 9)}" for _ in range(words)], []
    for k in range(n):
        text = list(base)
        for i in rng.sample(range(0, words, 5), own):
            text[i:i + 5] = [f"own{rng.randrange(10 ** 9)}" for _ in range(5)]
        out.append(" ".join(text))
    return out


def test_large_files_are_filed_again_and_cut(spark, monkeypatch):
    """Slices of five: the same classes as by brute force, so no link is lost in large files."""
    rng = random.Random(5)
    texts = _family(rng, 40, 6) + _family(rng, 30, 1)
    base = [f"c{i}" for i in range(120)]
    for k in range(30):                 # a chain: each is near the next ones only
        text = list(base)
        for i in range(k):
            text[3 * i] = f"x{i}"
        texts.append(" ".join(text))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df, want = spark.createDataFrame(rows, STRIPS), brute.jaccard_classes({i: t for i, t, _ in rows})
    for file in (5, 1024):
        monkeypatch.setattr(similar, "FILE", file)
        assert {r["strip_id"]: r["component_id"] for r in similar.similar_classes(df).collect()} == want


def test_checks_and_links_grow_with_the_texts(spark, monkeypatch):
    """A family at similarity near a half and one of near copies: a check a text and a link a text at most, not all pairs."""
    rng, seen = random.Random(6), []
    for name in ("_checked", "_across"):
        real = getattr(similar, name)
        monkeypatch.setattr(similar, name, lambda *a, real=real, name=name: (
            seen.append(a[0].count()) if name == "_checked" else None, out := real(*a), seen.append(out.count()))[1])
    for n in (200, 800):
        seen.clear()
        texts = _family(rng, n, 7, 400) + _family(rng, n, 1, 400)
        got = similar.similar_classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "strip_id long, text string")).collect()
        assert len(seen) == 3 and sum(seen) < 6 * n
        assert len({r["component_id"] for r in got if r["strip_id"] < n}) > 0.9 * n > 1 >= len({r["component_id"] for r in got if r["strip_id"] >= n})


def test_edges_of_classes(spark):
    rows = [(None, "a b c d e f g", "y"), (None, "a b c d e f g", "y"), (3, None, ""), (4, "", ""), (5, " \n\t ", ""), (6, "one", ""), (6, "One", ""), (7, "two", "")]
    got = sorted(((r["strip_id"], r["component_id"]) for r in similar.similar_classes(spark.createDataFrame(rows, STRIPS)).collect()), key=str)
    assert got == sorted([(None, None)] * 2 + [(3, 3), (4, 3), (5, 3), (6, 6), (6, 6), (7, 7)], key=str)
    assert similar.similar_classes(spark.createDataFrame([], STRIPS)).collect() == []
    named = spark.createDataFrame([(1, "x y", "u", 1, 2, 3)], "strip_id long, text string, mark string, n long, root long, keys long")
    assert [tuple(r) for r in similar.similar_classes(named).collect()] == [(1, 1)]
    words = " ".join(f"w{i}" for i in range(300_000))
    long = spark.createDataFrame([(1, words), (2, words + " more")], "strip_id long, text string")
    assert {r["component_id"] for r in similar.similar_classes(long).collect()} == {1}
