"""Draws reach every pull, folds are whole, re-reads replay in time, folders are shared."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cardloom.functions import names
from cardloom.operators import claims, duels, fuzzy, layout, vectors
from cardloom.plans import session


def test_fold_is_full_decomposition(spark):
    texts = ["Ĳssel", "Ǆx", "１２ ﬁn", "Flabébé", "Nidoran♀", "ﬃ ½ ㎏ Ⅷ", "Łódź", "𝐀𝐛", "", None, "日本 x", "ÅÄÖ ß", "é" * 2000]
    def want(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))
        for k, v in (("♀", " f"), ("♂", " m"), ("★", ""), ("☆", ""), ("◇", "")):
            t = t.replace(k, v)
        import re
        return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", t.lower())).strip()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", names.normalize_name(F.col("t")).alias("n")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}
    assert got[0] == "ijssel" and got[1] == "dzx" and got[2] == "12 fin"


def test_opponents_are_any_other_pull(spark):
    rows = [(i, 1 if i % 3 else i % 40) for i in range(600)]      # trainer 1 holds two thirds
    v = spark.createDataFrame(rows, "pull_id long, trainer_id int")
    owner, seen = dict(rows), set()
    for seed in range(12):
        got = duels.random_opponents(v, v, seed).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.opponent_id == owner[r.opponent_pull] != r.trainer_id
            seen.add(r.opponent_pull)
    # 12 draws of 600 reach nearly all; none is out of reach by construction.
    assert len(seen) > 560
    one = v.filter("trainer_id = 1")
    assert all(r.opponent_pull is None for r in duels.random_opponents(one, one).collect())
    new = spark.createDataFrame([(9000, 77)], "pull_id long, trainer_id int")
    assert duels.random_opponents(new, v).collect()[0].opponent_pull in owner


def test_rescue_replays_in_time(spark):
    first = [(1, "A", True, 0), (2, "A", True, 1), (3, "Z", False, 2), (4, "D", True, 90)]
    again = [(1, 2, "A", True, 5), (2, 2, "B", True, 6), (3, 2, "C", True, 7), (4, 3, "B", True, 6), (5, 3, "C", True, 8),
             (6, 3, "E", False, 9), (7, 2, "F", False, 9), (8, 1, "Q", True, 9), (9, 3, "G", True, 9), (10, 5, "D", True, 50), (11, 4, "D", True, 95)]
    c = spark.createDataFrame(first, "pull_id int, code_normalized string, code_format_ok boolean, created_at int")
    r = spark.createDataFrame(again, "reread_id int, pull_id int, code_normalized string, code_format_ok boolean, at int")
    got = {x.reread_id: x.outcome for x in claims.rescue_claims(c, r).collect()}
    pulls, codes, want = set(), set(), {}
    for at, kind, i, p, code, ok in sorted([(a, 0, p, p, c, k) for p, c, k, a in first] + [(a, 1, i, p, c, k) for i, p, c, k, a in again]):
        out = "already_verified" if p in pulls else "bad_format" if not ok else "taken" if code in codes else "verified"
        if out == "verified":
            pulls.add(p)
            codes.add(code)
        if kind:
            want[i] = out
    assert got == want and got[1] == "taken" and got[2] == "verified" and got[3] == "already_verified" and got[10] == "verified" and got[11] == "taken"


def test_blanked_readings_lose_everything(spark):
    rows = [(1, 0, "12", "050", "P", 0.9, True, ["12/050"]), (1, 1, "12", "050", None, 0.95, True, ["x"]), (1, 2, None, None, None, 0.2, False, [])]
    df = spark.createDataFrame(rows, "pull_id int, row_index int, numerator string, denominator string, prefix string, confidence double, "
                                     "pattern_ok boolean, tokens array<string>")
    got = {r.row_index: r for r in layout.blank_duplicate_numbers(df).collect()}
    assert got[0].blank and (got[0].numerator, got[0].denominator, got[0].prefix, got[0].tokens, got[0].pattern_ok, got[0].confidence) == (None, None, None, None, False, 0.0)
    assert not got[1].blank and got[1].numerator == "12" and not got[2].blank


def test_token_pairs_lose_no_pair(spark):
    rng = random.Random(4)
    words = "pika chu char izard blast oise ex gx v mega dark light of the rocket".split()
    def name():
        return " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4])))
    keys = {name() for _ in range(60)} | {"ab cd"}
    asked = {"cd ab", "pikachu"}
    for k in sorted(keys):
        t = k.split()
        rng.shuffle(t)
        s = " ".join(t)
        at = rng.randrange(len(s))
        asked |= {s, s[:at] + s[at + 1:], s + " ex", k[::-1]}
    asked = {" ".join(a.split()) for a in asked} - {""}
    q, k = spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(a,) for a in keys], "key string")
    score = fuzzy.composite_score(F.col("q"), F.col("key"))
    def passed(df):
        return {(r.q, r.key) for r in df.withColumn("s", score).filter("s >= 82 - 1e-9").collect()}
    want = passed(q.crossJoin(k))
    assert passed(fuzzy.token_pairs(q, k, 82.0)) == want and ("cd ab", "ab cd") in want


def test_sign_hash_reads_every_value(spark):
    rng = random.Random(1)
    vs = [[rng.uniform(-1, 1) for _ in range(n)] for n in (1, 63, 64, 65, 200)]
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v array<double>")
           .orderBy("i").select(vectors.sign_hash(F.col("v")).alias("h")).collect()]
    for v, h in zip(vs, got):
        want = sum(1 << i for i in range(64) if sum(v[i::64]) > 0)
        assert h % (1 << 64) == want


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default=None):
            return self.folder

    class Fake:
        def __init__(self, folder, master):
            self.conf = Conf(folder)
            self.sparkContext = type("S", (), {"master": master, "applicationId": "x"})
    assert session.shared_folder(Fake("hdfs://a/b/", "yarn")) == "hdfs://a/b"
    with pytest.raises(RuntimeError):
        session.shared_folder(Fake(None, "local-cluster[2,1,1024]"))
    assert session.shared_folder(Fake(None, "local[4]")).endswith("cardloom-x")
    path = session.stage(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0]
    monkeypatch.setattr(session, "_STAGED", [path])
    assert session.clear_staged(spark) == 1
