"""Hand-made cells for the ladder and the answer merge, and live-session steps."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cardloom.operators import collection, fuzzy, identity, resolve
from cardloom.streaming import live


@pytest.fixture(scope="module")
def world(spark):
    sets = spark.createDataFrame(
        [("P1", "AAA", "Alpha", "a1", ["100"], None, False), ("P2", "BBB", "Beta", "b1", ["200"], None, False),
         ("P3", "CCC", "Promo", "c1", [], "SWSH", True)],
        "set_id string, set_code string, set_name string, catalog_id string, denominators array<string>, "
        "promo_prefix string, local_id_prefixed boolean")
    catalog = spark.createDataFrame(
        [("a1", "Alpha", "004", "Pikachu", 100), ("a1", "Alpha", "010", "Surfing Pikachu", 100), ("b1", "Beta", "007", "Raichu", 200),
         ("b1", "Beta", "008", "Pikachu", 200), ("c1", "Promo", "SWSH004", "Meowth V", 0)],
        "set_id string, set_name string, local_id string, name string, official_count int")
    nums = resolve.set_numerators(sets.select("set_id", "catalog_id"), catalog.drop("set_name").withColumnRenamed("set_id", "catalog_id"))
    cached = spark.createDataFrame([("P2", "7", "Raichu")], "set_id string, numerator string, name string")
    return sets, catalog, nums, cached


def test_ladder(spark, world):
    sets, catalog, nums, cached = world
    cells = spark.createDataFrame(
        [(1, "4", "100", None, False, True, None, None, None), (2, "9", "100", None, False, True, None, None, None),
         (3, "44", None, None, True, True, None, None, None), (4, "4", None, "SWSH", False, True, None, None, None),
         (5, "7", None, None, False, True, "P2", "b1", "200"), (6, "7", None, None, True, True, "P2", "b1", "200"),
         (7, None, None, None, False, False, None, None, None)],
        "cell_id int, numerator string, denominator string, prefix string, bare boolean, has_reading boolean, "
        "prior_set string, prior_catalog string, prior_denominator string")
    lines = spark.createDataFrame(
        [(1, 0, "PIKACHU"), (2, 0, "RAICHU"), (3, 0, "RAICHU"), (4, 0, "MEOWTH V"), (5, 0, "???"), (6, 0, "zzzz"), (7, 0, "Xyzzy")],
        "cell_id int, rank int, text string")
    got = {r.cell_id: r for r in identity.resolve_identity(cells, lines, catalog, sets, nums, cached).collect()}
    assert (got[1].rung, got[1].set_id, got[1].display_number) == ("name_number", "P1", "004/100")
    assert got[2].rung == "unresolved" and got[2].reason == "set_ambiguous"      # /100 is not Raichu's set
    assert (got[3].rung, got[3].number) == ("unique_name", "7")                   # stray bare digits dropped
    assert (got[4].rung, got[4].set_id) == ("name_number", "P3")
    assert (got[5].rung, got[5].name) == ("number_in_prior", "Raichu")
    assert got[6].rung == "unresolved" and got[6].number is None                  # bare digits never promote
    assert got[7].identity_key is None and got[7].reason == "number_ambiguous"


def test_page_prior_runs_again_only_what_the_page_may_settle(spark, world):
    sets, catalog, nums, cached = world
    none = (None, None, None)
    cells = spark.createDataFrame(
        [(1, 10, "8", "200", None, False, True, *none), (2, 10, "7", None, None, False, True, *none), (3, 10, "7", None, None, True, True, *none),
         (4, 10, "7", "100", None, False, True, *none), (5, 10, "7", None, None, False, True, *none), (6, 10, None, None, None, False, False, *none),
         (7, 10, "99", None, None, False, True, *none), (8, 20, "7", None, None, False, True, *none), (9, 10, "7", None, "SWSH", False, True, *none),
         (10, 10, "7", "200", None, False, True, *none)],
        "cell_id int, page_id int, numerator string, denominator string, prefix string, bare boolean, has_reading boolean, "
        "prior_set string, prior_catalog string, prior_denominator string")
    lines = spark.createDataFrame([(1, 0, "PIKACHU"), *((i, 0, "???") for i in (2, 3, 4, 6, 7, 8, 9)), (5, 0, "PIKACHU"), (10, 0, "zzzz")],
                                  "cell_id int, rank int, text string")
    first = identity.resolve_identity(cells.drop("page_id"), lines, catalog, sets, nums, cached)
    before = {r.cell_id: r for r in first.collect()}
    assert before[1].confident and not any(before[i].confident for i in range(2, 11))
    prior = spark.createDataFrame([(10, "P2", "200"), (30, "P1", "100")], "page_id int, set_id string, denominator string")
    got = {r.cell_id: r for r in identity.apply_page_prior(cells, first, lines, prior, catalog, sets, nums, cached).collect()}
    assert {i for i, r in got.items() if r.rescued} == {2, 10}
    for i in (2, 10):
        assert (got[i].rung, got[i].set_id, got[i].name, got[i].confident) == ("number_in_prior", "P2", "Raichu", True)
    # Confident, bare, another set's denominator, a name with another number, no reading, no such number, no page prior, a promo prefix:
    for i in (1, 3, 4, 5, 6, 7, 8, 9):
        assert tuple(got[i])[:-1] == tuple(before[i]), i
    # Nothing to settle by: nothing changes.
    again = identity.apply_page_prior(cells, first, lines, prior.limit(0), catalog, sets, nums, cached).collect()
    assert {r.cell_id: tuple(r)[:-1] for r in again} == {i: tuple(r) for i, r in before.items()} and not any(r.rescued for r in again)


def test_reconcile(spark, world):
    sets, catalog, _, cached = world
    cards = spark.createDataFrame(
        [(i, None, None, None, None, None, 0.3, True, None) for i in range(1, 6)],
        "card_id int, set_id string, set_code string, set_name string, name string, card_number string, "
        "confidence double, needs_review boolean, texts array<string>")
    answers = spark.createDataFrame(
        [(1, None, "200", None, "Pikachu", 0.9), (2, "7", "999", None, "Raichu", 0.9), (3, "7", None, "Beta", "Dodo", 0.9),
         (4, "7", None, "beta", None, 0.8), (5, None, None, None, None, 0.9)],
        "card_id int, number string, denominator string, answer_set string, answer_name string, answer_conf double")
    got = {r.card_id: r for r in identity.reconcile_answer(cards, answers, catalog, sets, cached).collect()}
    assert (got[1].outcome, got[1].set_id, got[1].card_number) == ("accepted", "P2", "008/200")
    assert (got[2].outcome, got[2].name, got[2].needs_review) == ("display_only", "Raichu", True)
    assert got[3].outcome == "rolled_back" and got[3].name is None
    assert (got[4].outcome, got[4].name, got[4].confidence) == ("accepted", "Raichu", 0.8)
    assert got[5].outcome == "no_op"


def test_reconcile_compares_names_once_a_pair(spark, world, monkeypatch):
    sets, catalog, _, cached = world
    cards = spark.createDataFrame(
        [(i, None, None, None, None, None, 0.3, True, None) for i in range(200)],
        "card_id int, set_id string, set_code string, set_name string, name string, card_number string, "
        "confidence double, needs_review boolean, texts array<string>")
    answers = spark.createDataFrame(
        [(i, "7", None, "Beta", "Dodo", 0.9) if i % 2 else (i, None, "200", None, "Pikachu", 0.9) for i in range(200)],
        "card_id int, number string, denominator string, answer_set string, answer_name string, answer_conf double")
    compared = spark.sparkContext.accumulator(0)

    def counted(a, b):
        compared.add(1)
        return 100.0 if a == b else 0.0
    monkeypatch.setattr(fuzzy, "composite_score", F.udf(counted, "double"))
    got = identity.reconcile_answer(cards, answers, catalog, sets, cached).collect()
    assert len(got) == 200 and {r.outcome for r in got if r.card_id % 2} == {"rolled_back"}
    assert {(r.outcome, r.set_id, r.card_number) for r in got if not r.card_id % 2} == {("accepted", "P2", "008/200")}
    assert 0 < compared.value <= 4          # two pairs, not 200 cards


def test_reconcile_keeps_rows_of_repeated_cards_and_blank_claims(spark, world):
    sets, catalog, _, cached = world
    cards = spark.createDataFrame(
        [(i, None, None, None, None, None, 0.3, True, t) for i, t in ((1, None), (1, None), (2, ["7/200"]), (3, ["9/200"]), (4, None), (None, None))],
        "card_id int, set_id string, set_code string, set_name string, name string, card_number string, "
        "confidence double, needs_review boolean, texts array<string>")
    answers = spark.createDataFrame(
        [(1, None, "200", None, "Pikachu", 0.9), (2, "7", None, "Beta", None, 0.9), (3, "7", None, "Beta", None, 0.9), (4, "7", "", "Beta", " ?! ", 0.9),
         (5, "7", None, "Beta", None, 0.9)],
        "card_id int, number string, denominator string, answer_set string, answer_name string, answer_conf double")
    got = sorted((r.card_id, r.outcome, r.name) for r in identity.reconcile_answer(cards, answers, catalog, sets, cached).collect())
    assert got == [(1, "accepted", "Pikachu"), (1, "accepted", "Pikachu"), (2, "accepted", "Raichu"), (3, "merged_flagged", "Raichu"),
                   (4, "rolled_back", None)]


def test_blocking_loses_no_pair(spark):
    import random
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 16))).strip() or "abc" for _ in range(150)]
    keys = spark.createDataFrame([(w,) for w in set(words[:75])], "key string")
    asked = spark.createDataFrame([(w,) for w in set(words[75:])], "q string")
    for floor in (60.0, 80.0):
        got = {tuple(r) for r in fuzzy.candidate_pairs(asked, keys, floor).collect()}
        from pyspark.sql import functions as F
        brute = asked.join(keys, F.lit(True)).filter(fuzzy.edit_score(F.col("q"), F.col("key")) >= floor - 1e-9)
        assert got == {tuple(r) for r in brute.collect()}


def frame(at, key="x:1", conf=0.5, kind="card", code=None, ok=False):
    return SimpleNamespace(at=at, identity_key=key, confidence=conf, kind=kind, code=code, format_ok=ok)


def test_live_steps():
    body = live.Session()
    assert live.step(body, frame(0.0)) == ("card", 0, 0.5)
    assert live.step(body, frame(1.5, conf=0.9)) == ("card", 0, 0.9)          # same hold-up, better read
    assert live.step(body, frame(2.5))[0] == "duplicate_prompt"              # anchor is the first capture
    assert live.step(body, frame(3.0, key=None))[:2] == ("card", 2)
    assert live.step(body, frame(3.1, key=None))[:2] == ("card", 3)          # no identity is never equal
    live.step(body, frame(4.0, kind="replace"))
    assert live.step(body, frame(5.0, key=None))[:2] == ("card", 3)          # but it may replace a marked row
    live.step(body, frame(6.0, kind="code", code="A"))
    live.step(body, frame(7.0, kind="code", code="B"))
    assert body.code == "A"
    live.step(body, frame(8.0, kind="code", code="C", ok=True))
    assert body.code == "C" and body.modal() == "x"


def test_stream_equals_batch_twin(spark):
    """Closed sessions of the stream equal the batch rollup."""
    from cardloom.queries.streams import frame_stream
    from cardloom.sources.standins import Standins
    t = Standins(spark, "/root/testdata/sf0.001")
    frames = frame_stream(t).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp"))
    streamed = live.run_to_table(live.session_rollup(frames, "12 hours", "10 minutes"), "rollup")
    batch = {tuple(r) for r in live.session_rollup(
        t.frames.withColumn("ts", t.frames.ts.cast("timestamp")), "12 hours").collect()}
    got = {tuple(r) for r in streamed.collect()}
    assert got and got <= batch


def test_save_guard_edges(spark):
    df = spark.createDataFrame(
        [("?:", None, None, None, None), ("SVI:", None, None, None, True), ("?:unknown", None, None, None, None),
         ("Sword & Shield: X:12", True, None, None, False), ("?:126", False, None, "vlm_failed", True)],
        "identity_key string, needs_review boolean, reason string, state string, confirmed boolean")
    got = {r.identity_key: r.skip_reason for r in collection.save_guard(df).collect()}
    assert got == {"?:": "degenerate_key", "SVI:": "degenerate_key", "?:unknown": "degenerate_key",
                   "Sword & Shield: X:12": "flagged_unconfirmed", "?:126": None}
