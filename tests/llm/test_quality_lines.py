import pytest

from cardloom.llm import lines, quality
from tests.llm import brute

STRIPS = "strip_id long, text string, source string"
LONG = " ".join(f"w{i}" for i in range(60))


def test_measures_equal_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b c a b c", "x\nx\n\nx \n y", "# | <b> &*$%", LONG, "a a a a a", "ä ö ü ß\x0bz",
             "b " * 20000, "\U0001f600 \U0001f600 \U0001f600", "\n".join(["same line here"] * 9)]
    df = spark.createDataFrame([(i, t, "upload") for i, t in enumerate(texts)], STRIPS)
    got = {r["strip_id"]: tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
           for r in quality.text_measures(df).collect()}
    assert got == {i: brute.measures(t) for i, t in enumerate(texts)}


def test_host_verdicts_shrink_and_join_back(spark):
    rows = [(i, LONG, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(40)]
    rows += [(200 + i, LONG, "bad") for i in range(5)] + [(300, "short", "tiny"), (301, LONG, "tiny"), (302, LONG, None), (302, LONG, None)]
    got = quality.judge(spark.createDataFrame(rows, STRIPS)).collect()
    assert len(got) == len(rows)
    by = {(r["strip_id"], r["source"]): r for r in got}
    assert by[0, "good"]["kept"] and not by[0, "good"]["host_failed"]
    assert by[200, "bad"]["host_failed"] and not by[200, "bad"]["base_failed"] and not by[200, "bad"]["kept"]
    assert by[301, "tiny"]["kept"] and by[302, None]["kept"] and by[302, None]["n_texts"] == 2
    # Shrunk towards the mean of the hosts.
    assert 40 / 45 > by[200, "bad"]["base_rate"] > 0.5 and 0 < by[0, "good"]["base_rate"] < 0.5


def test_quality_extra_columns_empty_table(spark):
    df = spark.createDataFrame([(1, LONG, "a", 9, "x")], STRIPS + ", n_words int, Kept string")
    row = quality.judge(df).collect()[0]
    assert row["n_words"] == 60 and row["kept"] is True
    assert quality.judge(spark.createDataFrame([], STRIPS)).collect() == []


def test_prior_without_spread(spark):
    df = spark.createDataFrame([(1, LONG, "a"), (2, LONG, "b")], STRIPS)
    assert all(r["base_rate"] == 0 and r["kept"] for r in quality.judge(df).collect())


def _logs(n=12):
    rows = []
    for i in range(n):
        own = [f"text {chr(97 + i)}{chr(97 + j)} is only mine and no other has it ever" for j in range(5)]
        own.insert(i % 5, f"scan of strip {i} took {i * 7} ms on worker a")
        rows.append((i, "\n".join(own), "upload"))
    return rows


def test_templates_with_variable_fields_are_dropped(spark):
    got = {r["strip_id"]: r for r in lines.drop_templates(spark.createDataFrame(_logs(), STRIPS)).collect()}
    assert all("took" not in r["text"] and r["n_dropped"] == 1 and r["n_lines"] == 6 for r in got.values())
    assert all(r["text"].count("\n") == 4 and r["words_dropped"] == 10 for r in got.values())


def test_rare_lines_and_copies_stay(spark):
    few = _logs(lines.MIN_TEXTS - 1)
    assert all(r["n_dropped"] == 0 for r in lines.drop_templates(spark.createDataFrame(few, STRIPS)).collect())
    copy = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(i, copy, "upload") for i in range(30)]
    assert all(r["text"] == copy and r["n_dropped"] == 0 for r in lines.drop_templates(spark.createDataFrame(rows, STRIPS)).collect())


def test_lines_of_one_shape_in_one_text_stay(spark):
    fruit = "apples pears plums figs dates limes kiwis melons grapes cherries".split()
    listed = "\n".join(f"the price of {x} is low" for x in fruit)
    rows = [(1, listed + "\n" + LONG + " " + LONG, "x"), (2, "the price of nuts is low\n" + LONG.replace("w", "v"), "x"), (None, listed, "x")]
    df = spark.createDataFrame(rows, STRIPS)
    assert lines.recurring_lines(df).collect() == []
    assert all(r["n_dropped"] == 0 and r["text"] == t for r in lines.drop_templates(df).collect() for i, t, _ in rows if i == r["strip_id"])
    # Counts are of texts where a template does recur.
    more = [(10 + k, f"the price of {x} is low\nthe price of {x}s is low", "x") for k, x in enumerate(fruit)]
    assert {r["n_texts"] for r in lines.recurring_lines(spark.createDataFrame(more, STRIPS)).collect()} == {10}


def test_word_in_place_of_a_constant_is_a_variable_field(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(i, f"{x} own words here for {x} alone\nthe reader of pack {x} has closed its session\nmore of {x} to tell today", "h")
            for i, x in enumerate(names)]
    found = lines.recurring_lines(spark.createDataFrame(rows, STRIPS)).collect()
    assert {r["template"] for r in found} == {"the reader of pack <*> has closed its session"}
    assert {r["n_texts"] for r in found} == {12}


def test_lines_edge_rows(spark):
    rows = _logs() + [(None, None, None), (None, "", "x"), (3, _logs()[3][1], "upload"), (50, "scan of strip 5 took 9 ms on worker a\n" + LONG + " " * 9, "x"),
                      (51, " ".join(["z"] * 30000), "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], STRIPS + ", N_DROPPED int")
    got = lines.drop_templates(df).collect()
    assert len(got) == len(rows)
    none = [r for r in got if r["strip_id"] is None]
    assert sorted((r["text"] is None, r["n_lines"]) for r in none) == [(False, 1), (True, 0)]
    assert [r["text"] for r in got if r["strip_id"] == 50] == [LONG + " " * 9]
    assert len([r for r in got if r["strip_id"] == 3 and r["n_dropped"] == 1]) == 2
    assert lines.drop_templates(spark.createDataFrame([], STRIPS)).collect() == []


@pytest.mark.parametrize("fn", [quality.judge, lines.drop_templates])
def test_native_plans_have_no_python(spark, fn):
    plan = fn(spark.createDataFrame(_logs(3), STRIPS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
