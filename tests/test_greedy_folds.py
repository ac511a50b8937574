"""Greedy choices: one fold per photo, rounds for very large ones; the same rows as one pass in order."""

import random

import pytest

from cardloom.operators import layout

BOXES = "page_id int, line_id int, x double, y double, w double, h double"


def _iou(a, b):
    iw = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    ih = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    return iw * ih / (a[4] * a[5] + b[4] * b[5] - iw * ih)


def _kept(boxes):
    out = set()
    for page in {b[0] for b in boxes}:
        kept = []
        for b in sorted((b for b in boxes if b[0] == page), key=lambda b: (-b[4] * b[5], b[1])):
            if all(_iou(b, k) <= 0.4 for k in kept):
                kept.append(b)
        out |= {(page, b[1]) for b in kept}
    return out


def test_a_long_chain_of_boxes_takes_few_jobs(spark):
    """Each box overlaps the next one only, and each is a little smaller: the choice of one hangs on all before it."""
    chain = [(1, i, 10.0 * i, 0.0, 30.0, 20.0 - i * 0.001) for i in range(2000)] + [(2, 5000, 0.0, 0.0, 5.0, 5.0)]
    spark.sparkContext.setJobGroup("chain", "nms")
    try:
        got = {(r.page_id, r.line_id) for r in layout.nms(spark.createDataFrame(chain, BOXES), 0.4).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setJobGroup("rest", "tests")
    assert got == _kept(chain) and jobs < 60


@pytest.mark.parametrize("limit", [0, 40, layout.FOLD_ROWS])
def test_folds_and_rounds_choose_alike(spark, monkeypatch, limit):
    rng = random.Random(limit)
    boxes = [(i % 5, i, float(rng.randrange(200)), float(rng.randrange(200)), float(rng.randrange(20, 90)), float(rng.randrange(20, 90)))
             for i in range(40 * 5) if i % 5 < 4 or i < 50]
    real = layout.greedy_rounds
    monkeypatch.setattr(layout, "greedy_rounds", lambda *a: real(*a, limit=limit))
    assert {(r.page_id, r.line_id) for r in layout.nms(spark.createDataFrame(boxes, BOXES), 0.4).collect()} == _kept(boxes)


@pytest.mark.parametrize("limit", [0, 30, layout.FOLD_ROWS])
def test_unique_picks(spark, limit):
    rng = random.Random(7)
    items = [(p, i, rng.choice([None, 1, 2, 3, 4, 5]), rng.choice("abcdef"), rng.random()) for p, n in ((1, 20), (2, 60), (None, 5)) for i in range(n)]
    want, used = set(), set()
    for p, i, row, word, _ in sorted((x for x in items if None not in x), key=lambda x: (-x[4], x[1])):
        if (p, "r", row) not in used and (p, "w", word) not in used:
            used |= {(p, "r", row), (p, "w", word)}
            want.add((p, i))
    from pyspark.sql import functions as F
    df = spark.createDataFrame(items, "page_id int, line_id int, row_key int, word string, conf double")
    got = layout.greedy_unique(df, [(-F.col("conf")).alias("c"), F.col("line_id").alias("i")], [["page_id", "row_key"], ["page_id", "word"]],
                               ["page_id", "line_id"], limit).collect()
    assert {(r.page_id, r.line_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [0, layout.FOLD_ROWS])
def test_claims_of_boxes(spark, limit):
    rng = random.Random(3)
    strips = [(p, i, i * 12.0, 15.0, str(i) if i % 5 == 0 else None) for p in (1, 2, 3) for i in range(25)]
    boxes = [(p, float(rng.randrange(300)), str(rng.randrange(30)), j) for p in (1, 2) for j in range(40)]
    want = set()
    for page in (1, 2):
        have, used = {s[4] for s in strips if s[0] == page and s[4]}, set()
        for s in sorted(s for s in strips if s[0] == page and s[4] is None):
            near = sorted((abs(b[1] - s[2]), b[1], b[3], b[2]) for b in boxes if b[0] == page and b[3] not in used and b[2] not in have and abs(b[1] - s[2]) <= 22.5)
            if near:
                used.add(near[0][2])
                have.add(near[0][3])
                want.add((page, s[1], near[0][2], near[0][3]))
    got = layout.fill_from_detections(spark.createDataFrame(strips, "page_id int, row_index int, cy double, h double, numerator string"),
                                      spark.createDataFrame(boxes, "page_id int, y double, numerator string, box_id int"), limit=limit).collect()
    assert {(r.page_id, r.row_index, r.box_id, r.numerator) for r in got} == want


def test_no_boxes_at_all(spark):
    assert layout.nms(spark.createDataFrame([], BOXES)).collect() == []
