"""The two-level scans equal a plain scan."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from cardloom.operators import layout
from cardloom.plans import session, skew


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [("hot" if i % 3 else f"k{i % 7}", i, float(rng.randrange(0, 400))) for i in range(240)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, y double").repartition(5)


def by_key(rows):
    out = {}
    for k, i, y in rows:
        out.setdefault(k, []).append((y, i))
    return {k: sorted(v) for k, v in out.items()}


def B():
    return [F.floor(F.col("y") / 25)]


def test_ordinal(spark, rows):
    got = {(r.k, r.i): r.n for r in skew.ordinal(frame(spark, rows), ["k"], ["y", "i"], B(), "n").collect()}
    assert got == {(k, i): n for k, v in by_key(rows).items() for n, (_, i) in enumerate(v, 1)}


def test_previous_and_running(spark, rows):
    df = skew.previous_value(frame(spark, rows), ["k"], ["y", "i"], B(), F.col("i"), "p")
    df = skew.running_sum(df, ["k"], ["y", "i"], B(), F.col("i"), "s")
    got = {(r.k, r.i): (r.p, r.s) for r in df.collect()}
    want = {}
    for k, v in by_key(rows).items():
        prev, total = None, 0
        for _, i in v:
            total += i
            want[k, i] = (prev, total)
            prev = i
    assert got == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_islands(spark, rows, inclusive):
    got = {(r.k, r.i): r.island for r in skew.islands(
        frame(spark, rows), ["k"], "y", 9.0, 25.0, inclusive=inclusive).collect()}
    want = {}
    for k, v in by_key(rows).items():
        prev, n = None, 0
        for y, i in v:
            if prev is not None and (y - prev >= 9 if inclusive else y - prev > 9):
                n += 1
            want[k, i], prev = n, y
    assert got == want


def test_nearest_anchors(spark, rows):
    anchors = [(k, y + 0.5) for k, i, y in rows if i % 5 == 0]
    a = spark.createDataFrame(anchors, "k string, a double")
    got = {(r.k, r.i): (r.before and r.before["at"], r.after and r.after["at"]) for r in skew.nearest_anchors(
        frame(spark, rows), a, ["k"], "y", "a", width=25.0).collect()}
    for k, i, y in rows:
        mine = [x for kk, x in anchors if kk == k]
        below, above = [x for x in mine if x <= y], [x for x in mine if x >= y]
        assert got[k, i] == (max(below, default=None), min(above, default=None))


def test_global_ordinal(spark, rows):
    got = [r.ordinal for r in skew.global_ordinal(frame(spark, rows), ["y"], ["i"]).orderBy("y", "i").collect()]
    assert got == list(range(len(rows)))


def test_mode_ties(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 3), (1, "b", 2), (2, None, 0), (3, "z", 5), (3, "y", 5)],
                               "g int, v string, p int")
    got = {r.g: (r.v, r.votes) for r in skew.mode_per(df, ["g"], "v", "p").collect()}
    assert got == {1: ("b", 2), 3: ("y", 1)}


def test_partitioning_does_not_change_results(spark, rows):
    out = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1] if parts == 7 else rows, "k string, i long, y double").repartition(parts)
        out.append(sorted(map(tuple, skew.islands(df, ["k"], "y", 9.0, 25.0).collect())))
    assert out[0] == out[1]


def test_top_k_is_limited_below_the_shuffle(spark, rows):
    plan = skew.top_k(frame(spark, rows), ["k"], ["y", "i"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def iou(a, b):
    iw = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    ih = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return iw * ih / (a[2] * a[3] + b[2] * b[3] - iw * ih)


def random_boxes(n, seed=3):
    rng = random.Random(seed)
    return [(i % 2, i, float(rng.randrange(300)), float(rng.randrange(300)), float(rng.randrange(20, 120)),
             float(rng.randrange(20, 90))) for i in range(n)]


def test_nms_equals_greedy_loop(spark):
    boxes = random_boxes(120)
    boxes += [(0, 900 + i, *boxes[0][2:]) for i in range(5)]
    df = spark.createDataFrame(boxes, "page_id int, line_id int, x double, y double, w double, h double")
    got = {(r.page_id, r.line_id) for r in layout.nms(df, 0.4).collect()}
    want = set()
    for page in (0, 1):
        kept = []
        for b in sorted((b for b in boxes if b[0] == page), key=lambda b: (-b[4] * b[5], b[1])):
            if all(iou(b[2:], k[2:]) <= 0.4 for k in kept):
                kept.append(b)
        want |= {(page, b[1]) for b in kept}
    assert got == want


def test_fill_from_detections_equals_greedy_loop(spark):
    rng = random.Random(9)
    strips = [(p, i, i * 20.0, 15.0, str(i) if i % 3 == 0 else None) for p in (1, 2) for i in range(12)]
    boxes = [(p, float(rng.randrange(240)), str(rng.randrange(20)), j) for p in (1, 2) for j in range(15)]
    got = {(r.page_id, r.row_index, r.box_id) for r in layout.fill_from_detections(
        spark.createDataFrame(strips, "page_id int, row_index int, cy double, h double, numerator string"),
        spark.createDataFrame(boxes, "page_id int, y double, numerator string, box_id int")).collect()}
    want = set()
    for page in (1, 2):
        have = {s[4] for s in strips if s[0] == page and s[4]}
        used = set()
        for s in sorted(s for s in strips if s[0] == page and s[4] is None):
            free = [(abs(b[1] - s[2]), b[1], b[3], b[2]) for b in boxes if b[0] == page and b[3] not in used and b[2] not in have]
            near = [f for f in sorted(free) if f[0] <= 1.5 * s[3]]
            if near:
                used.add(near[0][2])
                have.add(near[0][3])
                want.add((page, s[1], near[0][2]))
    assert got == want


def test_ordinal_shuffles_rows_once_and_numbers_null_keys(spark):
    rows = [(k, b, i) for i, (k, b) in enumerate((k, b) for k in (None, 1, 2) for b in (None, 0.0, 3.0, 3.0, 7.0) for _ in range(3))]
    df = spark.createDataFrame(rows, "k int, b double, i int").repartition(4)
    for keys in (["k"], ["s"]):
        named = df.withColumn("s", F.struct("k"))
        got = skew.ordinal(named, keys, ["b", "i"], [F.col("b")], "n")
        assert got.columns == ["k", "b", "i", "s", "n"]
        expected = named.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("b", "i")))
        assert {(r.i, r.n) for r in got.collect()} == {(r.i, r.n) for r in expected.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2              # the rows, and the offsets unless they are broadcast


def test_stage_leaves_no_shuffle_files(spark):
    import time
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(conf, None)
    got = session.stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "cleaned")
    until = time.time() + 20
    while (left := {f for f in files() - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)
    assert not left and got.count() == 100 and spark.conf.get(conf, None) == setting
