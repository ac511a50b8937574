"""Evaluation: calibration, threshold sweep, ranking accuracy, multiset scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F



def calibration_report(records: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Precision of unflagged records, share of mistakes that were flagged, and the code
    success rate, with denominators of at least one, in a single pass."""
    one = F.lit(1)
    wrong, clear = ~F.col("correct"), ~F.col("flagged")
    out = records.agg(
        F.count(one).alias("records"), F.count_if(clear).alias("unflagged"),
        F.count_if(wrong).alias("mistakes"),
        (F.count_if(clear & F.col("correct")) / F.greatest(one, F.count_if(clear))).alias("precision"),
        (F.count_if(wrong & F.col("flagged")) / F.greatest(one, F.count_if(wrong))).alias("flag_recall"))
    if codes is not None:
        rate = codes.agg((F.count_if("read_ok") / F.greatest(one, F.count(one))).alias("r"))
        out = out.withColumn("code_rate", rate.scalar())
    return out


def threshold_sweep(records: DataFrame, low: float = 0.50, high: float = 0.95, step: float = 0.01,
                    precision: float = 0.99, recall: float = 0.90) -> DataFrame:
    """Precision above, and flag recall below, each threshold; ``first_ok`` marks the
    first threshold meeting both gates.

    Records are first counted into one histogram row per step, so the sweep combines a
    handful of rows however many records there are."""
    n = round((high - low) / step)
    edges = records.sparkSession.range(n + 1).select(
        F.col("id").cast("int").alias("i"), F.round(F.lit(low) + F.col("id") * step, 2).alias("threshold"))
    slot = F.greatest(F.lit(-1), F.least(F.lit(n), F.floor((F.col("confidence") - low) / step + 1e-9))).cast("int")
    hist = records.groupBy(slot.alias("i")).agg(
        F.count_if("correct").alias("good"), F.count_if(~F.col("correct")).alias("bad"))
    base = edges.select("i", "threshold").unionByName(
        records.sparkSession.range(1).select(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("threshold")))
    h = base.join(hist, "i", "left").na.fill(0, ["good", "bad"])
    above = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)   # n + 2 rows
    below = W.orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    s = h.select("i", "threshold", F.sum("good").over(above).alias("ga"), F.sum("bad").over(above).alias("ba"),
                 F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("bb"))
    s = s.filter("i >= 0").select(
        "threshold",
        (F.col("ga") / F.greatest(F.lit(1), F.col("ga") + F.col("ba"))).alias("precision"),
        (F.col("bb") / F.greatest(F.lit(1), F.col("bb") + F.col("ba"))).alias("flag_recall"))
    ok = (F.col("precision") >= precision) & (F.col("flag_recall") >= recall)
    first = F.min(F.when(ok, F.col("threshold"))).over(W.partitionBy())
    return s.withColumn("first_ok", F.coalesce(F.col("threshold") == first, F.lit(False)))


def topk_accuracy(strips: DataFrame, photos: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary per tier, detail) of labelled test rows whose photo shows one set.

    ``strips``: strip_id, photo_id, set_id, card_key; ``photos``: photo_id, tier, split,
    labeled; ``ranked``: strip_id, rank, ref_id."""
    single = strips.filter(F.col("set_id").isNotNull()).groupBy("photo_id").agg(
        F.count_distinct("set_id").alias("n")).filter("n = 1").select("photo_id")
    test = photos.filter((F.col("split") == "test") & F.col("labeled")).join(single, "photo_id", "left_semi")
    rows = strips.filter(F.col("card_key").isNotNull()).join(test.select("photo_id", "tier"), "photo_id")
    hit = ranked.filter("rank <= 3").join(rows.select("strip_id", "card_key"), "strip_id") \
        .filter(F.col("ref_id") == F.col("card_key")).groupBy("strip_id").agg(F.min("rank").alias("hit"))
    detail = rows.join(hit, "strip_id", "left")
    summary = detail.groupBy("tier").agg(F.count_if(F.col("hit") == 1).alias("top1"),
                                         F.count_if(F.col("hit") <= 3).alias("top3"), F.count(F.lit(1)).alias("total"))
    return summary, detail


def multiset_score(cells: DataFrame, truth: DataFrame, group: str, key: Column) -> DataFrame:
    """Correct / wrong / flagged / unmatched per group; each truth entry is used once.

    ``key`` is any expression over either frame (the pluggable keyer). Both sides are
    counted per key; the overlap is the smaller count: no row numbering, no pairing."""
    flagged = F.count_if("needs_review").alias("flagged")
    pred = cells.select(group, F.coalesce(key, F.lit("")).alias("__k"), "needs_review").groupBy(group, "__k").agg(
        F.count_if(~F.col("needs_review")).alias("p"), flagged)
    want = truth.select(group, F.coalesce(key, F.lit("")).alias("__k")).groupBy(group, "__k").agg(
        F.count(F.lit(1)).alias("t"))
    j = pred.join(want, [group, "__k"], "full").na.fill(0, ["p", "t", "flagged"])
    both = F.least("p", "t")
    return j.groupBy(group).agg(F.sum(both).alias("correct"), F.sum(F.col("p") - both).alias("wrong"),
                                F.sum("flagged").alias("flagged"), F.sum(F.col("t") - both).alias("unmatched"))


def two_tier_score(cells: DataFrame, truth: DataFrame, group: str) -> DataFrame:
    """correct / numdiff / wrong / flagged / misdisplay per group.

    Frames carry group, name, number (cells also needs_review). Exact (name, number)
    hits first, then truth entries without a number, then name-only hits (numdiff);
    every truth entry is used once. All tiers are arithmetic on per-(name, number) and
    per-name counts."""
    null_num = F.lit("\u0000")
    sure = cells.filter(~F.col("needs_review")).groupBy(group, "name", F.coalesce("number", null_num).alias("number")) \
        .agg(F.count(F.lit(1)).alias("p"))
    want = truth.groupBy(group, "name", F.coalesce("number", null_num).alias("number")).agg(F.count(F.lit(1)).alias("t"))
    j = sure.join(want, [group, "name", "number"], "full").na.fill(0, ["p", "t"])
    exact = F.least("p", "t")
    unread = F.col("number") == null_num
    per = j.groupBy(group, "name").agg(
        F.sum(exact).alias("x"), F.sum("p").alias("p"), F.sum("t").alias("t"),
        F.sum(F.when(unread, F.col("t") - exact).otherwise(0)).alias("open"))
    left = F.col("p") - F.col("x")
    by_open = F.least(left, F.col("open"))
    numdiff = F.least(left - by_open, F.col("t") - F.col("x") - by_open)
    scored = per.groupBy(group).agg(
        F.sum(F.col("x") + by_open).alias("correct"), F.sum(numdiff).alias("numdiff"),
        F.sum(left - by_open - numdiff).alias("wrong"))
    flagged = cells.filter("needs_review").groupBy(group, "name").agg(F.count(F.lit(1)).alias("f"))
    names = truth.select(group, "name").distinct().withColumn("__on", F.lit(True))
    f = flagged.join(names, [group, "name"], "left").groupBy(group).agg(
        F.sum("f").alias("flagged"),
        F.sum(F.when(F.col("__on").isNull() & (F.coalesce("name", F.lit("")) != ""), F.col("f")).otherwise(0))
         .alias("misdisplay"))
    return scored.join(f, group, "full").na.fill(0)


def ratchet(measured: DataFrame, baseline: DataFrame, key: str, metric: str) -> DataFrame:
    """Counts against pinned counts (no pin = 0): above fails, below improves."""
    j = measured.join(baseline.select(key, F.col(metric).alias("pin")), key, "left") \
        .withColumn("pin", F.coalesce("pin", F.lit(0).cast("bigint")))
    return j.withColumn("verdict", F.when(F.col(metric) > F.col("pin"), "fail")
                        .when(F.col(metric) < F.col("pin"), "improved").otherwise("pass"))
