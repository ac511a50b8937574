"""Layout analytics over detection tables (page_id, line_id, x, y, text, conf, w, h)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.plans.session import stage
from cardloom.plans.skew import islands, nearest_anchors, ordinal, percentiles, previous_value, top_k

MIN_ROWS, MAX_ROWS = 5, 13
INF = float("inf")


def guide_scale(df: DataFrame, meta: str, image_height: Column) -> DataFrame:
    """Adds guides, median_gap, declared from untrusted capture metadata: 2 to 20 numeric
    guides scaled to the image height and sorted; all NULL when a guide is not a number,
    the count is off, or the median gap is below one pixel."""
    m = F.from_json(meta, "struct<guide_positions: array<string>, image_dims: array<string>, "
                          "declared_count: string>")
    df = df.withColumn("__m", m)
    df = df.withColumns({
        "__raw": F.transform("__m.guide_positions", lambda g: g.try_cast("double")),
        "__scale": image_height / F.coalesce(
            F.nullif(F.get("__m.image_dims", F.lit(1)).try_cast("double"), F.lit(0.0)), image_height)})
    df = df.withColumn("__g", F.array_sort(F.transform("__raw", lambda g: g * F.col("__scale"))))
    n = F.size("__raw")
    rest = F.greatest(n - 1, F.lit(0))
    df = df.withColumn("__d", F.array_sort(F.zip_with(
        F.slice("__g", 2, rest), F.slice("__g", 1, rest), lambda a, b: a - b)))
    k = F.size("__d")
    df = df.withColumn("__mid", (F.get("__d", F.floor((k - 1) / 2).cast("int"))
                                 + F.get("__d", F.floor(k / 2).cast("int"))) / 2)
    ok = n.between(2, 20) & ~F.exists("__raw", lambda x: x.isNull()) & (F.col("__mid") >= 1)
    declared = F.coalesce(F.nullif(F.col("__m.declared_count").try_cast("int"), F.lit(0)), n)
    return df.withColumns({"guides": F.when(ok, F.col("__g")), "median_gap": F.when(ok, F.col("__mid")),
                           "declared": F.when(ok, declared)}) \
             .drop("__m", "__raw", "__scale", "__g", "__d", "__mid")


def page_median(df: DataFrame, keys: list[str], value: Column, name: str, width: float = 64.0) -> DataFrame:
    """Exact median per page by value counts and rank, joined back."""
    return df.join(percentiles(df, keys, value, {name: 0.5}, width), keys)


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines that read as a real card number, with the reading in ``r``."""
    return lines.withColumn("r", N.parse_number(F.col("text"), F.col("conf"))).filter("r.pattern_ok")


# -- clusters and order ---------------------------------------------------------

def gap_split(lines: DataFrame, keys: list[str], coord: str, gap: Column | float,
              inclusive: bool = False, width: float = 64.0) -> DataFrame:
    """Columns (by x), rows or segments (by y): adds the ``island`` number."""
    return islands(lines, keys, coord, gap, width, inclusive=inclusive)


def cluster_medians(clustered: DataFrame, keys: list[str], coord: str) -> DataFrame:
    return percentiles(clustered, [*keys, "island"], F.col(coord), {"center": 0.5}, 64.0, [F.sum("n").alias("members")])


def reading_order(boxes: DataFrame, key: str = "page_id", tie: str = "line_id",
                  tile: float = 64.0) -> DataFrame:
    """Row bands at half the median height, then left to right: ``band``, ``position``
    (from 0 per page), ``grid_rows``, ``grid_cols``. ``y`` is the box top."""
    b = page_median(boxes, [key], F.col("h"), "__mh").withColumns({
        "__yc": F.col("y") + F.col("h") / 2, "__xc": F.col("x") + F.col("w") / 2})
    banded = stage(islands(b, [key], "__yc", F.col("__mh") * 0.5, tile, name="band"), "bands")
    placed = ordinal(banded, [key], ["band", "__xc", tie],
                     [F.col("band"), F.floor(F.col("__xc") / tile)], "position", start=0)
    grid = (banded.groupBy(key, "band").agg(F.count(F.lit(1)).alias("__n"))
            .groupBy(key).agg((F.max("band") + 1).alias("grid_rows"), F.max("__n").alias("grid_cols")))
    return placed.join(grid, key).drop("__mh", "__yc", "__xc")


def rebuild_titles(lines: DataFrame, key: str = "page_id", tie: str = "line_id",
                   tile: float = 64.0) -> DataFrame:
    """Title rows of a name band: noise dropped, rows at half the median height joined
    left to right, evolution notes dropped, topmost first (``rank`` from 0)."""
    kept = lines.filter(~S.is_noise_name(F.col("text")))
    rows = islands(page_median(kept, [key], F.col("h"), "__mh"), [key], "y",
                   F.col("__mh") * 0.5, tile, name="band")
    joined = rows.groupBy(key, "band").agg(
        F.min("y").alias("top"), F.max("conf").alias("conf"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", tie, "text"))),
                                 lambda s: s["text"]), " ").alias("title"))
    titles = stage(joined.filter(~F.contains("title", F.lit("VOLVES"))), "titles")
    return ordinal(titles, [key], ["top", F.desc("conf"), "band"], [F.floor(F.col("top") / tile)],
                   "rank", start=0)


def keep_best_per_number(lines: DataFrame, key: str = "page_id", tie: str = "line_id",
                         least: int = 3) -> DataFrame:
    """Best detection of each numerator; pages with fewer than ``least`` are rejected."""
    parsed = number_lines(lines).withColumn("numerator", F.col("r.numerator"))
    best = top_k(parsed, [key, "numerator"], [F.desc("conf"), "y", tie], 1)
    enough = best.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least)
    return best.join(enough, key).drop("r")


#: What a reading holds; all of it goes when the reading is blanked.
READING = ("numerator", "denominator", "prefix", "tokens")


def blank_duplicate_numbers(readings: DataFrame, group: str = "pull_id",
                            row: str = "row_index") -> DataFrame:
    """A numerator read twice in a pack stays on its most confident row only; the other
    readings become blank as a whole: no number, no tokens, ``pattern_ok`` false, confidence
    0, ``blank`` true (which ``score_cards`` reports as an unreadable strip)."""
    read = readings.filter(F.col("pattern_ok") & F.col("numerator").isNotNull())
    keep = top_k(read, [group, "numerator"], [F.desc("confidence"), row], 1).select(
        group, row, F.lit(True).alias("__keep"))
    out = readings.join(keep, [group, row], "left")
    drop = F.coalesce(F.col("pattern_ok") & F.col("numerator").isNotNull() & F.col("__keep").isNull(), F.lit(False))
    cleared = {c: F.when(~F.col("blank"), F.col(c)) for c in READING if c in readings.columns}
    out = out.withColumn("blank", drop).withColumns(cleared).withColumns({
        "pattern_ok": F.col("pattern_ok") & ~F.col("blank"),
        "confidence": F.when(F.col("blank"), F.lit(0.0)).otherwise(F.col("confidence"))})
    return out.drop("__keep")


def median_outlier_filter(boxes: DataFrame, key: str = "page_id", times: float = 3.0) -> DataFrame:
    area = F.col("w") * F.col("h")
    return (page_median(boxes, [key], area, "__m")
            .filter(area.between(F.col("__m") / times, F.col("__m") * times)).drop("__m"))


def row_gaps(lines: DataFrame, key: str = "page_id", coord: str = "y", tile: float = 64.0) -> DataFrame:
    """Distinct coordinates with the distance to the one before (``gap``)."""
    points = lines.select(key, coord).distinct()
    prev = previous_value(points, [key], [coord], [F.floor(F.col(coord) / tile)], F.col(coord), "__prev")
    return prev.withColumn("gap", F.col(coord) - F.col("__prev")).drop("__prev")


def prune_close_rows(rows: DataFrame, key: str = "page_id", coord: str = "y",
                     fraction: float = 0.5, tile: float = 64.0) -> DataFrame:
    """Keep a row only if it lies at least ``fraction`` of the median gap below the last
    kept row.

    A gap of that size always restarts the chain, so the scan runs per island of
    closer rows, over its distinct coordinates."""
    gaps = stage(row_gaps(rows, key, coord, tile), "gaps")
    limit = percentiles(gaps, [key], F.col("gap"), {"__t": 0.5}, tile).withColumn("__t", F.col("__t") * fraction)
    chained = islands(gaps.join(limit, key, "left").withColumn("__t", F.coalesce("__t", F.lit(INF))),
                      [key], coord, F.col("__t"), tile, inclusive=True)
    per = chained.groupBy(key, "island").agg(F.first("__t").alias("__t"),
                                             F.array_sort(F.collect_list(coord)).alias("__ys"))
    kept = F.aggregate("__ys", F.array().cast("array<double>"),
                       lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) >= F.col("__t")),
                                             F.concat(acc, F.array(y))).otherwise(acc))
    return per.select(key, F.explode(kept).alias(coord))


def line_crop_plan(lines: DataFrame, image_height: float, key: str = "page_id") -> DataFrame:
    """Crop band around each detected number row (rows thinner than 8 px dropped)."""
    gaps = row_gaps(lines, key)
    med = (gaps.select(key).distinct().join(percentiles(gaps, [key], F.col("gap"), {"median_gap": 0.5}, 64.0), key, "left")
           .withColumn("median_gap", F.coalesce("median_gap", F.lit(0.08 * image_height))))
    band = F.greatest(F.lit(30), (F.col("median_gap") * 0.95).cast("int"))
    top = F.greatest(F.lit(0), (F.col("y") - band * 0.55).cast("int"))
    bottom = F.least(F.lit(int(image_height)), (F.col("y") + band * 0.45).cast("int"))
    return (lines.join(med, key).withColumns({"top": top, "bottom": bottom})
            .filter(F.col("bottom") - F.col("top") >= 8))


def grid_pitch(cells: DataFrame, key: str = "page_id", tile: float = 64.0) -> DataFrame:
    """Per page: median distance between column centres, and between the cell centres
    of a column. ``cells``: key, island (column), cell, x, y."""
    cols = percentiles(cells, [key, "island"], F.col("x"), {"center": 0.5}, tile)
    cols = stage(cols, "columns")
    col_gap = row_gaps(cols, key, "center", tile)
    rows = (cells.groupBy(key, "island", "cell").agg(F.avg("y").alias("center")))
    row_prev = previous_value(rows, [key, "island"], ["center", "cell"],
                              [F.floor(F.col("center") / tile)], F.col("center"), "__p")
    return (cells.select(key).distinct()
            .join(percentiles(col_gap, [key], F.col("gap"), {"col_pitch": 0.5}, tile), key, "left")
            .join(percentiles(row_prev, [key], F.col("center") - F.col("__p"), {"row_pitch": 0.5}, tile), key, "left"))


def coarse_boxes(cells: DataFrame, pitch: DataFrame, width: int, height: int, key: str = "page_id",
                 fraction: float = 0.92, aspect: float = 1.4) -> DataFrame:
    """Cell box around the text centroid at ``fraction`` of the grid pitch, or 1.6 times
    the text width when a pitch is missing; clamped to the image."""
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    b = cells.groupBy(key, "island", "cell").agg(
        F.min(F.col("x") - half_w).alias("l"), F.max(F.col("x") + half_w).alias("r"),
        F.min(F.col("y") - half_h).alias("t"), F.max(F.col("y") + half_h).alias("b"))
    both = F.col("col_pitch").isNotNull() & F.col("row_pitch").isNotNull() \
        & (F.col("col_pitch") != 0) & (F.col("row_pitch") != 0)
    cw = F.when(both, F.col("col_pitch") * fraction).otherwise((F.col("r") - F.col("l")) * 1.6)
    ch = F.when(both, F.col("row_pitch") * fraction).otherwise(cw * aspect)
    cx, cy = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2

    def clamp(c, top):
        return F.least(F.lit(top), F.greatest(F.lit(0), F.bround(c, 0).cast("int")))

    out = b.join(pitch, key).withColumns({"x0": clamp(cx - cw / 2, width), "y0": clamp(cy - ch / 2, height),
                                          "x1": clamp(cx + cw / 2, width), "y1": clamp(cy + ch / 2, height)})
    return out.select(key, "island", "cell", "x0", "y0",
                      F.greatest(F.lit(1), F.col("x1") - F.col("x0")).alias("box_w"),
                      F.greatest(F.lit(1), F.col("y1") - F.col("y0")).alias("box_h"))


def gap_cv(rows: DataFrame, keys: list[str], coord: str = "y", tile: float = 64.0) -> DataFrame:
    """Coefficient of variation of row gaps; fewer than three rows score infinity."""
    prev = previous_value(rows, keys, [coord], [F.floor(F.col(coord) / tile)], F.col(coord), "__p")
    gap = F.col(coord) - F.col("__p")
    g = prev.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(gap).alias("__m"),
                                F.stddev_pop(gap).alias("__s"))
    return g.select(*keys, "rows", F.when((F.col("rows") >= 3) & (F.col("__m") > 0),
                                          F.col("__s") / F.col("__m")).otherwise(F.lit(INF)).alias("gap_cv"))


def best_trial(trials: DataFrame, key: str, trial: str, least: int = MIN_ROWS, most: int = MAX_ROWS) -> DataFrame:
    """Most uniform trial with a plausible row count, else the one with most rows
    (strictest, i.e. smallest ``trial``, on ties)."""
    inside = F.col("rows").between(least, most)
    order = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("gap_cv")).otherwise(-F.col("rows")),
                     F.col(trial))
    return trials.groupBy(key).agg(F.min_by(F.struct(trial, "rows", "gap_cv"), order).alias("b")).select(key, "b.*")


def row_count_warning(detected: Column, declared: Column, least: int = MIN_ROWS, most: int = MAX_ROWS) -> Column:
    guided = F.when(declared != detected, F.format_string("detected %d rows, declared %d", detected, declared))
    free = F.when(detected == 0, F.lit("no rows detected")).when(
        ~detected.between(least, most), F.format_string(f"detected %d rows (expected {least}-{most})", detected))
    return F.when(declared.isNotNull(), guided).otherwise(free)


def join_line_text(tokens: DataFrame, strip: list[str], order: str) -> DataFrame:
    """Upper-cased tokens of a strip in reading order and their mean confidence."""
    return tokens.groupBy(*strip).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.upper("text").alias("t")))),
                                 lambda s: s["t"]), " ").alias("text"),
        F.avg("conf").alias("conf"))


def bare_numerators(lines: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Last-resort number of a strip: the most confident lone 2-3 digit token above
    zero, only where no line of the strip is a real number."""
    tok = F.trim("text")
    bare = tok.rlike(N.BARE_NUMBER_PATTERN) & (tok.try_cast("int") >= 1)
    return (lines.groupBy(*keys).agg(
        F.bool_or(N.parse_number(F.col("text"), F.col("conf"))["pattern_ok"]).alias("__real"),
        F.max(F.when(bare, F.struct(F.col("conf").alias("c"), (-F.col(tie)).alias("i"), tok.alias("numerator"))))
         .alias("__b"))
        .filter(~F.col("__real") & F.col("__b").isNotNull())
        .select(*keys, "__b.numerator", F.round("__b.c", 3).alias("confidence")))


# -- code tokens ------------------------------------------------------------------

def assemble_code(tokens: Column, longest: int = 4) -> Column:
    """STRUCT(code, conf): best full-format token, else the best join of 2 to
    ``longest`` neighbouring fragments (mean confidence; earliest on ties).
    ``tokens``: array<struct<text, conf>> with confidence in percent."""
    whole = F.transform(
        F.filter(tokens, lambda t: t["text"].rlike(N.CODE_PATTERN)),
        lambda t, i: F.struct(t["conf"].cast("double").alias("conf"), (-i).alias("rank"), t["text"].alias("code")))
    frags = F.filter(tokens, lambda t: t["text"].rlike(r"^[A-Z0-9-]{2,}$"))
    joins = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(frags), F.lit(1))),
        lambda i: F.transform(
            F.sequence(F.lit(2), F.lit(longest)),
            lambda k: F.struct(
                (F.aggregate(F.slice(frags, i, k), F.lit(0.0), lambda a, t: a + t["conf"]) / k).alias("conf"),
                (-(i * longest + k)).cast("int").alias("rank"),
                F.when(i + k - 1 <= F.size(frags),
                       F.array_join(F.transform(F.slice(frags, i, k), lambda t: t["text"]), "")).alias("code")))))
    ok = F.filter(joins, lambda j: F.coalesce(j["code"].rlike(N.CODE_PATTERN), F.lit(False)))
    pick = F.coalesce(F.array_max(whole), F.array_max(ok))
    return F.when(pick.isNotNull(), F.struct(pick["code"].alias("code"), (pick["conf"] / 100).alias("conf")))


def recover_split_code(tokens: Column) -> Column:
    """STRUCT(code, conf) joined from 2 to 5 segment tokens of 9 to 30 characters in
    all; never counted as well formed."""
    segs = F.filter(tokens, lambda t: t["text"].rlike(N.CODE_SEGMENT_PATTERN))
    joined = F.array_join(F.transform(segs, lambda t: t["text"]), "")
    mean = F.aggregate(segs, F.lit(0.0), lambda a, t: a + t["conf"]) / F.size(segs)
    ok = F.size(segs).between(2, 5) & F.length(joined).between(9, 30) & joined.rlike(N.CODE_TOKEN_PATTERN)
    return F.when(ok, F.struct(joined.alias("code"), (mean / 100).alias("conf")))


# -- spatial joins ----------------------------------------------------------------

def assign_to_anchor(lines: DataFrame, anchors: DataFrame, tol: float, key: str = "page_id",
                     tile: float = 64.0) -> DataFrame:
    """Each line goes to the first anchor at or below ``y - tol`` on the page, else to
    the page's last anchor (``anchor_y``); pages without anchors are left out."""
    last = anchors.groupBy(key).agg(F.max("y").alias("__last"))
    near = nearest_anchors(lines, anchors, [key], "y", "y", shift=F.lit(-tol), width=tile)
    return (near.join(last, key)
            .withColumn("anchor_y", F.coalesce("after.at", "__last")).drop("before", "after", "__last"))


def snap_nearest(points: DataFrame, anchors: DataFrame, key: str, coord: str, anchor: str,
                 tol: Column, label: str | None = None, tile: float = 64.0) -> DataFrame:
    """Nearest anchor within ``tol`` (lower one on a tie): ``snapped`` STRUCT(at, label),
    NULL when none is close enough. Rows are never dropped."""
    near = nearest_anchors(points, anchors, [key], coord, anchor, label, width=tile)
    below, above = F.col(coord) - F.col("before.at"), F.col("after.at") - F.col(coord)
    pick = F.when(above.isNull() | (below <= above), F.col("before")).otherwise(F.col("after"))
    gap = F.least(below, above)
    return near.withColumn("snapped", F.when(gap <= tol, pick)).drop("before", "after")


def snap_to_guides(guides: DataFrame, edges: DataFrame, tol: Column, key: str = "page_id") -> DataFrame:
    """Guide rows moved to the nearest detected edge within ``tol``."""
    out = snap_nearest(guides, edges, key, "guide_y", "edge_y", tol)
    return out.withColumns({"row_y": F.coalesce("snapped.at", "guide_y"),
                            "moved": F.col("snapped").isNotNull()}).drop("snapped")


def rejoin_split_number(lines: DataFrame, key: str = "page_id", tie: str = "line_id",
                        times: float = 1.5) -> DataFrame:
    """Promo prefix line plus the vertically nearest 2-3 digit line to its right, within
    ``times`` the taller box; confidence is the lower one.

    Equi join on (page, band of the page's largest tolerance) with the neighbour bands;
    copies of a digit line are folded to their rightmost one."""
    flat = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    shape = r"^(SWSH|SVP|MEP)([A-Z]{0,2})(\d{1,3})?$"
    base = lines.withColumn("__t", flat)
    digits = (base.filter(F.col("__t").rlike(N.BARE_NUMBER_PATTERN))
              .groupBy(key, F.col("y").alias("dy"), F.col("h").alias("dh"), F.col("conf").alias("dc"),
                       F.col("__t").alias("digits")).agg(F.max("x").alias("dx")))
    prefixes = base.filter(F.col("__t").rlike(shape)).select(
        key, F.col(tie).alias("line_id"), "x", "y", "h", "conf",
        F.regexp_extract("__t", shape, 1).alias("prefix"),
        N.blank_to_null(F.regexp_extract("__t", shape, 3)).alias("own"))
    tall = lines.groupBy(key).agg((F.max("h") * times).alias("__band"))
    d = digits.join(tall, key).withColumn("__b", F.floor(F.col("dy") / F.col("__band")))
    p = (prefixes.filter("own IS NULL").join(tall, key)
         .withColumn("__b", F.floor(F.col("y") / F.col("__band")))
         .withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1))))
    dist = F.abs(F.col("dy") - F.col("y"))
    near = (p.join(d.drop("__band"), [key, "__b"])
            .filter((F.col("dx") > F.col("x")) & (dist <= F.greatest("h", "dh") * times))
            .groupBy(key, "line_id").agg(
                F.min_by(F.struct("prefix", "digits", F.least("conf", "dc").alias("conf")),
                         F.struct(dist, -F.col("dc"), "dx", "digits")).alias("m"))
            .select(key, "line_id", "m.*"))
    whole = prefixes.filter("own IS NOT NULL").select(key, "line_id", "prefix", F.col("own").alias("digits"), "conf")
    return near.unionByName(whole).filter(F.col("digits").cast("int") >= 1)


def box_pairs(boxes: DataFrame, key: str = "page_id", cell: float = 64.0, tie: str | None = None) -> DataFrame:
    """Overlapping pairs of distinct boxes with their IoU; with ``tie``, also the smallest tie of
    each side's copies (``aid``, ``bid``).

    A box joins through every grid cell it covers; a pair is emitted only in the cell
    that holds the corner of its intersection, so no distinct is needed and boxes that
    do not meet are never paired. Copies of a box are folded (``copies``)."""
    dims, held = ["x", "y", "w", "h"], ["copies"]
    folded = [F.count(F.lit(1)).alias("copies")]
    if tie:
        folded.append(F.min(tie).alias("id"))
        held.append("id")
    distinct = boxes.groupBy(key, *dims).agg(*folded)

    def cover(lo, size):
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell)))

    tiled = distinct.withColumn("__cx", cover("x", "w")).withColumn("__cy", cover("y", "h"))

    def side(s):
        return tiled.select(key, "__cx", "__cy", *[F.col(c).alias(s + c) for c in (*dims, *held)])

    ix, iy = F.greatest("ax", "bx"), F.greatest("ay", "by")
    iw = F.least(F.col("ax") + F.col("aw"), F.col("bx") + F.col("bw")) - ix
    ih = F.least(F.col("ay") + F.col("ah"), F.col("by") + F.col("bh")) - iy
    inter = iw * ih
    union = F.col("aw") * F.col("ah") + F.col("bw") * F.col("bh") - inter
    a_first = F.struct("ax", "ay", "aw", "ah") < F.struct(
        F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("bw").alias("aw"), F.col("bh").alias("ah"))
    return (side("a").join(side("b"), [key, "__cx", "__cy"])
            .filter(a_first & (iw > 0) & (ih > 0)
                    & (F.col("__cx") == F.floor(ix / cell)) & (F.col("__cy") == F.floor(iy / cell)))
            .withColumn("iou", inter / union).drop("__cx", "__cy"))


#: Rows of a group up to which one task folds it in one pass; a larger group is settled in distributed rounds.
FOLD_ROWS = 200_000


def _split_groups(rows: DataFrame, group: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that one task folds, rows of larger groups)."""
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*group)
    large = stage(large, "large")
    return rows.join(large, group, "left_anti"), rows.join(large, group, "left_semi")


def fold_groups(rows: DataFrame, group: list[str], order: list[str], take: Callable, out: list[str]) -> DataFrame:
    """The columns ``out`` of the rows that ``take`` chooses, group by group in ``order``: ``take(state, row)`` is called with a fresh
    dictionary per group and each row in turn. Groups stream by, sorted in their partition, so only the state is held."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [*group, *[c for c in rows.columns if c not in group]]
    n, at = len(group), [cols.index(c) for c in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            chosen = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if row[:n] != now:
                    now, state = row[:n], {}
                if take(state, row[n:]):
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64())).select(at)
    sorted_ = rows.select(*cols).repartition(parts, *group).sortWithinPartitions(*group, *order)
    return sorted_.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out))


def greedy_rounds(edges: DataFrame, node: list[str], group: str | None = None, rank: list[str] | None = None, limit: int = FOLD_ROWS) -> DataFrame:
    """The nodes that lose in a greedy selection over a conflict graph, best node first.

    ``edges``: columns ``win_<c>`` and ``lose_<c>`` for each of ``node``; the better node wins. A
    node that loses to no open node is selected, so all it beats are out; edges of what is
    out vanish, and so on until no edge is left. This selects what one pass from the best node to the
    worst selects.

    No edge leaves a ``group`` (a column of ``node``); ``rank`` are columns of the edges that order the losers, best first.
    Groups of up to ``limit`` edges are folded in that order, in one job whatever the length of their chains: a loser is out if a
    winner over it is not, and all of those have been decided. Larger groups (or all, without ``group``) are settled in distributed rounds."""
    win, lose = [f"win_{c}" for c in node], [f"lose_{c}" for c in node]
    if group is None:
        return _rounds(stage(edges.select(*win, *lose).distinct(), "edges"), node)
    edges = stage(edges.select(*win, *lose, *(rank or [])).distinct(), "edges")
    few, many = _split_groups(edges, [f"lose_{group}"], limit)
    own = [c for c in few.columns if c != f"lose_{group}"]
    w, lo = [own.index(c) for c in win], [own.index(c) for c in lose if c != f"lose_{group}"]
    here = node.index(group)

    def take(state, row):
        # An edge whose winner stays puts its loser out; edges come by loser, best loser first.
        loser, winner = tuple(row[i] for i in lo), tuple(row[i] for k, i in enumerate(w) if k != here)
        if winner in state or loser in state:
            return False
        state[loser] = True
        return True
    folded = fold_groups(few, [f"lose_{group}"], [*(rank or []), *[c for c in lose if c != f"lose_{group}"]], take, lose)
    return folded.select(*[F.col(c).alias(n) for c, n in zip(lose, node)]).unionByName(_rounds(stage(many.select(*win, *lose), "edges"), node))


def _rounds(edges: DataFrame, node: list[str]) -> DataFrame:
    win, lose = [f"win_{c}" for c in node], [f"lose_{c}" for c in node]
    out = None
    while not edges.isEmpty():
        losers = edges.select(*[F.col(c).alias(n) for c, n in zip(lose, node)]).distinct()
        sure = edges.select(*[F.col(c).alias(n) for c, n in zip(win, node)]).distinct().join(losers, node, "left_anti")
        gone = stage(edges.join(sure.select(*[F.col(n).alias(c) for c, n in zip(win, node)]), win, "left_semi")
                     .select(*[F.col(c).alias(n) for c, n in zip(lose, node)]).distinct(), "gone")
        out = gone if out is None else stage(out.unionByName(gone), "out")
        as_win = gone.select(*[F.col(n).alias(c) for c, n in zip(win, node)])
        as_lose = gone.select(*[F.col(n).alias(c) for c, n in zip(lose, node)])
        edges = stage(edges.join(as_lose, lose, "left_anti").join(as_win, win, "left_anti"), "edges")
    return edges.select(*[F.col(c).alias(n) for c, n in zip(win, node)]) if out is None else out


def greedy_unique(items: DataFrame, order: list, keys: list[list[str]], ident: list[str], limit: int = FOLD_ROWS) -> DataFrame:
    """Items chosen one by one in ``order``, none that shares one of ``keys`` with a chosen one.

    What all ``keys`` have in common is the group: groups of up to ``limit`` items are folded in one pass. In larger ones, rounds: an item that
    is first of all its key groups is certain; the others of these groups are out. No pairs are made: groups meet in
    pre-aggregated minima only."""
    rank, out = F.struct(*order), None
    whole = items
    for c in {c for k in keys for c in k}:      # an item without one of its keys is never chosen
        whole = whole.filter(F.col(c).isNotNull())
    left = stage(whole.withColumn("__rank", rank), "items")
    group = [c for c in keys[0] if all(c in k for k in keys)]
    folded = None
    if group:
        few, left = _split_groups(left, group, limit)
        held = [c for c in few.columns if c not in group]
        at = [[held.index(c) for c in k if c not in group] for k in keys]

        def take(state, row):
            met = [(i, *[row[j] for j in places]) for i, places in enumerate(at)]
            if any(m in state for m in met):
                return False
            state.update(dict.fromkeys(met))
            return True
        folded = fold_groups(few, group, ["__rank"], take, ident)
        left = stage(left, "items")
    while not left.isEmpty():
        sure = left
        for key in keys:
            best = left.groupBy(*key).agg(F.min("__rank").alias("__first"))
            sure = sure.join(best, key).filter(F.col("__rank") == F.col("__first")).drop("__first")
        sure = stage(sure, "chosen")
        out = sure if out is None else stage(out.unionByName(sure), "chosen")
        for key in keys:
            left = left.join(sure.select(*key).distinct(), key, "left_anti")
        left = stage(left, "items")
    rest = (left if out is None else out).select(*ident)
    return rest if folded is None else folded.select(*ident).unionByName(rest)


def nms(boxes: DataFrame, iou: float = 0.4, key: str = "page_id", tie: str = "line_id") -> DataFrame:
    """Greedy overlap suppression, largest area first (then smallest ``tie``).

    Copies can only lose to their first one. The others conflict where they overlap by more
    than ``iou``; the greedy choice runs over these pairs (``greedy_rounds``): one fold per page, rounds
    for a page of very many pairs."""
    first = boxes.groupBy(key, "x", "y", "w", "h").agg(F.min(tie).alias(tie))
    pairs = box_pairs(boxes, key, tie=tie).filter(F.col("iou") > iou)
    a_wins = F.struct((-F.col("aw") * F.col("ah")).alias("r"), F.col("aid").alias("i")) < F.struct(
        (-F.col("bw") * F.col("bh")).alias("r"), F.col("bid").alias("i"))
    edges = pairs.select(F.col(key).alias(f"win_{key}"), F.when(a_wins, F.col("aid")).otherwise(F.col("bid")).alias(f"win_{tie}"),
                         F.col(key).alias(f"lose_{key}"), F.when(a_wins, F.col("bid")).otherwise(F.col("aid")).alias(f"lose_{tie}"),
                         F.when(a_wins, -F.col("bw") * F.col("bh")).otherwise(-F.col("aw") * F.col("ah")).alias("rank"))
    return first.join(greedy_rounds(edges, [key, tie], key, ["rank"]), [key, tie], "left_anti").select(key, tie, "x", "y", "w", "h")


def fill_from_detections(strips: DataFrame, boxes: DataFrame, key: str = "page_id",
                         reach: float = 1.5, limit: int = FOLD_ROWS) -> DataFrame:
    """Unread strips, in order, claim the nearest unused number box within ``reach``
    strip heights whose number is not read elsewhere on the photo.

    ``strips``: key, row_index, cy, h, numerator (NULL = unread); ``boxes``: key, y,
    numerator, box_id. Candidates come from a banded equi join. Photos of up to ``limit`` candidates are folded in one pass,
    larger ones in rounds: a strip's nearest open box is certain once no earlier open strip could take that box or its
    number; certain claims close the strip, the box and the number on their photo."""
    tall = strips.groupBy(key).agg((F.max("h") * reach).alias("__band"))
    read = strips.filter("numerator IS NOT NULL").select(key, "numerator").distinct()
    free = boxes.join(read, [key, "numerator"], "left_anti").join(tall, key)
    b = free.withColumn("__b", F.floor(F.col("y") / F.col("__band"))).drop("__band")
    s = (strips.filter("numerator IS NULL").drop("numerator").join(tall, key)
         .withColumn("__b", F.floor(F.col("cy") / F.col("__band")))
         .withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1))))
    cand = (s.join(b, [key, "__b"]).withColumn("d", F.abs(F.col("y") - F.col("cy")))
            .filter(F.col("d") <= F.col("h") * reach)
            .select(key, "row_index", "d", "y", "box_id", "numerator"))
    few, cand = _split_groups(stage(cand, "claims"), [key], limit)

    def take(state, row):
        # Candidates of a strip come nearest first; the first whose box and number are free is its claim.
        strip, _, _, box, number = row
        if ("s", strip) in state or ("b", box) in state or ("n", number) in state:
            return False
        state.update({("s", strip): 1, ("b", box): 1, ("n", number): 1})
        return True
    claim = [key, "row_index", "box_id", "numerator"]
    folded = fold_groups(few.select(key, "row_index", "d", "y", "box_id", "numerator"), [key], ["row_index", "d", "y", "box_id", "numerator"], take, claim)
    out, cand = None, stage(cand, "claims")
    while not cand.isEmpty():
        nearest = (cand.groupBy(key, "row_index").agg(F.min(F.struct("d", "y", "box_id", "numerator")).alias("c"))
                   .select(key, "row_index", "c.box_id", "c.numerator"))
        by_box = cand.groupBy(key, "box_id").agg(F.min("row_index").alias("__r1"))
        by_number = cand.groupBy(key, "numerator").agg(F.min("row_index").alias("__r2"))
        sure = stage(nearest.join(by_box, [key, "box_id"]).join(by_number, [key, "numerator"])
                     .filter((F.col("__r1") == F.col("row_index")) & (F.col("__r2") == F.col("row_index")))
                     .select(key, "row_index", "box_id", "numerator"), "claimed")
        out = sure if out is None else stage(out.unionByName(sure), "claimed")
        for closed in ("row_index", "box_id", "numerator"):
            cand = cand.join(sure.select(key, closed), [key, closed], "left_anti")
        cand = stage(cand, "claims")
    return folded if out is None else folded.unionByName(out.select(*claim))
