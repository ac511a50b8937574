"""Layout analytics over the detection stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import numbers as N
from cardloom.operators import layout
from cardloom.plans.session import stage
from cardloom.queries.registry import query

_NUM = "n AS (SELECT * FROM ocr_line WHERE contains(text, '/'))"


def _islands_sql(name, source, coord, gap, op=">"):
    return f"""{name}_j AS (SELECT *, CASE WHEN {coord} - lag({coord}) OVER (PARTITION BY page_id ORDER BY {coord}, line_id) {op} {gap} THEN 1 ELSE 0 END AS j FROM {source}),
{name} AS (SELECT * EXCLUDE (j), CAST(sum(j) OVER (PARTITION BY page_id ORDER BY {coord}, line_id) AS BIGINT) AS island FROM {name}_j)"""


@query("E4", "gap_split", f"""WITH {_islands_sql('c', 'ocr_line', 'x', 20)}, {_islands_sql('r', 'ocr_line', 'y', 15, '>=')}
SELECT c.page_id, c.line_id, c.island AS column_no, r.island AS row_no FROM c JOIN r ON c.line_id = r.line_id""")
def _gap_split(t):
    c = layout.gap_split(t.ocr, ["page_id"], "x", 20.0).select("page_id", "line_id", "y", F.col("island").alias("column_no")).transform(stage)
    return layout.gap_split(c, ["page_id"], "y", 15.0, inclusive=True).select(
        "page_id", "line_id", "column_no", F.col("island").alias("row_no"))


@query("E4", "cluster_medians", f"""WITH {_islands_sql('c', 'ocr_line', 'x', 20)}
SELECT page_id, island, median(x) AS center, count(*) AS members FROM c GROUP BY 1, 2""")
def _medians(t):
    return layout.cluster_medians(layout.gap_split(t.ocr, ["page_id"], "x", 20.0), ["page_id"], "x")


_BANDS = """m AS (SELECT page_id, median(h) AS mh FROM ocr_line GROUP BY 1),
yc AS (SELECT o.*, o.y + o.h / 2 AS yc, o.x + o.w / 2 AS xc, mh FROM ocr_line o JOIN m ON o.page_id = m.page_id),
bj AS (SELECT *, CASE WHEN yc - lag(yc) OVER (PARTITION BY page_id ORDER BY yc, line_id) > 0.5 * mh THEN 1 ELSE 0 END AS j FROM yc),
b AS (SELECT *, CAST(sum(j) OVER (PARTITION BY page_id ORDER BY yc, line_id) AS BIGINT) AS band FROM bj)"""


@query("E5", "reading_order", f"""WITH {_BANDS}, g AS (SELECT page_id, max(band) + 1 AS grid_rows, max(n) AS grid_cols FROM (SELECT page_id, band, count(*) AS n FROM b GROUP BY 1, 2) x GROUP BY 1)
SELECT b.page_id, line_id, band, row_number() OVER (PARTITION BY b.page_id ORDER BY band, xc, line_id) - 1 AS position, grid_rows, grid_cols FROM b JOIN g ON b.page_id = g.page_id""")
def _reading(t):
    return layout.reading_order(t.ocr).select("page_id", "line_id", "band", "position", "grid_rows", "grid_cols")


_TITLE_TEXT = "CASE WHEN line_id % 9 = 0 THEN 'HP' WHEN line_id % 9 = 1 THEN 'BASIC' WHEN line_id % 9 = 2 THEN 'EVOLVES FROM X' ELSE text END"


@query("E6", "rebuild_titles", f"""WITH k AS (SELECT * REPLACE ({_TITLE_TEXT} AS text) FROM ocr_line WHERE line_id % 9 NOT IN (0, 1)),
m AS (SELECT page_id, median(h) AS mh FROM k GROUP BY 1),
j AS (SELECT k.*, CASE WHEN y - lag(y) OVER (PARTITION BY k.page_id ORDER BY y, line_id) > 0.5 * mh THEN 1 ELSE 0 END AS j FROM k JOIN m ON k.page_id = m.page_id),
b AS (SELECT *, sum(j) OVER (PARTITION BY page_id ORDER BY y, line_id) AS band FROM j),
r AS (SELECT page_id, band, min(y) AS top, max(conf) AS conf, string_agg(text, ' ' ORDER BY x, line_id) AS title FROM b GROUP BY 1, 2)
SELECT page_id, title, top, conf, row_number() OVER (PARTITION BY page_id ORDER BY top, conf DESC, band) - 1 AS rank FROM r WHERE NOT contains(title, 'VOLVES')""")
def _titles(t):
    lines = t.ocr.withColumn("text", F.expr(_TITLE_TEXT))
    return layout.rebuild_titles(lines).select("page_id", "title", "top", "conf", "rank")


_BEST = f"""{_NUM}, best AS (SELECT * FROM (SELECT *, split_part(text, '/', 1) AS numerator, row_number() OVER (PARTITION BY page_id, split_part(text, '/', 1) ORDER BY conf DESC, y, line_id) AS r FROM n) x WHERE r = 1)"""


@query("E7", "keep_best_per_number", f"""WITH {_BEST} SELECT b.page_id, line_id, numerator, c.rows FROM best b JOIN (SELECT page_id, count(*) AS rows FROM best GROUP BY 1 HAVING count(*) >= 3) c ON b.page_id = c.page_id""")
def _best(t):
    return layout.keep_best_per_number(t.ocr).select("page_id", "line_id", "numerator", "rows")


@query("E8", "blank_duplicate_numbers", """WITH b AS (SELECT *, coalesce(pattern_ok AND numerator IS NOT NULL AND row_number() OVER (
    PARTITION BY pull_id, pattern_ok, numerator ORDER BY confidence DESC, row_index) > 1, FALSE) AS blank FROM reading)
SELECT pull_id, row_index, blank, CASE WHEN NOT blank THEN numerator END AS numerator, CASE WHEN NOT blank THEN denominator END AS denominator,
  CASE WHEN NOT blank THEN prefix END AS prefix, pattern_ok AND NOT blank AS pattern_ok, CASE WHEN blank THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM b""")
def _blank(t):
    return layout.blank_duplicate_numbers(t.readings).select(
        "pull_id", "row_index", "blank", "numerator", "denominator", "prefix", "pattern_ok", "confidence")


_TOK = "CASE WHEN (line_id + {i}) % 4 = 0 THEN 'AB' || CAST(line_id % 1000 + 100 AS VARCHAR) || '-CDE' WHEN (line_id + {i}) % 4 = 1 THEN '-X' || CAST(line_id % 90 + 10 AS VARCHAR) WHEN (line_id + {i}) % 4 = 2 THEN 'TEST' || CAST(line_id % 10 AS VARCHAR) ELSE 'ABC-DEF-' || CAST(line_id % 1000 + 100 AS VARCHAR) END"


def tokens(t):
    one = [F.struct(F.expr(_TOK.format(i=i).replace("VARCHAR", "STRING")).alias("text"),
                    ((F.col("line_id") * (i + 3)) % 100).cast("double").alias("conf")) for i in range(3)]
    return t.ocr.select("line_id", F.slice(F.array(*one), F.lit(1), (F.lit(1) + F.col("line_id") % 3).cast("int")).alias("tokens"))


_TK = "tk AS (SELECT line_id, i, t, c FROM (" + " UNION ALL ".join(
    f"SELECT line_id, {i} AS i, {_TOK.format(i=i)} AS t, CAST((line_id * {i + 3}) % 100 AS DOUBLE) AS c FROM ocr_line WHERE {i} <= line_id % 3" for i in range(3)) + ") x)"
_RX = "'^[A-Z0-9]{3,6}(-[A-Z0-9]{3,6}){2,4}$'"


@query("E10", "assemble_code", f"""WITH {_TK},
whole AS (SELECT line_id, t AS code, c, 0 AS tier, i AS o FROM tk WHERE regexp_matches(t, {_RX})),
fr AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY i) AS p FROM tk WHERE regexp_matches(t, '^[A-Z0-9-]{{2,}}$')),
j2 AS (SELECT a.line_id, a.t || b.t AS code, (a.c + b.c) / 2 AS c, 1 AS tier, a.p * 4 + 2 AS o FROM fr a JOIN fr b ON a.line_id = b.line_id AND b.p = a.p + 1),
j3 AS (SELECT a.line_id, a.t || b.t || d.t AS code, (a.c + b.c + d.c) / 3 AS c, 1 AS tier, a.p * 4 + 3 AS o FROM fr a JOIN fr b ON a.line_id = b.line_id AND b.p = a.p + 1 JOIN fr d ON a.line_id = d.line_id AND d.p = a.p + 2),
al AS (SELECT * FROM whole UNION ALL SELECT * FROM j2 WHERE regexp_matches(code, {_RX}) UNION ALL SELECT * FROM j3 WHERE regexp_matches(code, {_RX})),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY tier, c DESC, o) AS r FROM al) x WHERE r = 1)
SELECT o.line_id, b.code, round(b.c / 100, 8) AS conf FROM ocr_line o LEFT JOIN b ON o.line_id = b.line_id""")
def _assemble(t):
    return tokens(t).withColumn("r", layout.assemble_code(F.col("tokens"))).select(
        "line_id", "r.code", F.round("r.conf", 8).alias("conf"))


@query("E11", "recover_split_code", f"""WITH {_TK}, s AS (SELECT line_id, count(*) AS n, string_agg(t, '' ORDER BY i) AS code, avg(c) AS c FROM tk WHERE regexp_matches(t, '^[A-Z0-9]{{3,6}}$') GROUP BY 1)
SELECT o.line_id, s.code, round(s.c / 100, 8) AS conf FROM ocr_line o LEFT JOIN s ON o.line_id = s.line_id AND n BETWEEN 2 AND 5 AND length(code) BETWEEN 9 AND 30""")
def _recover(t):
    return tokens(t).withColumn("r", layout.recover_split_code(F.col("tokens"))).select(
        "line_id", "r.code", F.round("r.conf", 8).alias("conf"))


_WIDE = "bx AS (SELECT page_id, line_id, x, y, w * (1 + line_id % 7) AS w, h FROM ocr_line)"


def wide(t):
    return t.ocr.withColumn("w", F.col("w") * (1 + F.col("line_id") % 7))


@query("E12", "median_outlier_filter", f"""WITH {_WIDE}, m AS (SELECT page_id, median(w * h) AS m FROM bx GROUP BY 1)
SELECT bx.page_id, line_id FROM bx JOIN m ON bx.page_id = m.page_id WHERE w * h BETWEEN m / 3.0 AND m * 3.0""")
def _outliers(t):
    return layout.median_outlier_filter(wide(t)).select("page_id", "line_id")


@query("E13", "prune_close_rows", """WITH RECURSIVE d AS (SELECT DISTINCT page_id, y FROM ocr_line),
g AS (SELECT page_id, y, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS gap FROM d), lim AS (SELECT page_id, 0.5 * median(gap) AS t FROM g GROUP BY 1),
k AS (SELECT page_id, min(y) AS y FROM d GROUP BY 1 UNION ALL
  SELECT k.page_id, (SELECT min(d.y) FROM d WHERE d.page_id = k.page_id AND d.y - k.y >= l.t) FROM k JOIN lim l ON k.page_id = l.page_id
  WHERE EXISTS (SELECT 1 FROM d WHERE d.page_id = k.page_id AND d.y - k.y >= l.t))
SELECT page_id, y FROM k""")
def _prune(t):
    return layout.prune_close_rows(t.ocr)


@query("E16", "line_crop_plan", f"""WITH {_NUM}, d AS (SELECT DISTINCT page_id, y FROM n), g AS (SELECT page_id, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS gap FROM d),
m AS (SELECT page_id, coalesce(median(gap), 0.08 * 1400) AS mg FROM g GROUP BY 1), b AS (SELECT n.page_id, line_id, y, mg, greatest(30, CAST(trunc(mg * 0.95) AS INT)) AS band FROM n JOIN m ON n.page_id = m.page_id)
SELECT page_id, line_id, mg AS median_gap, CAST(greatest(0, trunc(y - band * 0.55)) AS INT) AS top, CAST(least(1400, trunc(y + band * 0.45)) AS INT) AS bottom FROM b
WHERE least(1400, trunc(y + band * 0.45)) - greatest(0, trunc(y - band * 0.55)) >= 8""")
def _crops(t):
    return layout.line_crop_plan(t.ocr.filter(F.contains("text", F.lit("/"))), 1400.0).select(
        "page_id", "line_id", "median_gap", "top", "bottom")


def grid_cells(t):
    c = stage(layout.gap_split(t.ocr, ["page_id"], "x", 20.0), "columns")
    return layout.gap_split(c.withColumnRenamed("island", "col"), ["page_id", "col"], "y", 60.0) \
        .withColumnsRenamed({"island": "cell", "col": "island"}).transform(stage)


_CELLS = f"""{_islands_sql('c', 'ocr_line', 'x', 20)}, cj AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id, island ORDER BY y, line_id) > 60 THEN 1 ELSE 0 END AS j FROM c),
cl AS (SELECT *, CAST(sum(j) OVER (PARTITION BY page_id, island ORDER BY y, line_id) AS BIGINT) AS cell FROM cj),
cg AS (SELECT page_id, center - lag(center) OVER (PARTITION BY page_id ORDER BY center) AS g FROM (SELECT page_id, island, median(x) AS center FROM c GROUP BY 1, 2) x),
rg AS (SELECT page_id, center - lag(center) OVER (PARTITION BY page_id, island ORDER BY center) AS g FROM (SELECT page_id, island, cell, avg(y) AS center FROM cl GROUP BY 1, 2, 3) x),
pt AS (SELECT a.page_id, col_pitch, row_pitch FROM (SELECT page_id, median(g) AS col_pitch FROM cg GROUP BY 1) a JOIN (SELECT page_id, median(g) AS row_pitch FROM rg GROUP BY 1) b ON a.page_id = b.page_id)"""


@query("E17", "grid_pitch", f"WITH {_CELLS} SELECT page_id, round(col_pitch, 6) AS col_pitch, round(row_pitch, 6) AS row_pitch FROM pt")
def _pitch(t):
    return layout.grid_pitch(grid_cells(t)).select("page_id", F.round("col_pitch", 6).alias("col_pitch"), F.round("row_pitch", 6).alias("row_pitch"))


@query("E17", "coarse_box", f"""WITH {_CELLS}, bb AS (SELECT page_id, island, cell, min(x - w / 2) AS l, max(x + w / 2) AS r, min(y - h / 2) AS t, max(y + h / 2) AS b FROM cl GROUP BY 1, 2, 3),
d AS (SELECT bb.*, CASE WHEN col_pitch IS NOT NULL AND row_pitch IS NOT NULL AND col_pitch <> 0 AND row_pitch <> 0 THEN 0.92 * col_pitch ELSE (r - l) * 1.6 END AS cw,
   CASE WHEN col_pitch IS NOT NULL AND row_pitch IS NOT NULL AND col_pitch <> 0 AND row_pitch <> 0 THEN 0.92 * row_pitch ELSE (r - l) * 1.6 * 1.4 END AS ch FROM bb JOIN pt ON bb.page_id = pt.page_id),
e AS (SELECT page_id, island, cell, least(1000, greatest(0, CAST(round_even((l + r) / 2 - cw / 2, 0) AS INT))) AS x0, least(1400, greatest(0, CAST(round_even((t + b) / 2 - ch / 2, 0) AS INT))) AS y0,
   least(1000, greatest(0, CAST(round_even((l + r) / 2 + cw / 2, 0) AS INT))) AS x1, least(1400, greatest(0, CAST(round_even((t + b) / 2 + ch / 2, 0) AS INT))) AS y1 FROM d)
SELECT page_id, island, cell, x0, y0, greatest(1, x1 - x0) AS box_w, greatest(1, y1 - y0) AS box_h FROM e""")
def _coarse(t):
    c = grid_cells(t)
    return layout.coarse_boxes(c, layout.grid_pitch(c), 1000, 1400)


@query("D36", "gap_cv", """WITH tr AS (SELECT page_id, CAST(1 + line_id % 3 AS INT) AS trial, line_id, y FROM ocr_line),
g AS (SELECT page_id, trial, y - lag(y) OVER (PARTITION BY page_id, trial ORDER BY y) AS g FROM tr),
c AS (SELECT page_id, trial, count(*) AS rows, CASE WHEN count(*) >= 3 AND avg(g) > 0 THEN round(stddev_pop(g) / avg(g), 6) ELSE 'inf'::DOUBLE END AS cv FROM g GROUP BY 1, 2)
SELECT page_id, trial, rows, CASE WHEN cv = 'inf'::DOUBLE THEN -1 ELSE cv END AS gap_cv FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN rows BETWEEN 5 AND 13 THEN 0 ELSE 1 END,
   CASE WHEN rows BETWEEN 5 AND 13 THEN cv ELSE -rows END, trial) AS r FROM c) x WHERE r = 1""")
def _gap_cv(t):
    trials = t.ocr.withColumn("trial", (F.lit(1) + F.col("line_id") % 3).cast("int"))
    cv = layout.gap_cv(trials, ["page_id", "trial"]).withColumn("gap_cv", F.round("gap_cv", 6))
    best = layout.best_trial(cv, "page_id", "trial")
    return best.withColumn("gap_cv", F.when(F.col("gap_cv") == float("inf"), -1.0).otherwise(F.col("gap_cv")))


@query("D40", "join_line_text", """SELECT page_id, CAST(floor(y / 100) AS BIGINT) AS strip, string_agg(upper(text), ' ' ORDER BY x, upper(text)) AS text, round(avg(conf), 8) AS conf FROM ocr_line GROUP BY 1, 2""")
def _line_text(t):
    lines = t.ocr.withColumn("strip", F.floor(F.col("y") / 100))
    return layout.join_line_text(lines, ["page_id", "strip"], "x").withColumn("conf", F.round("conf", 8))


_BARE = "CASE WHEN line_id % 5 = 0 THEN lpad(CAST(line_id % 300 AS {s}), 3, '0') WHEN contains(text, '/') AND line_id % 2 = 1 THEN 'X2' ELSE text END"


@query("H13", "parse_bare_numerator", f"""WITH s AS (SELECT page_id, CAST(floor(y / 100) AS BIGINT) AS strip, line_id, {_BARE.format(s='VARCHAR')} AS text, conf FROM ocr_line),
ok AS (SELECT page_id, strip FROM s GROUP BY 1, 2 HAVING NOT bool_or(contains(text, '/')))
SELECT page_id, strip, numerator, confidence FROM (SELECT s.page_id, s.strip, text AS numerator, round(conf, 3) AS confidence, row_number() OVER (PARTITION BY s.page_id, s.strip ORDER BY conf DESC, line_id) AS r
  FROM s JOIN ok ON s.page_id = ok.page_id AND s.strip = ok.strip WHERE regexp_matches(text, '^[0-9]{{2,3}}$') AND TRY_CAST(text AS INT) >= 1) x WHERE r = 1""")
def _bare(t):
    lines = t.ocr.withColumns({"strip": F.floor(F.col("y") / 100), "text": F.expr(_BARE.format(s="STRING"))})
    return layout.bare_numerators(lines, ["page_id", "strip"], "line_id")


# -- nearest and spatial joins ----------------------------------------------------------------

@query("C12", "assign_to_anchor", f"""WITH {_NUM} SELECT o.page_id, o.line_id, coalesce((SELECT min(n.y) FROM n WHERE n.page_id = o.page_id AND n.y >= o.y - 20), (SELECT max(n.y) FROM n WHERE n.page_id = o.page_id)) AS anchor_y
FROM ocr_line o WHERE o.page_id IN (SELECT page_id FROM n)""")
def _anchor(t):
    return layout.assign_to_anchor(t.ocr, layout.number_lines(t.ocr), 20.0).select("page_id", "line_id", "anchor_y")


@query("C13", "snap_to_guides", """WITH g AS (SELECT o.page_id, k * 100.0 AS gy FROM (SELECT DISTINCT page_id FROM ocr_line) o, (SELECT unnest(range(1, 14)) AS k) z),
c AS (SELECT g.page_id, g.gy, e.y, row_number() OVER (PARTITION BY g.page_id, g.gy ORDER BY abs(e.y - g.gy), e.y) AS r FROM g JOIN ocr_line e ON g.page_id = e.page_id AND abs(e.y - g.gy) <= 35)
SELECT CAST(g.page_id AS BIGINT) AS page_id, CAST(g.gy AS DOUBLE) AS guide_y, CAST(coalesce(c.y, g.gy) AS DOUBLE) AS row_y, c.y IS NOT NULL AS moved FROM g LEFT JOIN c ON g.page_id = c.page_id AND g.gy = c.gy AND c.r = 1""")
def _guides(t):
    ys = F.array(*[F.lit(100.0 * i) for i in range(1, 14)])
    g = t.ocr.select("page_id").distinct().withColumn("guide_y", F.explode(ys))
    return layout.snap_to_guides(g, t.ocr.select("page_id", F.col("y").alias("edge_y")), F.lit(35.0))


@query("C20", "label_by_nearest", """WITH s AS (SELECT page_id, line_id, y, h FROM ocr_line WHERE line_id % 3 <> 0), b AS (SELECT page_id, y AS cy, min(text) AS label FROM ocr_line WHERE line_id % 3 = 0 GROUP BY 1, 2),
c AS (SELECT s.line_id, b.label, row_number() OVER (PARTITION BY s.line_id ORDER BY abs(b.cy - s.y), b.cy) AS r FROM s JOIN b ON s.page_id = b.page_id AND abs(b.cy - s.y) <= 0.6 * s.h)
SELECT s.page_id, s.line_id, c.label FROM s LEFT JOIN c ON s.line_id = c.line_id AND c.r = 1""")
def _label(t):
    bands = t.ocr.filter("line_id % 3 = 0").select("page_id", F.col("y").alias("cy"), F.col("text").alias("label"))
    strips = t.ocr.filter("line_id % 3 <> 0").select("page_id", "line_id", "y", "h")
    return layout.snap_nearest(strips, bands, "page_id", "y", "cy", F.col("h") * 0.6, "label").select(
        "page_id", "line_id", F.col("snapped.label").alias("label"))


_SPLIT = "CASE WHEN line_id % 3 = 0 THEN lpad(CAST(line_id % 60 AS {s}), 3, '0') WHEN line_id % 13 = 2 THEN 'MEPB' || lpad(CAST(line_id % 40 AS {s}), 3, '0') ELSE text END"


@query("C15", "rejoin_split_number", f"""WITH s AS (SELECT page_id, line_id, x, y, h, conf, regexp_replace({_SPLIT.format(s='VARCHAR')}, '[^A-Z0-9]', '', 'g') AS t FROM ocr_line),
p AS (SELECT *, regexp_extract(t, '^(SWSH|SVP|MEP)([A-Z]{{0,2}})([0-9]{{1,3}})?$', 1) AS pre, regexp_extract(t, '^(SWSH|SVP|MEP)([A-Z]{{0,2}})([0-9]{{1,3}})?$', 3) AS own FROM s WHERE regexp_matches(t, '^(SWSH|SVP|MEP)([A-Z]{{0,2}})([0-9]{{1,3}})?$')),
d AS (SELECT * FROM s WHERE regexp_matches(t, '^[0-9]{{2,3}}$')),
c AS (SELECT p.page_id, p.line_id, p.pre AS prefix, d.t AS digits, least(p.conf, d.conf) AS conf, row_number() OVER (PARTITION BY p.line_id ORDER BY abs(d.y - p.y), d.conf DESC, d.x, d.t) AS r
   FROM p JOIN d ON p.page_id = d.page_id AND d.x > p.x AND abs(d.y - p.y) <= 1.5 * greatest(p.h, d.h) WHERE own = '')
SELECT page_id, line_id, prefix, digits, conf FROM c WHERE r = 1 AND CAST(digits AS INT) >= 1
UNION ALL SELECT page_id, line_id, pre, own, conf FROM p WHERE own <> '' AND CAST(own AS INT) >= 1""")
def _rejoin(t):
    return layout.rejoin_split_number(t.ocr.withColumn("text", F.expr(_SPLIT.format(s="STRING"))))


@query("C18", "box_iou", f"""WITH {_WIDE}, d AS (SELECT page_id, x, y, w, h, count(*) AS n FROM bx GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT a.page_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", a.w * a.h + b.w * b.h AS s, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS iw, (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS ih
  FROM d a JOIN d b ON a.page_id = b.page_id AND (a.x, a.y, a.w, a.h) < (b.x, b.y, b.w, b.h))
SELECT page_id, ax, ay, bx, "by", round(iw * ih / (s - iw * ih), 6) AS iou FROM p WHERE iw > 0 AND ih > 0""")
def _iou(t):
    return layout.box_pairs(wide(t)).select("page_id", "ax", "ay", "bx", "by", F.round("iou", 6).alias("iou"))


def _nms_sql(limit):
    """The greedy pass spelled out: pages in step, one box after the other, kept boxes in a list."""
    over = ("greatest(0, least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * greatest(0, least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y))")
    return f"""{_WIDE}, f AS (SELECT page_id, x, y, w, h, min(line_id) AS line_id FROM bx GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w * h DESC, line_id) AS n FROM f),
st AS (SELECT page_id, CAST(1 AS BIGINT) AS n, [{{'i': line_id, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.page_id, o.n, CASE WHEN len(list_filter(st.kept, lambda k: {over} > {limit} * (k.w * k.h + o.w * o.h - {over}))) > 0 THEN st.kept
    ELSE list_append(st.kept, {{'i': o.line_id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) END FROM st JOIN o ON o.page_id = st.page_id AND o.n = st.n + 1),
keep AS (SELECT page_id, unnest(kept).i AS line_id FROM (SELECT page_id, arg_max(kept, n) AS kept FROM st GROUP BY 1) z)"""


@query("C19", "nms", f"WITH RECURSIVE {_nms_sql(0.4)} SELECT page_id, line_id FROM keep")
def _nms(t):
    return layout.nms(wide(t)).select("page_id", "line_id")


_ITEM = "i AS (SELECT page_id, line_id, floor(y / 20) AS row_key, upper(text) AS word, conf FROM ocr_line)"


@query("J3", "greedy_groups", f"""WITH RECURSIVE {_ITEM}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, line_id) AS n FROM i),
st AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS rws, CAST([] AS VARCHAR[]) AS wds, CAST([] AS BIGINT[]) AS kept FROM i
  UNION ALL SELECT page_id, n, CASE WHEN no THEN rws ELSE list_append(rws, row_key) END, CASE WHEN no THEN wds ELSE list_append(wds, word) END, CASE WHEN no THEN kept ELSE list_append(kept, line_id) END
  FROM (SELECT o.page_id, o.n, st.rws, st.wds, st.kept, o.row_key, o.word, o.line_id, list_contains(st.rws, o.row_key) OR list_contains(st.wds, o.word) AS no FROM st JOIN o ON o.page_id = st.page_id AND o.n = st.n + 1) z)
SELECT page_id, unnest(kept) AS line_id FROM (SELECT page_id, arg_max(kept, n) AS kept FROM st GROUP BY 1) z""")
def _greedy(t):
    """The greedy surface with another conflict: of a page's lines, best confidence first, those
    that share neither their row nor their word with a chosen one."""
    i = t.ocr.select("page_id", "line_id", F.floor(F.col("y") / 20).alias("row_key"), F.upper("text").alias("word"), "conf")
    return layout.greedy_unique(i, [(-F.col("conf")).alias("c"), F.col("line_id").alias("i")],
                                [["page_id", "row_key"], ["page_id", "word"]], ["page_id", "line_id"])


_CLAIM = """ln AS (SELECT page_id, line_id, y, h, CASE WHEN contains(text, '/') THEN split_part(text, '/', 1) END AS numerator FROM ocr_line),
sp AS (SELECT page_id, line_id AS row_index, y AS cy, h, CASE WHEN line_id % 4 = 0 THEN numerator END AS numerator FROM ln WHERE line_id % 2 = 0),
bo AS (SELECT b.page_id, b.y, b.numerator, b.line_id AS box_id FROM ln b WHERE line_id % 2 = 1 AND numerator IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.page_id = b.page_id AND sp.numerator = b.numerator)),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY row_index) AS n FROM sp WHERE numerator IS NULL),
cd AS (SELECT o.page_id, o.n, o.row_index, list({'b': box_id, 'm': bo.numerator} ORDER BY abs(bo.y - cy), bo.y, box_id) AS c FROM o LEFT JOIN bo ON o.page_id = bo.page_id AND abs(bo.y - cy) <= 1.5 * h GROUP BY 1, 2, 3)"""


@query("C14", "fill_from_detections", f"""WITH RECURSIVE {_CLAIM},
st AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS row_index, CAST(NULL AS BIGINT) AS box_id, CAST(NULL AS VARCHAR) AS numerator, CAST([] AS BIGINT[]) AS used, CAST([] AS VARCHAR[]) AS have FROM cd
  UNION ALL SELECT page_id, n, row_index, f.b, f.m, CASE WHEN f IS NULL THEN used ELSE list_append(used, f.b) END, CASE WHEN f IS NULL THEN have ELSE list_append(have, f.m) END
  FROM (SELECT cd.page_id, cd.n, cd.row_index, st.used, st.have, list_filter(cd.c, lambda k: k.b IS NOT NULL AND NOT list_contains(st.used, k.b) AND NOT list_contains(st.have, k.m))[1] AS f
        FROM st JOIN cd ON cd.page_id = st.page_id AND cd.n = st.n + 1) z)
SELECT page_id, row_index, box_id, numerator FROM st WHERE box_id IS NOT NULL""")
def _fill(t):
    lines = t.ocr.withColumn("r", N.parse_number(F.col("text"), F.col("conf")))
    strips = lines.filter("line_id % 2 = 0").select(
        "page_id", F.col("line_id").alias("row_index"), F.col("y").alias("cy"), "h",
        F.when(F.col("line_id") % 4 == 0, F.col("r.numerator")).alias("numerator"))
    boxes = lines.filter("line_id % 2 = 1 AND r.pattern_ok").select(
        "page_id", "y", F.col("r.numerator").alias("numerator"), F.col("line_id").alias("box_id"))
    return layout.fill_from_detections(strips, boxes)
