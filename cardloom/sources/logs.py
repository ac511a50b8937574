"""Timing-log lines and web pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cardloom.plans.skew import percentiles

# The shapes of a timing line and of an anchor.
TIMING_PATTERN = r"timing\.([a-z0-9_]+)\.([a-z0-9_]+) scan=(\S+) ms=([0-9]+(?:\.[0-9]+)?)"
ANCHOR_PATTERN = r'<a\s+href="(/[^"]*)"[^>]*>([^<]*)</a>'


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value, file, line) of all text files of a folder; ``line`` counts from 1 in each file.

    Long files are read in pieces by many tasks: lines are numbered in their piece, and only the pieces' line counts
    meet. Empty files have no lines; bytes that are no UTF-8 are replaced."""
    text = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__piece"),
                                          F.monotonically_increasing_id().alias("__at"))
    pieces = text.groupBy("file", "__piece").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("file", "__piece", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return text.join(pieces, ["file", "__piece"]).select("value", "file", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line"))


def parse_timing(lines: DataFrame, column: str = "value") -> DataFrame:
    """flow, stage, scan, ms; lines of any other shape are left out."""
    def part(i):
        return F.regexp_extract(column, TIMING_PATTERN, i)

    return (lines.filter(F.col(column).rlike(TIMING_PATTERN))
            .withColumns({"flow": part(1), "stage": part(2), "scan": part(3),
                          "ms": part(4).cast("double")}))


def latency(timings: DataFrame, width: float = 16.0) -> DataFrame:
    """Exact p50/p95/max/count per flow and stage, from value counts read in tiles of ``width`` ms."""
    return percentiles(timings, ["flow", "stage"], F.col("ms"), {"p50": 0.5, "p95": 0.95}, width,
                       [F.max("value").alias("max_ms"), F.sum("n").alias("n")])


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def extract_links(pages: DataFrame, slug_pattern: str = r"^/[^/?#]+$") -> DataFrame:
    """Anchors whose target matches the slug pattern: first occurrence per page and
    slug, display name (title-cased slug when the text is blank), absolute URL."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR_PATTERN), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(ANCHOR_PATTERN), F.lit(2))
    found = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))))
    links = found.select("page_id", "url", "pos", F.col("col.href").alias("href"),
                         F.trim("col.text").alias("text")).filter(F.col("href").rlike(slug_pattern))
    first = links.groupBy("page_id", "url", F.substring("href", 2, 1 << 20).alias("slug")).agg(
        F.min(F.struct("pos", "text")).alias("f"))
    name = F.coalesce(F.nullif(F.col("f.text"), F.lit("")),
                      F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))))
    return first.select("page_id", "slug", name.alias("name"),
                        F.concat(origin(F.col("url")), F.lit("/"), "slug").alias("link"))
