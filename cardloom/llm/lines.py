"""Line deduplication with a log-template tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import SPACE, small
from cardloom.plans.session import stage

#: Leading tokens that lead to a leaf, tokens of the shortest line looked at, documents in which a
#: template recurs, and the share of constant tokens a template must have.
DEPTH, MIN_TOKENS, MIN_TEXTS, MIN_CONSTANT = 3, 4, 8, 0.6
#: A text that would lose more than this share of its words is a copy as a whole, no text with
#: boilerplate, and stays for the near-duplicate search.
WHOLE_SHARE = 0.5
#: Leaves or recurring lines that may be broadcast (16 to 40 bytes each), as counted first.
LEAVES = 200_000
ANY = "<*>"


def body_of(line):
    """A line's tokens joined by single spaces; tokens with a digit are variable from the start.
    Most lines are their own body and are not cut for it."""
    tokens = F.filter(F.split(line, SPACE), lambda t: t != "")
    odd = line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.array_join(
        F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(ANY)).otherwise(t)), " ")).otherwise(line)


def line_hash(body):
    """Identity of a line up to its variable fields and white space: 128 bits of its body."""
    return F.unhex(F.md5(body))


def line_bodies(strips: DataFrame, strip_id: str, text: str) -> DataFrame:
    """(strip_id, body, n_tokens, leaf) of every line with at least ``MIN_TOKENS`` tokens; the leaf is
    a hash of the token count and the first ``DEPTH`` tokens."""
    # Made inside the array, so that each line is read once: a filter on what a projection makes
    # would be moved below it and make it again.
    def described(b):
        size = F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit(""))) + 1
        return F.struct(b.alias("body"), size.alias("n_tokens"))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = strips.select(F.col(strip_id).alias("strip_id"), F.inline(F.transform(F.transform(lines, body_of), described)))
    return rows.filter(F.col("n_tokens") >= MIN_TOKENS).withColumn("leaf", F.unhex(F.md5(
        F.concat_ws("\n", F.col("n_tokens").cast("string"), F.substring_index("body", " ", DEPTH)))))


def known_lines(strips: DataFrame, strip_id: str = "strip_id", text: str = "text") -> DataFrame:
    """(strip_id, line, leaf): each text's lines once, as hashes; written to the shared folder."""
    return stage(line_bodies(strips, strip_id, text).select("strip_id", line_hash(F.col("body")).alias("line"), "leaf")
                 .distinct(), "known")


def recurring_lines(strips: DataFrame, strip_id: str = "strip_id", text: str = "text",
                    min_texts: int = MIN_TEXTS, known: DataFrame | None = None) -> DataFrame:
    """(line, template, n_texts): lines whose template recurs, by ``line_hash``.

    The tree: lines part by token count, then by their first ``DEPTH`` tokens. In a leaf, a token
    that stands at its place in at least ``min_texts`` texts is constant, any other is a
    variable field; a line's template is its tokens with the variable ones generalised. It recurs
    when it has ``min_texts`` texts and ``MIN_CONSTANT`` of its tokens are constant. All counts are
    of distinct texts: sums over lines, less what a text with several lines of a leaf (``several``)
    has too much in them, so that neither repeats nor lists in one text make anything recur.

    Only lines of leaves with enough texts are cut into tokens. All counts are pre-aggregated."""
    known = known_lines(strips, strip_id, text) if known is None else known
    counted = stage(known.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("texts")), "lines")
    several = stage(known.groupBy("leaf", "strip_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("line").alias("of"))
                    .filter("n > 1"), "several")
    leaves = (counted.select("leaf", "texts").unionByName(several.select("leaf", (1 - F.col("n")).alias("texts")))
              .groupBy("leaf").agg(F.sum("texts").alias("leaf_texts")).filter(F.col("leaf_texts") >= min_texts))
    leaves = small(stage(leaves, "leaves"), LEAVES)
    bodies = (line_bodies(strips, strip_id, text).join(leaves, "leaf")
              .groupBy(line_hash(F.col("body")).alias("line")).agg(F.min("body").alias("body")))
    bodies = stage(bodies.join(counted, "line"), "bodies")
    cut = bodies.select("line", "leaf", "texts", F.posexplode(F.split("body", " ")).alias("place", "token"))
    again = several.select("strip_id", F.explode("of").alias("line")).join(bodies.select("line", "leaf", "body"), "line")
    more = (again.select("leaf", "strip_id", F.posexplode(F.split("body", " ")).alias("place", "token"))
            .groupBy("leaf", "place", "token", "strip_id").agg((1 - F.count(F.lit(1))).alias("texts")).filter("texts < 0"))
    seen = (cut.select("leaf", "place", "token", "texts").unionByName(more.drop("strip_id"))
            .groupBy("leaf", "place", "token").agg(F.sum("texts").alias("seen"))
            .filter((F.col("seen") >= min_texts) & (F.col("token") != ANY)).drop("seen").withColumn("constant", F.lit(True)))
    told = cut.join(seen, ["leaf", "place", "token"], "left").groupBy("line", "leaf", "texts").agg(
        F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(ANY)).alias("t")))).alias("t"),
        F.avg(F.when(F.col("constant"), 1.0).otherwise(0.0)).alias("share"))
    told = told.filter(F.col("share") >= MIN_CONSTANT).select(
        "line", "texts", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("template"))
    told = stage(told, "templates")
    more = (again.select("strip_id", "line").join(told.select("line", "template"), "line")
            .groupBy("template", "strip_id").agg((1 - F.count(F.lit(1))).alias("texts")).filter("texts < 0"))
    often = (told.select("template", "texts").unionByName(more.drop("strip_id"))
             .groupBy("template").agg(F.sum("texts").alias("n_texts")).filter(F.col("n_texts") >= min_texts))
    return stage(told.join(often, "template").select("line", "template", "n_texts"), "recurring")


def drop_templates(strips: DataFrame, strip_id: str = "strip_id", text: str = "text", min_texts: int = MIN_TEXTS,
                   whole_share: float = WHOLE_SHARE) -> DataFrame:
    """Every input row with its ``text`` freed of lines whose template recurs across texts, and
    ``n_lines``, ``n_dropped``, ``words_dropped`` (an input column so named is replaced).

    NULL stays NULL; a text without recurring lines is unchanged byte by byte. A text of which
    recurring lines hold more than ``whole_share`` of the words stays whole (``n_dropped`` 0): it
    is a copy, which near-duplicate search judges. Ids may repeat or be NULL."""
    known = known_lines(strips, strip_id, text)
    recurring = small(recurring_lines(strips, strip_id, text, min_texts, known).select("line"), LEAVES)
    gone = (known.join(recurring, "line").groupBy(F.col("strip_id").alias("_id")).agg(F.collect_set("line").alias("_gone")))
    gone = stage(gone, "gone")
    rest = [c for c in strips.columns if c.lower() not in ("n_lines", "n_dropped", "words_dropped")]
    # By merge at every size: the lists of lines grow with the texts, so none may be broadcast.
    df = strips.select(*rest).join(gone.hint("merge"), F.col(strip_id).eqNullSafe(F.col("_id")), "left").drop("_id")
    df = df.withColumn("_lines", F.split(F.col(text), "\n"))
    df = df.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains(F.col("_gone"), line_hash(body_of(x))))))
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    left = F.regexp_count(F.coalesce(F.array_join("_left", "\n"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    df = df.withColumn("_words", F.when(F.col("_gone").isNull(), 0).otherwise(count - left)) \
        .withColumn("_all", F.when(F.col("_gone").isNull(), 1).otherwise(count))
    cut = (F.col("_words") > 0) & (F.col("_words") <= whole_share * F.col("_all"))
    return df.select(*[F.when(cut, F.array_join("_left", "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in rest],
                     F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
                     F.when(cut, F.size("_lines") - F.size("_left")).otherwise(0).cast("long").alias("n_dropped"),
                     F.when(cut, F.col("_words")).otherwise(0).cast("long").alias("words_dropped"))
