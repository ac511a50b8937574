"""Host-level quality rules: failures by host, shrunk rates, verdicts joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import SPACE, key_of, small
from cardloom.plans.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = ("base", "symbols", "dup_lines")


def text_measures(strips: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of each text (NULL: as the empty text); an input column of the same
    name is replaced: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed. Everything stays inside one row, so nothing is shuffled; the repeated
    three-word windows are found by sorting a text's windows, never by comparing all pairs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = strips.withColumns({
        "_words": F.filter(F.split(whole, SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_next": F.slice(F.col("_words"), 2, F.greatest(F.size("_words") - 2, F.lit(0))),
        "_last": F.slice(F.col("_words"), 3, F.greatest(F.size("_words") - 2, F.lit(0))),
    })
    window = F.transform(
        F.arrays_zip(F.slice(F.col("_words"), 1, F.greatest(F.size("_words") - 2, F.lit(0))).alias("x"),
                     F.col("_next").alias("y"), F.col("_last").alias("z")),
        lambda w, i: F.struct(F.concat_ws(" ", w["x"], w["y"], w["z"]).alias("w"), i.alias("i")))
    df = df.withColumn("_sorted", F.array_sort(window)).drop("_next", "_last", "_lines", "_words")
    # A window is repeated if its neighbour in sorted order is equal.
    s = F.col("_sorted")
    again = F.filter(s, lambda w, i: ((i > 0) & (F.get(s, i - 1)["w"] == w["w"]))
                     | F.coalesce(F.get(s, i + 1)["w"] == w["w"], F.lit(False)))
    df = df.withColumn("_again", F.array_sort(F.transform(again, lambda w: w["i"]))).drop("_sorted")
    a = F.col("_again")
    # Each repeated window adds the words up to the next repeated one, three at most.
    cover = F.transform(a, lambda p, i: F.least(F.coalesce(F.get(a, i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda n, x: n + x)).drop("_again")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rule_flags() -> dict:
    """Column per rule: does a text with measures fail it?"""
    return {"base": F.col("base_failed"),
            "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
            "dup_lines": 3 * F.col("n_dup_lines") > F.col("n_words")}


def host_verdicts(measured: DataFrame, source: str = "source", max_rate: float = 0.5) -> DataFrame:
    """(host, n_texts, <rule>_rate …, host_failed): each host's failure rate by rule, shrunk by
    a beta prior fitted to all hosts.

    The prior of a rule has the mean and, by moments, the spread of the hosts' rates (each host
    one observation); without spread it weighs as much as all texts of a mean host. A host
    fails when the shrunk rate of any rule exceeds ``max_rate``. NULL is a host of its own.
    ``host`` is ``key_of(source)``."""
    flags = rule_flags()
    hosts = stage(measured.groupBy(key_of(F.col(source)).alias("host")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[F.sum(f.cast("long")).alias(f"{r}_failed") for r, f in flags.items()]), "hosts")
    rate = {r: F.col(f"{r}_failed") / F.col("n_texts") for r in flags}
    priors = hosts.agg(F.avg("n_texts").alias("_n"),
                       *[F.avg(x).alias(f"_{r}_mean") for r, x in rate.items()],
                       *[F.var_pop(x).alias(f"_{r}_var") for r, x in rate.items()]).first()
    shrunk = {}
    for r in flags:
        mean, var = priors[f"_{r}_mean"] or 0.0, priors[f"_{r}_var"] or 0.0
        strength = mean * (1 - mean) / var - 1 if var > 0 else priors["_n"] or 1.0
        strength = max(strength, 1.0)
        shrunk[f"{r}_rate"] = (F.col(f"{r}_failed") + mean * strength) / (F.col("n_texts") + strength)
    df = hosts.select("host", "n_texts", *[x.alias(n) for n, x in shrunk.items()])
    failed = F.lit(False)
    for n in shrunk:
        failed = failed | (F.col(n) > max_rate)
    return df.withColumn("host_failed", failed)


def judge(strips: DataFrame, text: str = "text", source: str = "source", max_rate: float = 0.5,
          carry: tuple[str, ...] | None = None) -> DataFrame:
    """Strip transcripts with their measures, their host's rates and ``kept``: false where the
    text itself fails the base rules, else false where its host fails.

    ``carry``: input columns to return (default all). An input column named like a result is
    replaced. Empty table: no rows. Repeated rows are judged each, and count each. The
    measured rows are written once and read twice: for the hosts, and for the join with their
    verdicts, which are broadcast only when few enough by count."""
    keep = [c for c in (strips.columns if carry is None else carry)]
    measured = text_measures(strips.select(*dict.fromkeys([*keep, text, source])), text)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = [c for c in keep if c.lower() not in {*made, "kept", "host_failed", "n_texts", *[f"{r}_rate" for r in RULES]}]
    measured = stage(measured.select(*dict.fromkeys([*keep, source, *made])), "measured")
    verdicts = small(stage(host_verdicts(measured, source, max_rate), "verdicts"))
    return (measured.withColumn("host", key_of(F.col(source))).join(verdicts, "host")
            .select(*keep, *made, "n_texts", *[f"{r}_rate" for r in RULES], "host_failed",
                    (~F.col("base_failed") & ~F.col("host_failed")).alias("kept")))
