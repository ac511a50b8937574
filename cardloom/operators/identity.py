"""Identity: the name/number decision ladder, page second pass, answer reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.operators import fuzzy, resolve
from cardloom.plans.session import stage

#: Values that rows without a key are dealt out by.
SALT = 4096


def _promo(sets: DataFrame) -> DataFrame:
    return (sets.filter(F.col("promo_prefix").isNotNull())
            .select(F.upper("promo_prefix").alias("__pre"), F.col("catalog_id").alias("promo_set"),
                    "promo_prefix", "local_id_prefixed").dropDuplicates(["__pre"]))


def _names(cells: DataFrame, lines: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """First matching title line of each cell, and its top line (``top_text``)."""
    asked = lines.join(cells.select(key, F.col("den").alias("denominator")), key)
    questions = stage(asked.select("text", "denominator").distinct(), "names")
    hits = stage(fuzzy.match_name(questions, catalog), "matches")
    d = F.coalesce("denominator", F.lit("")).alias("__d")
    m = asked.select("*", d).drop("denominator").join(hits.select("*", d).drop("denominator", "q"), ["text", "__d"])
    cols = ["key", "score", "set_id", "local_id", "card_name", "ambiguous"]
    first = m.groupBy(key).agg(F.min_by(F.struct(*cols), "rank").alias("m"))
    top = lines.groupBy(key).agg(F.min_by("text", "rank").alias("top_text"))
    return cells.join(first, key, "left").join(top, key, "left")


def with_names(cells: DataFrame, lines: DataFrame, catalog: DataFrame, sets: DataFrame,
               key: str = "cell_id") -> DataFrame:
    """Adds ``m`` (the matched name after the set-scoped retry), ``den``, ``num`` and the
    promo columns to cells.

    ``cells``: key, numerator, denominator, prefix, bare, prior_set (catalog id space in
    ``prior_catalog``), prior_denominator; ``lines``: key, rank, text, best first."""
    c = (cells.withColumns({"den": F.coalesce("denominator", "prior_denominator"),
                            "num": F.when(F.col("numerator").isNotNull(), N.normalize_local_id(F.col("numerator"))),
                            "__pre": F.when(~F.col("bare"), F.upper("prefix"))})
         .join(_promo(sets), "__pre", "left").drop("__pre"))
    c = stage(_names(c, lines, catalog, key), "named")
    retry = (F.col("m").isNull() | F.col("m.ambiguous")) & F.col("top_text").isNotNull()
    questions = c.filter(retry).select(F.col("top_text").alias("text"), F.coalesce("prior_catalog", "promo_set").alias("set_id"),
                                       F.col("den").alias("denominator")).distinct()
    scoped = stage(fuzzy.match_name_in_set(stage(questions, "scoped"), catalog).filter("NOT ambiguous"), "scoped")
    blank = F.lit("")
    s = scoped.select(F.col("text").alias("top_text"), F.coalesce("set_id", blank).alias("__s"),
                      F.coalesce("denominator", blank).alias("__d"),
                      F.struct(F.col("key"), F.col("score"), F.col("scope").alias("set_id"), "local_id", "card_name",
                               F.lit(False).alias("ambiguous")).alias("scoped"))
    c = (c.withColumns({"__s": F.coalesce("prior_catalog", "promo_set", blank), "__d": F.coalesce("den", blank)})
         .join(s, ["top_text", "__s", "__d"], "left").drop("__s", "__d"))
    by_promo = F.col("promo_set").isNotNull() & F.col("prior_catalog").isNull()
    agrees = resolve.number_agrees(F.col("scoped.local_id"), F.col("scoped.set_id"), F.col("numerator"),
                                   F.col("promo_set"), F.col("promo_prefix"), F.col("local_id_prefixed"))
    adopt = retry & F.col("scoped").isNotNull() & (~by_promo | (F.col("num").isNotNull() & agrees))
    return c.withColumn("m", F.when(adopt, F.col("scoped")).otherwise(F.col("m"))).drop("scoped")


def resolve_identity(cells: DataFrame, lines: DataFrame, catalog: DataFrame, sets: DataFrame,
                     numerators: DataFrame, cards: DataFrame, key: str = "cell_id") -> DataFrame:
    """The decision ladder, one row per cell.

    1 name and number agree; 2 unique name not vetoed by a known denominator or a promo
    prefix; 3 number valid in the prior's set (never for bare digits); else unresolved
    with the reason of the stage that failed. Bare digits only ever confirm a name.

    ``numerators``: set_id, numerator; ``cards``: set_id, numerator, name (cached cards,
    one per key)."""
    c = with_names(cells, lines, catalog, sets, key)
    dens = catalog.select("official_count", F.col("set_id").alias("__ms"), F.lit(True).alias("__in")).distinct()
    c = (c.withColumns({"__ms": F.col("m.set_id"),
                        "official_count": F.when(F.col("denominator").rlike(r"^\d+$"), F.col("denominator").try_cast("int"))})
         .join(dens.select("official_count", F.lit(True).alias("__known")).distinct(), "official_count", "left")
         .join(dens, ["official_count", "__ms"], "left"))
    valid = numerators.select(F.col("set_id").alias("prior_set"), F.col("numerator").alias("num"), F.lit(True).alias("__valid"))
    c = c.join(valid, ["prior_set", "num"], "left")
    agrees = resolve.number_agrees(F.col("m.local_id"), F.col("m.set_id"), F.col("numerator"), F.col("promo_set"),
                                   F.col("promo_prefix"), F.col("local_id_prefixed"))
    veto = (F.col("__known").isNotNull() & F.col("__in").isNull()) | F.col("promo_set").isNotNull()
    has_m, has_n = F.col("m").isNotNull(), F.col("num").isNotNull()
    rung = (F.when(has_m & has_n & agrees, "name_number")
            .when(has_m & ~F.coalesce(F.col("m.ambiguous"), F.lit(True)) & ~veto, "unique_name")
            .when(F.col("has_reading") & ~F.col("bare") & F.col("__valid").isNotNull(), "number_in_prior")
            .otherwise("unresolved"))
    c = c.withColumns({"rung": rung, "__agrees": agrees})
    own = N.normalize_local_id(F.col("m.local_id"))
    number = (F.when(F.col("rung") == "unique_name",
                     F.when(F.col("bare") & ~F.col("__agrees"), own).otherwise(F.coalesce("num", own)))
              .when((F.col("rung") == "unresolved") & F.col("bare"), None).otherwise(F.col("num")))
    by_name = F.col("rung").isin("name_number", "unique_name")
    back = sets.groupBy("catalog_id").agg(F.min("set_id").alias("__src"))
    titles = sets.select("set_id", "set_name")
    c = (c.withColumn("number", number)
         .join(back.withColumnRenamed("catalog_id", "__ms"), "__ms", "left")
         .withColumns({"set_code": F.when(by_name, F.col("m.set_id")),
                       "set_id": F.when(by_name, F.col("__src")).when(F.col("rung") == "number_in_prior", F.col("prior_set"))})
         .join(titles, "set_id", "left")
         .join(cards.select("set_id", F.col("numerator").alias("number"), F.col("name").alias("__looked")),
               ["set_id", "number"], "left"))
    confident = F.col("rung") != "unresolved"
    name = F.coalesce("__looked", "m.card_name")
    reason = (F.when(confident, None).when(~F.col("has_reading") | F.col("bare"), "number_ambiguous")
              .otherwise("set_ambiguous"))
    return c.select(
        key, "rung", confident.alias("confident"), "number",
        F.when(F.col("number").isNotNull(), N.identity_display_number(F.col("number"), F.col("den"))).alias("display_number"),
        "set_id", "set_code", F.when(confident, F.col("set_name")).alias("set_name"), name.alias("name"),
        reason.alias("reason"), F.col("m.score").alias("name_score"),
        S.live_identity_key(F.col("set_code"), F.when(confident, F.col("set_name")), F.col("number"), name).alias("identity_key"))


def apply_page_prior(cells: DataFrame, first: DataFrame, lines: DataFrame, page_priors: DataFrame,
                     catalog: DataFrame, sets: DataFrame, numerators: DataFrame, cards: DataFrame,
                     key: str = "cell_id", page: str = "page_id") -> DataFrame:
    """Second pass with each page's elected set as the prior.

    Only flagged cells that read a non-bare number, do not contradict the page's set and
    do not contradict themselves are run again; a result replaces the first one only if
    it is an improvement and, when confident, named. ``rescued`` marks them."""
    prior = page_priors.join(sets.select("set_id", F.col("catalog_id").alias("__pc")), "set_id").select(
        page, F.col("set_id").alias("__ps"), F.col("denominator").alias("__pd"), "__pc")
    todo = (cells.join(first.filter("NOT confident").select(key), key, "left_semi")
            .filter(F.col("has_reading") & F.col("numerator").isNotNull() & ~F.col("bare"))
            .join(prior, page)
            .withColumns({"prior_set": F.col("__ps"), "prior_denominator": F.col("__pd"), "prior_catalog": F.col("__pc")})
            .drop("__ps", "__pd", "__pc"))
    todo = stage(resolve.prior_denominator_ok(todo, sets).filter("prior_ok").drop("prior_ok"), "todo")
    lines = stage(lines.join(todo.select(key), key, "left_semi"), "lines")
    named = with_names(todo, lines, catalog, sets, key).select(
        key, F.col("m.key").alias("key"), F.col("den").alias("denominator"), "numerator")
    sound = fuzzy.name_contradicts_number(named, catalog).filter("NOT contradicts").select(key)
    todo = stage(todo.join(sound, key, "left_semi"), "todo")
    second = resolve_identity(todo, lines, catalog, sets, numerators, cards, key)
    cols = [c for c in first.columns if c != key]
    new = second.select(key, F.struct(*cols).alias("__new"))
    old_set, new_set = F.coalesce("set_id", "set_name"), F.coalesce("__new.set_id", "__new.set_name")
    better = F.when(F.col("__new.confident"), ~F.col("confident") & (F.coalesce("__new.name", F.lit("")) != "")) \
              .otherwise(new_set.isNotNull() & old_set.isNull())
    j = first.join(new, key, "left").withColumn("rescued", F.coalesce(better, F.lit(False)))
    return j.select(key, *[F.when(F.col("rescued"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in cols],
                    "rescued")


def fuse_art_and_text(cards: DataFrame, art: DataFrame) -> DataFrame:
    """An accepted art hit overrides the text reading. ``cards``: card_id, shown_number,
    confidence, reason, needs_review; ``art``: card_id, score, art_number, match_id."""
    j = cards.join(art.select("card_id", "score", "art_number", F.col("match_id").alias("__art")), "card_id", "left")

    def head(c):
        return N.strip_zeros(F.split_part(c, F.lit("/"), F.lit(1)))

    hit, read = F.col("__art").isNotNull(), N.blank_to_null(F.col("shown_number"))
    agrees = F.coalesce(read.isNotNull() & (head(read) == head(F.coalesce("art_number", F.lit("")))), F.lit(False))
    conf = F.round(F.when(agrees, 0.97).otherwise(F.greatest(F.lit(0.9) * F.col("score"), F.lit(0.75))), 3)
    reason = F.when(~agrees & read.isNotNull(), "art_ocr_disagree")
    return j.select("card_id",
                    F.when(hit, F.coalesce(N.blank_to_null(F.col("art_number")), read)).otherwise(F.col("shown_number")).alias("number"),
                    F.when(hit, conf).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(hit, reason).otherwise(F.col("reason")).alias("reason"),
                    F.when(hit, reason.isNotNull()).otherwise(F.col("needs_review")).alias("needs_review"),
                    F.col("__art").alias("match_id"))


def reconcile_answer(cards: DataFrame, answers: DataFrame, catalog: DataFrame, sets: DataFrame,
                     lookup: DataFrame, accept: float = 0.7, name_floor: float = 75.0) -> DataFrame:
    """Merge third-party answers into cards, name first.

    ``cards``: card_id, set_id, set_code, set_name, name, card_number, confidence,
    needs_review, texts (array or NULL); ``answers``: card_id, number, denominator,
    answer_set, answer_name, answer_conf; ``catalog``: set_id (catalog id), set_name,
    local_id, name, official_count; ``lookup``: set_id, numerator, name.

    * The claimed name selects printings: exact key, else an unambiguous fuzzy one. A
      claimed denominator keeps the printings of that count; when it contradicts all of
      them an exact name discards it (then the answer may only be displayed) and a fuzzy
      name is abandoned.
    * One printing left is the identity; several in one set are told apart by the
      claimed number, else name and set are displayed only.
    * Without a name identity the number leads: set by answered name, else by unique
      denominator, then a keyed lookup. If the looked-up name disagrees with the claimed
      name the merge is rolled back.
    """
    a = stage(answers.withColumns({
        "num": F.coalesce(F.trim(F.split_part("number", F.lit("/"), F.lit(1))), F.lit("")),
        "claim": F.trim(F.coalesce("answer_name", F.lit("")))}), "answers")
    printing = catalog.filter(F.col("name").isNotNull()).withColumn("akey", S.normalize_name(F.col("name")))
    keys = printing.select("akey").distinct().withColumn("exact", F.lit(True))
    # Names are looked up per distinct question, not per answer.
    question = ["claim", "denominator", "num"]
    named = (a.filter("claim <> ''").select(*question).distinct()
             .withColumn("akey", S.normalize_name(F.col("claim"))).join(keys, "akey", "left"))
    named = stage(named, "claims")
    near = stage(fuzzy.match_name(stage(named.filter("exact IS NULL").select(
        F.col("claim").alias("text"), "denominator").distinct(), "near"), catalog).filter("NOT ambiguous"), "near")
    blank = F.lit("")
    named = (named.withColumn("__d", F.coalesce("denominator", blank))
             .join(near.select(F.col("text").alias("claim"), F.coalesce("denominator", blank).alias("__d"),
                               F.col("key").alias("__near")), ["claim", "__d"], "left").drop("__d"))
    named = named.withColumns({"exact": F.col("exact").isNotNull(),
                               "ckey": F.when(F.col("exact").isNotNull(), F.col("akey")).otherwise(F.col("__near"))})

    # printings per distinct question, reduced to counts and first rows
    named = stage(named, "claims")
    ask = named.filter("ckey IS NOT NULL").select("ckey", "denominator", "num", "exact").distinct()
    den = F.when(F.col("denominator").rlike(r"^\d+$"), F.col("denominator").try_cast("int"))
    p = printing.select(F.col("akey").alias("ckey"), F.struct("set_id", "local_id", "set_name", "name").alias("row"),
                        "official_count")
    q = ask.join(p, "ckey").withColumn("__den", den)
    same = F.coalesce(F.col("official_count") == F.col("__den"), F.lit(False))
    claim_no = F.upper(F.coalesce(N.blank_to_null(N.strip_zeros(F.col("num"))), "num"))
    row_no = F.upper(F.coalesce(N.blank_to_null(N.strip_zeros(F.col("row.local_id"))), "row.local_id"))
    q = q.withColumns({"same": same, "hit": row_no == claim_no,
                       "against": F.coalesce(F.col("official_count") != F.col("__den"), F.lit(False)),
                       "counted": F.coalesce(F.col("official_count") > 0, F.lit(False))})
    g = q.groupBy("ckey", "denominator", "num", "exact").agg(
        F.count_if("same").alias("n_same"), (F.count_if("against") == F.count(F.lit(1))).alias("all_against"),
        *[f for tag, cond in (("same", F.col("same")), ("counted", F.col("counted")), ("all", F.lit(True))) for f in (
            F.count_if(cond).alias(f"n_{tag}_"), F.min(F.when(cond, F.col("row"))).alias(f"f_{tag}"),
            F.min(F.when(cond, F.col("row.set_id"))).alias(f"lo_{tag}"), F.max(F.when(cond, F.col("row.set_id"))).alias(f"hi_{tag}"),
            F.count_if(cond & F.col("hit")).alias(f"h_{tag}"), F.min(F.when(cond & F.col("hit"), F.col("row"))).alias(f"v_{tag}"))])
    discarded = (F.col("n_same") == 0) & F.col("all_against")
    pool = (F.when(F.col("n_same") > 0, "same").when(discarded & ~F.col("exact"), "none")
            .when(discarded & (F.col("n_counted_") > 0), "counted").otherwise("all"))
    g = g.withColumns({"pool": pool, "discarded": discarded & F.col("exact")})

    def of(prefix, null):
        return (F.when(F.col("pool") == "same", F.col(f"{prefix}same")).when(F.col("pool") == "counted", F.col(f"{prefix}counted"))
                .when(F.col("pool") == "all", F.col(f"{prefix}all")).otherwise(null))

    one_set = of("lo_", F.lit(None)) == of("hi_", F.lit(None))
    n = F.when(F.col("pool") == "same", F.col("n_same_")).when(F.col("pool") == "counted", F.col("n_counted_")) \
         .when(F.col("pool") == "all", F.col("n_all_")).otherwise(0)
    first, variant, hits = of("f_", F.lit(None)), of("v_", F.lit(None)), of("h_", F.lit(0))
    sole = ~F.col("discarded") & (n == 1)
    told = ~F.col("discarded") & (n > 1) & one_set & (hits == 1)
    g = g.select("ckey", "denominator", "num", "exact",
                 F.when(sole, first).when(told, variant).alias("m"),
                 F.when(~sole & ~told & (n > 0) & one_set, first).alias("shown"))
    d = F.coalesce("denominator", blank).alias("__d")
    picked = named.select(*question, "ckey", "exact", d).join(
        g.select("ckey", "num", "exact", "m", "shown", d), ["ckey", "num", "exact", "__d"])
    picked = stage(picked.select(
        F.col("claim").alias("__claim"), F.col("denominator").alias("__den"), F.col("num").alias("__num"), "m", "shown"), "picked")
    asked = a.filter("claim <> ''").select("card_id", *question)
    picks = asked.join(picked, (F.col("claim") == F.col("__claim")) & (F.col("num") == F.col("__num"))
                       & F.col("denominator").eqNullSafe(F.col("__den"))).select("card_id", "m", "shown")

    # The lookups by set, title and number are written first, so that the planner knows how small they are: cards without a
    # set or a title share one key, and a shuffle by it would send them all to one task.
    back = stage(sets.groupBy(F.coalesce("catalog_id", "set_code").alias("__cat")).agg(
        F.min(F.struct("set_id", "set_code", F.get("denominators", F.lit(0)).alias("d"))).alias("entry")), "back")
    c = cards.join(a, "card_id").join(picks, "card_id", "left")
    c = c.withColumn("__cat", F.coalesce("m.set_id", "shown.set_id")).join(back, "__cat", "left")

    # number-first: set by answered name (exact, then containment), else by unique denominator
    asked_sets = a.select(F.lower("answer_set").alias("__as")).filter("__as <> ''").distinct()
    title = sets.select(F.lower("set_name").alias("__n"), F.struct("set_id", "set_code", "set_name").alias("e"))
    grams = title.select("__n", "e", F.explode(S.short_grams(F.col("__n"))).alias("__g"))
    inner = asked_sets.withColumn("__g", F.substring("__as", 1, 3)).join(grams, "__g").filter(F.contains("__n", F.col("__as")))
    outer = (asked_sets.withColumn("__g", F.explode(S.short_grams(F.col("__as"))))
             .join(title.withColumn("__g", F.substring("__n", 1, 3)), "__g").filter(F.contains("__as", F.col("__n"))))
    by_title = (inner.select("__as", "__n", "e").unionByName(outer.select("__as", "__n", "e"))
                .groupBy("__as").agg(F.min(F.struct((F.col("__as") != F.col("__n")).alias("o"), "e")).alias("b"))
                .select(F.col("__as").alias("__aset"), F.col("b.e").alias("by_title")))
    by_den = (sets.select(F.explode("denominators").alias("__den"), F.struct("set_id", "set_code", "set_name").alias("e"))
              .groupBy("__den").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("by_den")).filter("n = 1").drop("n"))
    # the table is keyed by printed denominators; both sides are compared zero-stripped
    bare = F.coalesce(N.blank_to_null(N.strip_zeros(F.col("__den"))), F.lit("0"))
    by_title, by_den = stage(by_title, "titles"), stage(by_den.withColumn("__den", bare), "owners")
    c = (c.withColumns({"__aset": F.lower("answer_set"),
                        "__den": F.coalesce(N.blank_to_null(N.strip_zeros(F.col("denominator"))), F.when(F.col("denominator").isNotNull(), F.lit("0")))})
         .join(by_title, "__aset", "left").join(by_den, "__den", "left"))
    resolved, shown = F.col("m").isNotNull(), F.col("m").isNull() & F.col("shown").isNotNull()
    number_first = ~resolved & ~shown
    old = F.struct("set_id", "set_code", "set_name")
    base = F.when(resolved | shown, F.struct(
        F.col("entry.set_id").alias("set_id"), F.coalesce("entry.set_code", "__cat").alias("set_code"),
        F.coalesce("m.set_name", "shown.set_name").alias("set_name"))).otherwise(
        F.coalesce("by_title", F.when(F.col("set_id").isNull() | F.col("set_name").isNull(), F.col("by_den")), old))
    display_den = F.coalesce("entry.d", "denominator")
    claimed = F.col("number").isNotNull() & (F.col("num") != "")
    c = c.withColumns({
        "resolved": resolved, "shown_only": shown,
        "usable": claimed | resolved,
        "new_set": F.when(number_first & ~claimed, old).otherwise(base),
        "use_num": F.when(resolved, F.coalesce(N.blank_to_null(N.strip_zeros(F.col("m.local_id"))), "m.local_id")).otherwise(F.col("num")),
        "new_number": F.when(resolved, F.when(display_den.isNotNull(), F.concat("m.local_id", F.lit("/"), display_den)).otherwise(F.col("m.local_id")))
        .when(shown | ~claimed, F.col("card_number"))
        .when(F.col("denominator").isNotNull(), F.concat("num", F.lit("/"), "denominator")).otherwise(F.col("num"))})
    fetched = lookup.select(F.col("set_id").alias("__ls"), N.normalize_numerator(F.col("numerator")).alias("__ln"), F.col("name").alias("looked"))
    tail = (catalog.filter(F.col("name").isNotNull()).join(
        sets.select(F.coalesce("catalog_id", "set_code").alias("__c"), F.col("set_id").alias("__ls")), F.col("set_id") == F.col("__c"))
        .withColumn("__ln", N.normalize_numerator(F.col("local_id")))
        .groupBy("__ls", "__ln").agg(F.min("name").alias("in_catalog")))
    fetched, tail = stage(fetched, "lookup"), stage(tail, "tail")
    # What is looked up nowhere has no set, which never joins; its number is only there to deal it out.
    keyed = F.col("use_num").rlike(r"^\d+$") & ~F.col("shown_only")
    dealt = F.pmod(F.xxhash64("card_id"), F.lit(SALT)).cast("string")
    c = c.withColumn("__ls", F.when(keyed, F.col("new_set.set_id")))
    c = (c.withColumn("__ln", F.when(F.col("__ls").isNull(), dealt).otherwise(N.normalize_numerator(F.col("use_num"))))
         .join(fetched, ["__ls", "__ln"], "left").join(tail, ["__ls", "__ln"], "left"))
    pre_name = F.when(F.col("resolved"), F.col("m.name")).when(F.col("shown_only"), F.col("shown.name")).otherwise(F.col("name"))
    c = c.withColumn("new_name", F.when(F.col("usable"), F.coalesce("looked", pre_name, F.when(keyed, F.col("in_catalog")))).otherwise(pre_name))
    c = stage(c.select("card_id", "set_id", "set_code", "set_name", "name", "card_number", "confidence", "needs_review", "texts", "answer_conf",
                       "claim", "resolved", "shown_only", "usable", "new_set", "use_num", "new_number", "new_name"), "merged")
    # The names are compared per distinct pair, and only where the comparison can change the outcome.
    both = (F.col("claim") != "") & F.col("new_name").isNotNull() & F.col("usable") & ~F.col("shown_only")
    c = c.withColumns({"__claim": F.when(both, F.col("claim")), "__named": F.when(both, F.col("new_name")).otherwise(dealt)})
    pairs = c.filter("__claim IS NOT NULL").select("__claim", "__named").distinct()
    parts = max(1, int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = stage(pairs, "pairs").repartition(parts)
    alike = fuzzy.composite_score(S.normalize_name(F.col("__claim")), S.normalize_name(F.col("__named"))) >= name_floor
    c = c.join(stage(pairs.withColumn("__alike", alike), "pairs"), ["__claim", "__named"], "left")
    name_ok = F.col("__claim").isNull() | F.col("__alike")
    # Asked last: each line of text is parsed for it.
    seen = F.coalesce(fuzzy.numerator_corroborated(F.col("use_num"), F.col("texts")), F.lit(True))
    corroborated = F.col("resolved") | F.col("texts").isNull() | (F.size("texts") == 0) | seen
    c = c.withColumn("name_ok", name_ok)
    outcome = (F.when(~F.col("usable") & ~F.col("shown_only"), "no_op")
               .when(F.col("usable") & ~F.col("resolved") & ~F.col("name_ok"),
                     F.when(F.col("shown_only"), "display_only").otherwise("rolled_back"))
               .when(F.col("shown_only"), "display_only")
               .when((F.coalesce("answer_conf", F.lit(0.0)) >= accept)
                     & (F.col("new_set.set_id").isNotNull() | (F.col("resolved") & F.col("new_set.set_code").isNotNull()))
                     & F.col("new_name").isNotNull() & F.col("name_ok") & corroborated, "accepted")
               .otherwise("merged_flagged"))
    c = c.withColumn("outcome", outcome)
    keep = F.col("outcome").isin("no_op", "rolled_back")
    ok = F.col("outcome") == "accepted"
    return c.select(
        "card_id", "outcome",
        *[F.when(keep, F.col(x)).otherwise(F.col(f"new_set.{x}")).alias(x) for x in ("set_id", "set_code", "set_name")],
        F.when(keep, F.col("name")).otherwise(F.col("new_name")).alias("name"),
        F.when(keep, F.col("card_number")).otherwise(F.col("new_number")).alias("card_number"),
        F.when(ok, F.greatest("confidence", "answer_conf")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(ok, F.lit(False)).otherwise(F.col("needs_review")).alias("needs_review"))
