"""Resolution of sets and cards against catalogs and crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.plans.session import stage
from cardloom.plans.skew import mode_per, top_k


def valid_source_ids(rows: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the slug is canonical and the id is a positive integer."""
    marked = rows.join(slugs.select("slug").distinct().withColumn("__known", F.lit(True)), "slug", "left")
    reason = F.when(F.col("__known").isNull(), "unknown_slug").when(
        ~F.coalesce(F.col("source_id").rlike(r"^\d+$") & (F.col("source_id").try_cast("bigint") > 0), F.lit(False)),
        "placeholder_id")
    marked = marked.withColumn("reason", reason).drop("__known")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def lookup_exact(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Newest cached card of (set, normalised number); a requested set name must contain
    the card's or be contained in it.

    ``requests``: request_id, set_id, number, set_name; ``cards``: set_id, numerator,
    set_name, match_id, last_fetched. Only the newest card per key meets a request."""
    newest = top_k(cards.withColumn("__num", N.normalize_numerator(F.col("numerator"))),
                   ["set_id", "__num", "set_name"], [F.desc("last_fetched"), "match_id"], 1)
    pairs = requests.withColumnRenamed("set_name", "asked_name") \
        .withColumn("__num", N.normalize_numerator(F.col("number"))).join(newest, ["set_id", "__num"])
    a, b = F.lower("asked_name"), F.lower("set_name")
    fits = F.col("asked_name").isNull() | F.col("set_name").isNull() | F.contains(a, b) | F.contains(b, a)
    hit = pairs.filter(fits).groupBy("request_id").agg(
        F.max_by("match_id", F.struct("last_fetched", "match_id")).alias("match_id"))
    return requests.join(hit, "request_id", "left")


def resolve_set(readings: DataFrame, sets: DataFrame, keys: list[str],
                tiebreak: DataFrame | None = None) -> DataFrame:
    """Prioritised cascade promo prefix, code token, unique denominator, hash tiebreak.

    Readings carry prefix, tokens, denominator. A present but unknown prefix ends the
    cascade unresolved; the first matching token wins. ``tiebreak`` (keys, set_id,
    margin) is the hash winner among the denominator's sets.
    The dimensions are staged and joined without hints; the planner broadcasts what measures small."""
    promo = (sets.filter(F.col("promo_prefix").isNotNull())
             .groupBy(F.upper("promo_prefix").alias("__pre")).agg(F.min("set_id").alias("by_prefix")))
    code = sets.groupBy(F.upper("set_code").alias("__code")).agg(F.min("set_id").alias("by_code"))
    den = (sets.select(F.explode("denominators").alias("d"), "set_id")
           .groupBy(F.upper("d").alias("__den")).agg(F.min("set_id").alias("by_den"),
                                                     F.count_distinct("set_id").alias("owners")))
    # A token list is looked up per distinct list, not per reading.
    lists = (readings.filter(F.col("prefix").isNull()).select("tokens").distinct()
             .select("tokens", F.posexplode("tokens").alias("pos", "tok"))
             .withColumn("__code", F.upper("tok")).join(code, "__code")
             .groupBy("tokens").agg(F.min_by("by_code", "pos").alias("by_code")))
    # Written first, so that the planner knows how small they are before it shuffles the readings to meet them.
    promo, lists, den = stage(promo, "promo"), stage(lists, "lists"), stage(den, "owners")
    j = (readings.withColumns({"__pre": F.upper("prefix"), "__den": F.upper("denominator")})
         .join(promo, "__pre", "left").join(lists, "tokens", "left").join(den, "__den", "left"))
    if tiebreak is not None:
        j = j.join(tiebreak.select(*keys, F.col("set_id").alias("by_hash"), "margin"), keys, "left")
    else:
        j = j.withColumns({"by_hash": F.lit(None).cast("string"), "margin": F.lit(None).cast("int")})
    method = (F.when(F.col("prefix").isNotNull(), F.when(F.col("by_prefix").isNotNull(), "promo_prefix")
                     .otherwise("unresolved"))
              .when(F.col("by_code").isNotNull(), "code_text")
              .when(F.col("owners") == 1, "denominator_unique")
              .when((F.col("owners") > 1) & F.col("by_hash").isNotNull(), "symbol_tiebreak")
              .otherwise("unresolved"))
    j = j.withColumn("method", method)
    pick = (F.when(F.col("method") == "promo_prefix", F.col("by_prefix"))
            .when(F.col("method") == "code_text", F.col("by_code"))
            .when(F.col("method") == "denominator_unique", F.col("by_den"))
            .when(F.col("method") == "symbol_tiebreak", F.col("by_hash")))
    return (j.withColumns({"resolved_set": pick,
                           "margin": F.when(F.col("method") == "symbol_tiebreak", F.col("margin"))})
            .drop("__pre", "__den", "by_prefix", "by_code", "by_den", "owners", "by_hash"))


def map_sets(sets: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, candidates) from the set dimension to catalog sets.

    A unique normalised-name match maps with confidence 1.0, several are ``ambiguous``;
    otherwise exactly one set whose official count is a printed denominator and whose
    name contains ours or is contained in it maps with 0.8; else ``unmapped``."""
    ours = sets.select("set_id", S.set_name_key(F.col("set_name")).alias("__k"), "denominators")
    theirs = catalog.select("catalog_id", S.set_name_key(F.col("name")).alias("__t"), "official_count")
    exact = ours.join(theirs.withColumnRenamed("__t", "__k"), "__k").select("set_id", "catalog_id")
    dens = ours.select("set_id", "__k", F.explode("denominators").alias("d")).select(
        "set_id", "__k", F.regexp_replace("d", r"\D", "").try_cast("int").alias("official_count")).distinct()
    fall = (dens.join(theirs, "official_count")
            .filter(F.contains("__k", F.col("__t")) | F.contains("__t", F.col("__k")))
            .select("set_id", "catalog_id").distinct())
    e = exact.groupBy("set_id").agg(F.count(F.lit(1)).alias("en"), F.min("catalog_id").alias("ec"))
    f = fall.groupBy("set_id").agg(F.count(F.lit(1)).alias("fn"), F.min("catalog_id").alias("fc"))
    status = (F.when(F.col("en") == 1, "name").when(F.col("en") > 1, "ambiguous")
              .when(F.col("fn") == 1, "name+count").otherwise("unmapped"))
    mapping = (sets.select("set_id").join(e, "set_id", "left").join(f, "set_id", "left")
               .withColumn("method", status)
               .select("set_id", "method",
                       F.when(F.col("method") == "name", F.col("ec")).when(F.col("method") == "name+count", F.col("fc"))
                        .alias("catalog_id"),
                       F.when(F.col("method") == "name", 1.0).when(F.col("method") == "name+count", 0.8)
                        .alias("confidence")))
    candidates = exact.withColumn("via", F.lit("name")).unionByName(fall.withColumn("via", F.lit("name+count")))
    return mapping, candidates.join(mapping.filter("catalog_id IS NULL").select("set_id"), "set_id", "left_semi")


def map_cards(cards: DataFrame, set_map: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cached cards to catalog cards through (mapped set, normalised number).

    ``cards``: match_id, set_id, numerator. ``outcome``: mapped / set_unmapped / none /
    ambiguous."""
    local = (catalog.withColumn("__n", N.catalog_tail_id(F.col("local_id")))
             .groupBy("catalog_id", "__n").agg(F.count_distinct("card_id").alias("__hits"),
                                               F.min("card_id").alias("card_id")))
    j = (cards.join(set_map.filter("catalog_id IS NOT NULL").select("set_id", "catalog_id"), "set_id", "left")
         .withColumn("__n", N.catalog_tail_id(F.col("numerator")))
         .join(local, ["catalog_id", "__n"], "left"))
    outcome = (F.when(F.col("catalog_id").isNull(), "set_unmapped").when(F.col("__hits").isNull(), "none")
               .when(F.col("__hits") > 1, "ambiguous").otherwise("mapped"))
    return j.withColumn("outcome", outcome).withColumn(
        "card_id", F.when(F.col("outcome") == "mapped", F.col("card_id"))).drop("__n", "__hits")


def reverse_crosswalk(catalog_ids: DataFrame, set_map: DataFrame) -> DataFrame:
    """Catalog set id to source id (smallest of several); unmapped stays NULL."""
    back = (set_map.filter("catalog_id IS NOT NULL").groupBy("catalog_id")
            .agg(F.min("set_id").alias("source_id")))
    return catalog_ids.join(back, "catalog_id", "left")


def payloads_by_ids(payloads: DataFrame, ids: DataFrame, key: str = "match_id") -> DataFrame:
    return payloads.join(ids.select(key), key, "left_semi")


def art_reference_rows(cards: DataFrame, least: int = 40) -> DataFrame:
    """Rows with an image of each set, and whether the set has enough of them."""
    rows = cards.filter(F.col("image_url").isNotNull())
    n = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("refs"))
    return rows.join(n, "set_id").withColumn("partial", F.col("refs") < least)


def resolve_set_query(queries: DataFrame, sets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Free-text set queries by tier: 1 id or code, 2 folded name, 3 catalog id or name,
    4 unique catalog substring (several = ambiguous, with the names of the first five).

    ``queries``: q. Substrings are found by an equi join on the query's first three
    characters, which any name containing the query must hold."""
    q = queries.select("q").distinct().withColumn("__f", F.lower(F.trim("q")))
    t1 = sets.select(F.explode(F.array(F.lower("set_id"), F.lower("set_code"))).alias("__f"), "set_id")
    t2 = sets.select(F.lower("set_name").alias("__f"), "set_id")
    t3 = catalog.select(F.explode(F.array(F.lower("catalog_id"), F.lower("name"))).alias("__f"),
                        F.col("catalog_id").alias("set_id"))
    exact = [t.join(q, "__f").select("q", "set_id", F.lit(n).alias("tier"))
             for n, t in ((1, t1), (2, t2), (3, t3))]
    name = F.lower("name")
    grams = catalog.select(F.col("catalog_id").alias("set_id"), name.alias("__name"),
                           F.explode(S.short_grams(name)).alias("__g"), F.col("name"))
    sub = (q.filter(F.length("__f") > 0).withColumn("__g", F.substring("__f", 1, 3)).join(grams, "__g")
           .filter(F.contains("__name", F.col("__f"))).select("q", "set_id", F.lit(4).alias("tier"), F.col("name")).distinct())
    shown = (top_k(sub, ["q"], ["name", "set_id"], 5).groupBy("q")
             .agg(F.array_sort(F.collect_list("name")).alias("__shown")))
    sub = sub.drop("name").distinct()
    found = exact[0].unionByName(exact[1]).unionByName(exact[2]).unionByName(sub)
    per = found.groupBy("q", "tier").agg(F.count_distinct("set_id").alias("hits"), F.min("set_id").alias("set_id"))
    best = per.groupBy("q").agg(F.min_by(F.struct("tier", "hits", "set_id"), "tier").alias("b"))
    amb = (F.col("b.tier") == 4) & (F.col("b.hits") > 1)
    return q.select("q").join(best, "q", "left").join(shown, "q", "left").select(
        "q", "b.tier", F.when(~amb, F.col("b.set_id")).alias("set_id"),
        F.when(F.col("b").isNull(), "unknown").when(amb, "ambiguous").otherwise("resolved").alias("outcome"),
        F.when(amb, F.col("b.hits")).alias("candidates"),
        F.when(amb, F.array_join("__shown", "; ")).alias("candidate_names"))


# -- pack and page consensus --------------------------------------------------------

def modal_denominator(readings: DataFrame, group: str = "pull_id") -> DataFrame:
    """The pack's numeric denominator mode when at least max(2, half) agree."""
    dens = readings.filter(F.col("denominator").rlike(r"^\d+$"))
    total = dens.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return (mode_per(dens, [group], "denominator", "row_index").join(total, group)
            .filter(F.col("votes") >= F.greatest(F.lit(2), F.floor((F.col("__n") + 1) / 2)))
            .select(group, F.col("denominator").alias("canonical"), "votes"))


def snap_denominators(readings: DataFrame, canonical: DataFrame, group: str = "pull_id") -> DataFrame:
    """Overwrite differing denominators of non-promo readings; ``fixed`` marks them."""
    j = readings.join(canonical.select(group, "canonical"), group, "left")
    fix = (F.col("prefix").isNull() & F.col("numerator").isNotNull() & F.col("denominator").isNotNull()
           & F.col("canonical").isNotNull() & (F.col("denominator") != F.col("canonical")))
    fix = F.coalesce(fix, F.lit(False))
    return j.withColumn("fixed", fix).withColumn(
        "denominator", F.when(F.col("fixed"), F.col("canonical")).otherwise(F.col("denominator"))).drop("canonical")


def dominant_set_with_catalog(votes: DataFrame, catalog_sets: DataFrame, group: str = "pull_id") -> DataFrame:
    """Best-voted set with a numerator catalog among those holding max(2, half) of all
    votes. ``votes``: group, set_id, row_index."""
    v = votes.filter(F.col("set_id").isNotNull())
    per = v.groupBy(group, "set_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("p"))
    total = per.groupBy(group).agg(F.sum("n").alias("t"))
    ok = (per.join(total, group).filter(F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("t") + 1) / 2)))
          .join(catalog_sets.select("set_id").distinct(), "set_id", "left_semi"))
    return ok.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "set_id")).alias("b")) \
             .select(group, "b.set_id", (-F.col("b.n")).alias("votes"))


def page_modal(cells: DataFrame, sets: DataFrame, group: str = "page_id", least: int = 2) -> DataFrame:
    """Set elected by the page's confident cells: at least ``least`` votes and a strict
    maximum; its denominator only when it has exactly one."""
    votes = (cells.filter(~F.col("needs_review") & F.col("set_id").isNotNull())
             .groupBy(group, "set_id").agg(F.count(F.lit(1)).alias("n")))
    top = votes.groupBy(group).agg(F.max(F.struct("n", "set_id")).alias("b"), F.max("n").alias("m"))
    ties = votes.join(top, group).filter("n = m").groupBy(group).agg(F.count(F.lit(1)).alias("ties"))
    won = top.join(ties, group).filter((F.col("ties") == 1) & (F.col("m") >= least)) \
             .select(group, F.col("b.set_id").alias("set_id"), F.col("m").alias("votes"))
    one = F.when(F.size("denominators") == 1, F.get("denominators", F.lit(0)))
    return won.join(sets.select("set_id", "set_name", one.alias("denominator")), "set_id")


def session_prior(cards: DataFrame, group: str = "session_id") -> DataFrame:
    """Modal (set, name) of ok cards and modal printed denominator per session.
    ``cards``: group, row_index, state, set_id, set_name, card_number."""
    s = mode_per(cards.filter((F.col("state") == "ok") & F.col("set_id").isNotNull())
                 .withColumn("__s", F.struct("set_id", "set_name")), [group], "__s", "row_index")
    d = mode_per(cards.filter(F.contains("card_number", F.lit("/")))
                 .withColumn("denominator", F.split_part("card_number", F.lit("/"), F.lit(2))),
                 [group], "denominator", "row_index")
    return (s.select(group, "__s.set_id", "__s.set_name").join(d.select(group, "denominator"), group, "full"))


def request_hints(modal: DataFrame, sets: DataFrame) -> DataFrame:
    """The pack's modal set name, and its denominator when it has exactly one."""
    one = F.when(F.size("denominators") == 1, F.get("denominators", F.lit(0)))
    return modal.join(sets.select("set_id", F.col("set_name").alias("hint_set"), one.alias("hint_denominator")),
                      "set_id", "left")


# -- catalogs ------------------------------------------------------------------------

def printed_denominators(cards: DataFrame, least: int = 3) -> DataFrame:
    """(set_id, denominator, cards): denominators on at least ``least`` cards of a set."""
    den = F.upper(F.trim(F.split_part("card_number", F.lit("/"), F.lit(2))))
    return (cards.filter(F.contains("card_number", F.lit("/"))).groupBy("set_id", den.alias("denominator"))
            .agg(F.count(F.lit(1)).alias("cards")).filter(F.col("cards") >= least))


def set_numerators(set_map: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct normalised numerators per mapped set; ids of other shapes are dropped."""
    lid = F.upper(F.trim("local_id"))
    num = F.when(lid.rlike(r"^\d+$"), F.coalesce(N.blank_to_null(N.strip_zeros(lid)), F.lit("0"))) \
           .when(lid.rlike(r"^[A-Z]+\d+$"), N.normalize_local_id(F.col("local_id")))
    return (set_map.filter("catalog_id IS NOT NULL").join(catalog, "catalog_id")
            .select("set_id", num.alias("numerator")).filter("numerator IS NOT NULL").distinct())


def denominator_owners(sets: DataFrame) -> DataFrame:
    """(den_key, owners, owner): how many sets print a denominator, compared in
    normalised form, and the set when it is the only one."""
    d = sets.select(F.explode("denominators").alias("d"), "set_id").select(
        N.normalize_local_id(F.col("d")).alias("den_key"), "set_id").distinct()
    return d.groupBy("den_key").agg(F.count(F.lit(1)).alias("owners"), F.min("set_id").alias("__s")) \
            .select("den_key", "owners", F.when(F.col("owners") == 1, F.col("__s")).alias("owner"))


def prior_denominator_ok(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """May a cell take its page's set? ``cells``: prefix, denominator, prior_set.
    No evidence is fine; a prefix must name that set; a denominator must be owned by
    that set alone."""
    promo = (sets.filter(F.col("promo_prefix").isNotNull())
             .groupBy(F.upper("promo_prefix").alias("__pre")).agg(F.min("set_id").alias("__ps")))
    owners = denominator_owners(sets).select(F.col("den_key").alias("__den"), F.col("owner").alias("__os"))
    j = (cells.withColumns({"__pre": F.upper("prefix"),
                            "__den": F.when(F.trim("denominator") != "", N.normalize_local_id(F.col("denominator")))})
         .join(promo, "__pre", "left").join(owners, "__den", "left"))
    ok = (F.when(F.col("prefix").isNotNull(), F.coalesce(F.col("__ps") == F.col("prior_set"), F.lit(False)))
          .when(F.col("__den").isNull(), True)
          .otherwise(F.coalesce(F.col("__os") == F.col("prior_set"), F.lit(False))))
    return j.withColumn("prior_ok", ok).drop("__pre", "__den", "__ps", "__os")


def prefix_audit(sets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per promo set: do the catalog's local ids carry the prefix as declared?"""
    promo = sets.filter(F.col("promo_prefix").isNotNull())
    has = F.startswith(F.upper("local_id"), F.upper("promo_prefix"))
    g = (promo.join(catalog.select("catalog_id", "local_id"), "catalog_id", "left")
         .groupBy("set_id", "promo_prefix", "local_id_prefixed")
         .agg(F.count("local_id").alias("cards"), F.count_if(has).alias("carrying")))
    verdict = (F.when(F.col("cards") == 0, "empty")
               .when((F.col("carrying") * 2 > F.col("cards")) == F.col("local_id_prefixed"), "ok")
               .otherwise("mismatch"))
    return g.withColumn("verdict", verdict)


def build_name_index(catalog: DataFrame) -> DataFrame:
    """Inverted index in long form: name key, printings by (set, local id), rank among
    them and their count. Rows without a name are skipped."""
    rows = catalog.filter(F.col("name").isNotNull()).withColumn("name_key", S.normalize_name(F.col("name")))
    n = rows.groupBy("name_key").agg(F.count(F.lit(1)).alias("printings"),
                                     F.min(F.struct("set_id", "local_id")).alias("first"))
    return rows.join(n, "name_key").select(
        "name_key", "set_id", "local_id", "name", "official_count", "printings",
        (F.struct("set_id", "local_id") == F.col("first")).alias("is_first"))


def catalog_order(local_id: Column) -> list[Column]:
    """Natural order of catalog ids: alpha prefix, integer tail, text."""
    shape = r"^([A-Za-z]*)0*(\d+)"
    has = local_id.rlike(shape)
    return [F.when(has, F.upper(F.regexp_extract(local_id, shape, 1))).otherwise(local_id),
            F.when(has, F.regexp_extract(local_id, shape, 2).try_cast("bigint")).otherwise(0), local_id]


def missing_keys(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(seen.select(key), key, "left_anti")


def correct_numerators(readings: DataFrame, valid: DataFrame) -> DataFrame:
    """Numerators missing from their set's catalog move to the unique catalog number one
    same-length substitution away. ``readings``: set_id, numerator, prefix, ...;
    ``valid``: set_id, numerator. Promos and letters are left alone.

    Both sides are keyed by the number with one position blanked, over distinct numbers
    only: an equi join, no pairwise scan."""
    usable = F.col("prefix").isNull() & F.col("numerator").rlike(r"^\d+$")
    num = F.when(usable, F.coalesce(N.blank_to_null(N.strip_zeros(F.col("numerator"))), F.lit("0")))
    r = readings.withColumn("__num", num)
    asked = r.filter("__num IS NOT NULL AND set_id IS NOT NULL").select("set_id", "__num").distinct()
    known = valid.select("set_id", F.col("numerator").alias("__num"))
    wrong = asked.join(known, ["set_id", "__num"], "left_anti")

    def blanked(df, column):
        return (df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.length(column))))
                .withColumn("__w", F.overlay(column, F.lit("*"), F.col("__i"))))

    fixes = (blanked(wrong, "__num").join(
        blanked(known.withColumnRenamed("__num", "__v"), "__v").select("set_id", "__w", "__v"), ["set_id", "__w"])
        .groupBy("set_id", "__num").agg(F.count_distinct("__v").alias("__n"), F.min("__v").alias("__fix"))
        .filter("__n = 1").drop("__n"))
    out = r.join(fixes, ["set_id", "__num"], "left")
    return (out.withColumn("corrected", F.col("__fix").isNotNull())
               .withColumn("numerator", F.coalesce("__fix", "numerator")).drop("__num", "__fix"))


def needs_review(readings: DataFrame, modal: DataFrame, numerators: DataFrame, sets: DataFrame,
                 group: str = "pull_id") -> DataFrame:
    """Unreadable or unresolved, or a digit numerator outside the modal set's catalog.

    ``readings``: group, pattern_ok, numerator, prefix, resolved_set; ``modal``: group,
    set_id (a set with a catalog). The numerator takes the set's local-id form only when
    the read prefix and the set's agree. Packs without a catalog are not checked."""
    dim = sets.select("set_id", "promo_prefix", "local_id_prefixed")
    m = modal.select(group, "set_id").join(dim, "set_id", "left").withColumnRenamed("set_id", "__ms")
    j = readings.join(m, group, "left")
    pre = F.upper(F.coalesce("prefix", F.lit("")))
    same = pre == F.upper(F.coalesce("promo_prefix", F.lit("")))
    lid = N.catalog_local_id(F.concat(pre, "numerator"), F.when(same, F.col("promo_prefix")),
                             F.when(same, F.col("local_id_prefixed")))
    j = j.withColumn("__n", N.normalize_local_id(lid)).join(
        numerators.select(F.col("set_id").alias("__ms"), F.col("numerator").alias("__n"),
                          F.lit(True).alias("__hit")), ["__ms", "__n"], "left")
    bad = (F.when(~F.col("pattern_ok") | F.col("resolved_set").isNull(), True)
           .when(F.col("__ms").isNotNull() & F.col("numerator").rlike(r"^\d+$"), F.col("__hit").isNull())
           .otherwise(False))
    return j.withColumn("needs_review", bad).drop("__ms", "__n", "__hit", "promo_prefix", "local_id_prefixed")


def number_agrees(local_id: Column, matched_set: Column, numerator: Column, promo_set: Column,
                  promo_prefix: Column, prefixed: Column) -> Column:
    """Is the matched printing at the read number? A promo read must name the same set
    and is compared in that set's form."""
    printed = N.normalize_local_id(local_id)
    plain = printed == N.normalize_local_id(numerator)
    promo = (matched_set == promo_set) & (
        printed == N.normalize_local_id(N.catalog_local_id(numerator, promo_prefix, prefixed)))
    return F.coalesce(F.when(promo_set.isNull(), plain).otherwise(promo), F.lit(False))


# -- confidence ------------------------------------------------------------------------

# Confidence of each way of resolving a set.
METHOD_SCORES = {"promo_prefix": 1.0, "code_text": 1.0, "denominator_unique": 0.95, "unresolved": 0.0}


def score_card(pattern_ok: Column, blank: Column, ocr: Column, method: Column, margin: Column,
               matched: Column, threshold: float = 0.80) -> Column:
    """STRUCT(confidence, reason): half reading, 0.3 set, 0.2 match; reasons in order."""
    table = F.create_map(*[F.lit(x) for kv in METHOD_SCORES.items() for x in kv])
    tie = 0.5 + 0.4 * F.least(F.lit(1.0), F.coalesce(margin, F.lit(0)) / 8.0)
    s = F.when(method == "symbol_tiebreak", tie).otherwise(F.coalesce(F.try_element_at(table, method), F.lit(0.0)))
    raw = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * ocr + 0.3 * s + F.when(matched, 0.2).otherwise(0.0))), 3)
    conf = F.when(blank, 0.0).when(~pattern_ok, 0.05).otherwise(raw)
    reason = (F.when(blank, "unreadable_strip").when(~pattern_ok, "number_ambiguous")
              .when(raw >= threshold, None).when(method == "unresolved", "set_ambiguous")
              .when(~matched, "no_db_match").when(ocr < 0.6, "number_ambiguous").otherwise("set_ambiguous"))
    return F.struct(conf.alias("confidence"), reason.alias("reason"))


def pack_confidence(cards: DataFrame, packs: DataFrame, group: str = "pull_id", digits: int = 3) -> DataFrame:
    """Mean card confidence, 0 for a pack without cards."""
    mean = cards.groupBy(group).agg(F.round(F.avg("confidence"), digits).alias("m"))
    return packs.select(group).join(mean, group, "left").select(
        group, F.coalesce("m", F.lit(0.0)).alias("pack_confidence"))


def collapse_duplicate_claims(answers: DataFrame, batch: str = "batch_id", least: int = 3) -> DataFrame:
    """A (number, denominator) claimed by ``least`` or more rows of a batch loses its
    confidence. Counts are pre-aggregated and joined null-safely."""
    num = F.when(N.blank_to_null(F.col("number")).isNotNull(),
                 F.trim(F.split_part("number", F.lit("/"), F.lit(1))))
    a = answers.withColumns({"__n": num, "__d": F.coalesce(F.col("denominator"), F.lit("\u0000"))})
    dup = (a.filter("__n IS NOT NULL").groupBy(batch, "__n", "__d").agg(F.count(F.lit(1)).alias("claims"))
           .filter(F.col("claims") >= least))
    return (a.join(dup, [batch, "__n", "__d"], "left")
            .withColumn("confidence", F.when(F.col("claims").isNotNull(), 0.0).otherwise(F.col("confidence")))
            .drop("__n", "__d", "claims"))
