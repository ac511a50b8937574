"""Fuzzy name matching: lossless blocking, then scoring.

The default score is token-aware and made of edit scores, 100 * (1 - levenshtein / longer
length), of whole strings, of token forms, and of a short string against its best window in a long one. For a floor ``s`` a pair of strings can only pass if its edit distance is at most ``(1 - s/100)`` of the longer length, so a
key cut into (that many + 1) segments must share one segment, nearly in place, with the
query. The join is on (key length, segment number, segment text): an equi join that
loses no pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.plans.session import stage
from cardloom.plans.skew import top_k


def edit_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(
        F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest))


#: Weight of the two token forms against the plain one; weight of the aligned score, the least and largest ratio of
#: lengths at which it counts, and the weight beyond.
TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT, PARTIAL_FROM, PARTIAL_UPTO, FAR_WEIGHT = 0.9, 1.5, 8.0, 0.6
#: Distinct tokens up to which all splits of a name are filed, and characters of the grams of the window index.
SPLIT_TOKENS, GRAM = 6, 3


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _sorted_text(c: Column) -> Column:
    return F.array_join(F.sort_array(_tokens(c)), " ")


def _distinct_tokens(c: Column) -> Column:
    return F.sort_array(F.array_distinct(_tokens(c)))


def aligned_score(a: Column, b: Column) -> Column:
    """The best edit score of the shorter string against the windows of its length in the longer one."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    m, n = F.length(short), F.length(long)
    edits = F.array_min(F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.levenshtein(short, F.substr(long, i, m))))
    return F.when(m == 0, 0.0).otherwise(F.lit(100.0) * (F.lit(1.0) - edits / m))


def composite_score(a: Column, b: Column) -> Column:
    """Token-aware score, all built-in: the best of the plain edit score; at 0.95, the edit
    scores of the sorted tokens and of the token sets (shared tokens first, then the rest; and
    the shared tokens alone against each side), so an extra word or swapped words cost little; and, where one
    string is at least 1.5 times as long, at 0.9 (0.6 beyond eight times) the aligned score."""
    da, db = _distinct_tokens(a), _distinct_tokens(b)
    shared = F.array_join(F.array_intersect(da, db), " ")
    left = F.trim(F.concat(shared, F.lit(" "), F.array_join(F.array_except(da, db), " ")))
    right = F.trim(F.concat(shared, F.lit(" "), F.array_join(F.array_except(db, da), " ")))
    token_set = F.when(shared == "", edit_score(left, right)).otherwise(
        F.greatest(edit_score(left, right), edit_score(shared, left), edit_score(shared, right)))
    whole = F.greatest(edit_score(a, b), TOKEN_WEIGHT * edit_score(_sorted_text(a), _sorted_text(b)), TOKEN_WEIGHT * token_set)
    least, most = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    counts = (least > 0) & (most >= PARTIAL_FROM * least)
    partial = F.when(most <= PARTIAL_UPTO * least, PARTIAL_WEIGHT).otherwise(FAR_WEIGHT) * aligned_score(a, b)
    # Windows are looked at only where they can be the best: their score is 90 at most.
    return F.when(~counts | (whole >= 100.0 * PARTIAL_WEIGHT), whole).otherwise(F.greatest(whole, partial))


def query_ok(q: Column) -> Column:
    """At least three characters and a letter."""
    return (F.length(q) >= 3) & q.rlike("[a-z]")


def long_enough(q: Column, key: Column) -> Column:
    """The query may not be shorter than half the key."""
    return F.length(q) >= F.lit(0.5) * F.length(key)


def _edits(length: Column, floor: float) -> Column:
    """Most edits between a key of this length and any query that can still pass."""
    longest_query = F.floor(length * 100.0 / floor + 1e-9)
    return F.floor(longest_query * (100.0 - floor) / 100.0 + 1e-9).cast("int")


def _unsent(df: DataFrame) -> DataFrame:
    """A join side that is met by merge at every size. What explodes into segments, splits or grams looks to the planner as
    small as the file it comes from, so it would be broadcast although it is many times larger."""
    return df.hint("merge")


def candidate_pairs(queries: DataFrame, keys: DataFrame, floor: float,
                    scope: list[str] | None = None, beside: Column | None = None) -> DataFrame:
    """All (q, key) pairs whose edit score reaches ``floor`` (both frames distinct).

    ``queries``: q [+ scope], ``keys``: key [+ scope]; scope columns join by equality. ``beside`` is the length of an
    equal text that both sides have besides (a column of the scope): the score is that of the whole."""
    scope = scope or []
    e = F.lit(0) if beside is None else beside
    k = keys.filter(F.length("key") > 0).withColumn("__L", F.length("key")).withColumn("__K", _edits(F.col("__L") + e, floor))
    if beside is None:
        k = k.withColumn("__K", F.least("__K", F.col("__L") - 1))

    def start(L, K, i):
        return i * F.floor(L / (K + 1)).cast("int")

    def size(L, K, i):
        base = F.floor(L / (K + 1)).cast("int")
        return F.when(i == K, L - base * K).otherwise(base)

    L, K, i = F.col("__L"), F.col("__K"), F.col("__i")
    cut = k.filter("__K < __L").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__K"))))
    cut = cut.withColumn("__seg", F.substr("key", start(L, K, i) + 1, size(L, K, i))).drop("__K")

    n = F.length("q")
    q = (queries.filter(n > 0)
         .withColumn("__L", F.explode(F.sequence(
             F.greatest(F.lit(1), F.ceil((n + e) * floor / 100.0 - 1e-9).cast("int") - e),
             F.floor((n + e) * 100.0 / floor + 1e-9).cast("int") - e)))
         .withColumn("__K", _edits(L + e, floor) if beside is not None else F.least(_edits(L, floor), L - 1)))
    pieces = (q.filter("__K < __L").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__K"))))
              .withColumn("__p", F.explode(F.sequence(
                  F.greatest(F.lit(0), start(L, K, i) - K), start(L, K, i) + K)))
              .filter(F.col("__p") + size(L, K, i) <= n)
              .withColumn("__seg", F.substr("q", F.col("__p") + 1, size(L, K, i)))
              .select("q", *scope, "__L", "__i", "__seg").distinct())
    limit = F.floor((F.greatest(n, F.length("key")) + e) * (100.0 - floor) / 100.0 + 1e-9)
    met = pieces.join(_unsent(cut), [*scope, "__L", "__i", "__seg"]).select("q", "key", *scope)
    if beside is not None:
        # Texts so short beside what is equal that all of them may differ: few, and alike in the scope.
        met = met.unionByName(q.filter("__K >= __L").select("q", *scope, "__L").join(_unsent(k.filter("__K >= __L").select("key", *scope, "__L")), [*scope, "__L"])
                              .select("q", "key", *scope))
    return met.filter(F.levenshtein("q", "key") <= limit).select("q", "key", *scope).distinct()


def _renamed(df: DataFrame, own: str, to: str, scope: list[str]) -> DataFrame:
    return df.select(F.col(own).alias(to), *scope)


def covering_pairs(lefts: DataFrame, rights: DataFrame, need: float, scope: list[str]) -> DataFrame:
    """(x, y) where the tokens shared make up ``need`` per cent of the distinct tokens of x (columns x and y [+ scope]).

    Prefix filter: x is filed under its rarest tokens only (by how many y hold them), as many as weigh more than what may be
    missing: whoever shares none of these misses too much. A token in half of the names is hardly ever among them."""
    slack = (100.0 - need) / 100.0
    y = rights.select("y", *scope, _distinct_tokens(F.col("y")).alias("__yt")).withColumn("__t", F.explode("__yt"))
    often = y.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"))
    x = lefts.select("x", *scope, F.explode(_distinct_tokens(F.col("x"))).alias("__t")).join(_unsent(often), "__t", "left")
    x = x.groupBy("x", *scope).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__t").alias("t")))).alias("__all"))
    weight = lambda ts: F.aggregate(ts, F.lit(0), lambda w, t: w + F.length(t["t"]) + 1)
    rare = F.filter("__all", lambda t, i: weight(F.slice(F.col("__all"), F.lit(1), i)) <= slack * weight(F.col("__all")) + 1e-9)
    x = x.select("x", *scope, F.transform("__all", lambda t: t["t"]).alias("__xt"), F.explode(F.filter(rare, lambda t: t["n"] > 0)).alias("__r"))
    x = x.select("x", *scope, "__xt", F.length(F.array_join("__xt", " ")).alias("__size"), F.col("__r.t").alias("__t"))
    share = F.length(F.array_join(F.array_intersect("__xt", "__yt"), " "))
    return x.join(_unsent(y), ["__t", *scope]).filter(share >= need / 100.0 * F.col("__size") - 1e-9).select("x", "y", *scope)


def split_pairs(queries: DataFrame, keys: DataFrame, need: float, scope: list[str]) -> DataFrame:
    """(q, key) that share tokens and whose other tokens are close: the edit score of shared tokens first, then the rest, reaches ``need``.

    Every string is filed under each choice of shared tokens with what is left, and the rests are blocked by segments within equal
    choices: a token that very many names share joins only names with close rests. Names of more than
    ``SPLIT_TOKENS`` tokens have too many choices and meet by their rarest tokens' equals instead."""
    def splits(df, c, rest):
        t = df.select(F.col(c).alias("__own"), *scope, _distinct_tokens(F.col(c)).alias("__t")).filter((F.size("__t") > 1) & (F.size("__t") <= SPLIT_TOKENS))
        t = t.withColumn("__m", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(__t)) - 2"))))
        part = lambda bit: F.array_join(F.expr(f"filter(__t, (x, i) -> (shiftright(__m, i) & 1) = {bit})"), " ")
        return t.select("__own", *scope, part(1).alias("__s"), part(0).alias(rest))
    q, k = splits(queries, "q", "q"), splits(keys, "key", "key")
    inside = [*scope, "__s"]
    near = candidate_pairs(q.select("q", *inside).distinct(), k.select("key", *inside).distinct(), need, inside, F.length("__s") + 1)
    found = (near.join(_unsent(q.withColumnRenamed("__own", "__q")), ["q", *inside]).join(_unsent(k.withColumnRenamed("__own", "__k")), ["key", *inside])
             .select(F.col("__q").alias("q"), F.col("__k").alias("key"), *scope))
    many = lambda c: F.size(_distinct_tokens(F.col(c))) > SPLIT_TOKENS
    by = lambda df, c: df.select(c, *scope, F.explode(_distinct_tokens(F.col(c))).alias("__t"))
    close = F.abs(F.length("q") - F.length("key")) <= (100.0 - need) / 100.0 * F.greatest(F.length("q"), F.length("key")) + 1e-9
    for a, b in ((queries.filter(many("q")), keys), (queries.filter(~many("q")), keys.filter(many("key")))):
        found = found.unionByName(by(a, "q").join(_unsent(by(b, "key")), ["__t", *scope]).filter(close).select("q", "key", *scope))
    return found


def window_pairs(shorts: DataFrame, longs: DataFrame, need: float, scope: list[str]) -> DataFrame:
    """(x, y) whose ``aligned_score`` reaches ``need``, for x shorter than y by the ratio at which it counts.

    Positional gram index: x may differ from a window by k edits, so one of k + 1 segments of x stands whole in y, moved by
    k at most. A segment is looked up by the rarest of its grams among all grams of y with their positions; a segment with a gram that no y
    holds is not looked up at all."""
    m = F.length("x")
    k = F.floor(m * (100.0 - need) / 100.0 + 1e-9).cast("int")
    base = F.floor(m / (k + 1)).cast("int")
    y = longs.filter(F.length("y") > 0).select("y", *scope, F.length("y").alias("__n"), F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("y")))).alias("__z"))
    y = y.withColumn("__at", F.explode(F.sequence(F.lit(1), F.col("__n") - F.col("__z") + 1))).withColumn("__g", F.substr("y", F.col("__at"), F.col("__z"))).drop("__z")
    often = y.groupBy("__g").agg(F.count(F.lit(1)).alias("__often"))
    i = F.col("__i")
    x = (shorts.filter(m > 0).withColumn("__i", F.explode(F.sequence(F.lit(0), k)))
         .withColumn("__o", base * i).withColumn("__l", F.when(i == k, m - base * k).otherwise(base))
         .withColumn("__g_len", F.least(F.lit(GRAM), F.col("__l")))
         .withColumn("__in", F.explode(F.sequence(F.lit(0), F.col("__l") - F.col("__g_len"))))
         .withColumn("__g", F.substr("x", F.col("__o") + F.col("__in") + 1, F.col("__g_len"))))
    rare = x.join(_unsent(often), "__g", "left").groupBy("x", *scope, "__o", "__l").agg(
        F.min(F.struct("__often", "__g", "__in")).alias("r"), F.count_if(F.col("__often").isNull()).alias("__dead")).filter("__dead = 0")
    rare = rare.select("x", *scope, "__o", "__l", F.col("r.__g").alias("__g"), (F.col("__o") + F.col("r.__in") + 1).alias("__place"))
    shift = F.col("__at") - F.col("__place")
    fits = ((F.col("__n") >= PARTIAL_FROM * m) & (F.col("__n") <= PARTIAL_UPTO * m) & (shift >= -k) & (shift <= F.col("__n") - m + k)
            & (F.substr("y", shift + F.col("__o") + 1, F.col("__l")) == F.substr("x", F.col("__o") + 1, F.col("__l"))))
    met = rare.join(_unsent(y), ["__g", *scope]).filter(fits).select("x", "y", *scope).distinct()
    # Without edits the one segment is x itself, found whole.
    return met.filter((k == 0) | (aligned_score(F.col("x"), F.col("y")) >= need - 1e-9))


def token_pairs(queries: DataFrame, keys: DataFrame, floor: float, scope: list[str] | None = None) -> DataFrame:
    """All (q, key) pairs whose ``composite_score`` can reach ``floor``: those close as they are,
    those close with sorted tokens (all or distinct ones), those of which one side is nearly covered by shared tokens
    (``covering_pairs``), those that share tokens and have close rests (``split_pairs``), and those of which one side nearly stands
    in the other (``window_pairs``). Every pair above the floor is one of these, so none is lost; what is met
    grows with the pairs found, not with how many names share a token."""
    scope = scope or []
    need = floor / TOKEN_WEIGHT
    # Read by every kind of pairs below, so made once; dealt out, as few names explode into many rows.
    parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    queries = stage(queries.select("q", *scope).distinct().repartition(parts), "queries")
    keys = stage(keys.select("key", *scope).distinct().repartition(parts), "keys")

    def forms(df, c, form, own):
        """A string as it is, with sorted tokens, and with sorted distinct tokens, each once."""
        x = F.col(c)
        shown = F.array_distinct(F.array(x, _sorted_text(x), F.array_join(_distinct_tokens(x), " ")))
        return df.select(x.alias(own), *scope, F.explode(shown).alias(form))
    q, k = forms(queries, "q", "q", "__q"), forms(keys, "key", "key", "__k")
    near = candidate_pairs(q.select("q", *scope).distinct(), k.select("key", *scope).distinct(), floor, scope)
    found = near.join(_unsent(q), ["q", *scope]).join(_unsent(k), ["key", *scope]).select(
        F.col("__q").alias("q"), F.col("__k").alias("key"), *scope)
    found = found.unionByName(split_pairs(queries, keys, need, scope))
    partial = floor / PARTIAL_WEIGHT
    for x, y in (("q", "key"), ("key", "q")):
        a, b = (queries, keys) if x == "q" else (keys, queries)
        sides = _renamed(a, x, "x", scope), _renamed(b, y, "y", scope)
        for pairs in [covering_pairs(*sides, need, scope), *([window_pairs(*sides, partial, scope)] if partial <= 100 else [])]:
            found = found.unionByName(pairs.withColumnsRenamed({"x": x, "y": y}))
    return found.distinct()


def hazard_keys(keys: DataFrame) -> DataFrame:
    """Keys equal to a proper contiguous token run of some key."""
    toks = F.split("key", " ")
    runs = (keys.select(toks.alias("t")).withColumn("n", F.size("t")).filter("n > 1")
            .withColumn("len", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)))
            .select(F.array_join(F.slice("t", F.col("at"), F.col("len")), " ").alias("key")).distinct())
    return keys.select("key").distinct().join(_unsent(runs), "key", "left_semi")


def _printings(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("name").isNotNull()).select(
        S.normalize_name(F.col("name")).alias("key"), F.col("set_id"), "local_id",
        F.col("name").alias("card_name"), "official_count")


def match_name(queries: DataFrame, catalog: DataFrame, floor: float = 82.0,
               scorer: Callable[[Column, Column], Column] = composite_score,
               pairs: Callable = token_pairs) -> DataFrame:
    """Best name match per (text, denominator). ``pairs`` must lose no pair that ``scorer`` puts
    at the floor: ``token_pairs`` for the token-aware score, ``candidate_pairs`` for ``edit_score``.

    ``queries``: text, denominator; ``catalog``: set_id, local_id, name, official_count.
    Best key (score, then key); printings narrowed by official count (digits) or id
    prefix (letters); a unique printing is ambiguous only if its key is a hazard, several
    printings are ambiguous and show the first by (set, local id)."""
    p = _printings(catalog)
    keys = p.select("key").distinct()
    asked = (queries.select("text", "denominator").distinct()
             .withColumn("q", S.normalize_name(F.col("text"))).filter(query_ok(F.col("q"))))
    asked = stage(asked, "asked")
    texts = asked.select("q").distinct()
    found = pairs(texts, keys, floor)
    scored = found.withColumn("score", scorer(F.col("q"), F.col("key"))).filter(F.col("score") >= floor - 1e-9)
    best = (scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("m"))
            .select("q", "m.key", (-F.col("m.s")).alias("score"))
            .filter(long_enough(F.col("q"), F.col("key"))))
    best = stage(best, "best")
    hazard = hazard_keys(keys).withColumn("hazard", F.lit(True))
    best = best.join(hazard, "key", "left")
    # printings per (key, denominator) asked, pre-aggregated to counts and first rows
    need = asked.join(best, "q").select("key", "denominator").distinct()
    den = F.col("denominator")
    narrow = (F.when(den.rlike(r"^\d+$"), F.col("official_count") == den.try_cast("int"))
              .when(N.alpha_prefix(den) != "", F.startswith(F.upper("local_id"), N.alpha_prefix(den)))
              .otherwise(F.lit(False)))
    row = F.struct("set_id", "local_id", "card_name")
    pick = (need.join(_unsent(p), "key").withColumn("__in", F.coalesce(narrow, F.lit(False)))
            .groupBy("key", "denominator").agg(
                F.count(F.lit(1)).alias("n"), F.min(row).alias("first"),
                F.count_if("__in").alias("n_in"), F.min(F.when(F.col("__in"), row)).alias("first_in")))
    d = F.coalesce("denominator", F.lit("")).alias("__d")
    out = (asked.join(best, "q").select("*", d)
           .join(pick.select("*", d).drop("denominator"), ["key", "__d"]))
    unique = (F.col("n_in") == 1) | (F.col("n") == 1)
    chosen = F.when(F.col("n_in") == 1, F.col("first_in")).otherwise(F.col("first"))
    return out.select("text", "denominator", "q", "key", "score", chosen.alias("c"),
                      F.when(unique, F.coalesce("hazard", F.lit(False))).otherwise(True).alias("ambiguous")) \
        .select("text", "denominator", "q", "key", "score", "c.set_id", "c.local_id", "c.card_name", "ambiguous")


def scope_of(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(official count -> its only set, id prefix -> its only set)."""
    counts = (catalog.groupBy("official_count").agg(F.count_distinct("set_id").alias("n"), F.min("set_id").alias("s"))
              .filter("n = 1").select("official_count", F.col("s").alias("by_count")))
    pre = (catalog.withColumn("prefix", N.alpha_prefix(F.col("local_id"))).filter("prefix <> ''")
           .groupBy("prefix").agg(F.count_distinct("set_id").alias("n"), F.min("set_id").alias("s"))
           .filter("n = 1").select("prefix", F.col("s").alias("by_prefix")))
    return counts, pre


def match_name_in_set(queries: DataFrame, catalog: DataFrame, floor: float = 80.0,
                      scorer: Callable[[Column, Column], Column] = composite_score,
                      pairs: Callable = token_pairs) -> DataFrame:
    """Best name match inside one set: the given ``set_id``, else the only set owning
    the denominator or its letter prefix. A tie at the top, or several printings, is
    ambiguous. ``queries``: text, set_id (may be NULL), denominator."""
    counts, pre = scope_of(catalog)
    den = F.col("denominator")
    asked = (queries.select("text", "set_id", "denominator").distinct()
             .withColumns({"q": S.normalize_name(F.col("text")), "official_count": F.when(den.rlike(r"^\d+$"), den.try_cast("int")),
                           "prefix": F.when(~den.rlike(r"^\d+$"), N.alpha_prefix(den))})
             .filter(query_ok(F.col("q")))
             .join(counts, "official_count", "left").join(pre, "prefix", "left")
             .withColumn("scope", F.coalesce("set_id", "by_count", "by_prefix")).filter("scope IS NOT NULL"))
    asked = stage(asked, "asked")
    p = _printings(catalog).withColumnRenamed("set_id", "scope")
    texts, keys = asked.select("q", "scope").distinct(), p.select("key", "scope").distinct()
    found = pairs(texts, keys, floor, ["scope"])
    scored = found.withColumn("score", scorer(F.col("q"), F.col("key"))).filter(F.col("score") >= floor - 1e-9)
    top = top_k(scored, ["q", "scope"], [F.desc("score"), "key"], 2, "r").groupBy("q", "scope").agg(
        F.max(F.when(F.col("r") == 1, F.col("key"))).alias("key"),
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    first = p.groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"),
                                          F.min(F.struct("local_id", "card_name")).alias("c"))
    out = asked.join(top, ["q", "scope"]).join(first, ["scope", "key"])
    tied = F.coalesce(F.col("second") >= F.col("score"), F.lit(False))
    return out.select("text", "set_id", "denominator", "scope", "key", "score", "c.local_id", "c.card_name",
                      ((F.col("n") > 1) | tied).alias("ambiguous"))


def best_set_match(names: DataFrame, candidates: DataFrame, floor: float = 82.0,
                   scorer: Callable[[Column, Column], Column] = composite_score,
                   pairs: Callable = token_pairs) -> DataFrame:
    """Best candidate set per scraped name, a required substring (``pin``) first and
    without it when nothing carries it. ``names``: slug, name, pin; ``candidates``:
    set_id, name. Unmatched rows keep a reason; a best score below the floor is not
    reported (blocking never looks at such pairs)."""
    n = names.withColumn("q", S.set_name_words(F.col("name")))
    c = candidates.select(S.set_name_words(F.col("name")).alias("key"), "set_id")
    found = pairs(n.select("q").distinct(), c.select("key").distinct(), floor)
    s = (n.select("slug", "q", "pin").join(found, "q").join(c, "key")
         .withColumn("score", scorer(F.col("q"), F.col("key"))).filter(F.col("score") >= floor - 1e-9))
    pinned = F.col("pin").isNull() | F.contains("key", F.lower("pin"))
    # a pin binds only if some candidate carries it
    low = F.lower("pin")
    grams = c.select("key", F.explode(S.short_grams(F.col("key"))).alias("__g"))
    live = (n.filter("pin IS NOT NULL").select("pin").distinct()
            .withColumn("__g", F.substring(low, 1, 3)).join(grams, "__g")
            .filter(F.contains("key", low)).select("pin", F.lit(True).alias("__bound")).distinct())
    s = s.join(live, "pin", "left").filter(F.col("__bound").isNull() | pinned)
    best = s.groupBy("slug").agg(F.min(F.struct((-F.col("score")).alias("score"), "set_id")).alias("b"))
    return n.join(best, "slug", "left").select(
        "slug", "name", "b.set_id", F.round(-F.col("b.score"), 1).alias("score"),
        F.when(F.col("b").isNull(), "no_fuzzy_match").when(F.coalesce("b.set_id", F.lit("")) == "", "no_set_id")
         .alias("reason"))


def numerator_corroborated(claim: Column, texts: Column) -> Column:
    """Contradiction test of a claimed number against a cell's own lines (array): passes
    when some squashed line contains it, or the lines parse no number, or one of the
    parsed numbers equals it."""
    c = F.upper(F.regexp_replace(F.coalesce(claim, F.lit("")), "[^A-Za-z0-9]", ""))
    flat = F.exists(texts, lambda t: F.contains(F.upper(F.regexp_replace(t, "[^A-Za-z0-9]", "")), c))

    def bare(x):
        return F.regexp_replace(F.upper(x), "^0+(?=.)", "")

    # Each line is parsed once: true and false for its number against the claim, NULL without one; true is the largest.
    seen = F.transform(F.transform(texts, lambda t: N.parse_number(t, F.lit(0.9))["numerator"]), lambda x: bare(x) == bare(c))
    return (c != "") & (flat | F.coalesce(F.array_max(seen), F.lit(True)))


def name_contradicts_number(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``contradicts``: no printing of the matched name, inside the denominator's
    scope, carries the read number (an empty scope contradicts too).

    ``cells``: cell_id, key (matched name key or NULL), denominator, numerator."""
    p = _printings(catalog)
    den = F.col("denominator")
    asked = (cells.filter(F.col("key").isNotNull() & F.col("numerator").isNotNull())
             .select("key", "denominator", "numerator").distinct())
    owners = (catalog.withColumn("__pre", N.alpha_prefix(F.col("local_id"))).filter("__pre <> ''")
              .select("__pre", F.col("set_id").alias("__os")).distinct())
    j = (asked.join(p, "key").withColumn("__pre", F.when(~den.rlike(r"^\d+$"), N.alpha_prefix(den)))
         .join(owners.withColumnRenamed("__os", "set_id").withColumn("__own", F.lit(True)),
               ["__pre", "set_id"], "left"))
    inside = (F.when(den.isNull() | (den == ""), True)
              .when(den.rlike(r"^\d+$"), F.col("official_count") == den.try_cast("int"))
              .otherwise(F.coalesce("__own", F.lit(False))))
    same = N.normalize_local_id(F.col("local_id")) == N.normalize_local_id(F.col("numerator"))
    good = (j.filter(inside & same).select(F.col("key").alias("__k"), F.coalesce("denominator", F.lit("")).alias("__d"),
                                          F.col("numerator").alias("__n")).distinct().withColumn("__ok", F.lit(True)))
    out = cells.join(good, (cells["key"] == F.col("__k")) & (F.coalesce(cells["denominator"], F.lit("")) == F.col("__d"))
                     & (cells["numerator"] == F.col("__n")), "left")
    bad = F.col("key").isNotNull() & F.col("numerator").isNotNull() & F.col("__ok").isNull()
    return out.withColumn("contradicts", bad).drop("__k", "__d", "__n", "__ok")
