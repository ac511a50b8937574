"""Fuzzy matching against the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import names as S
from cardloom.operators import fuzzy
from cardloom.queries.registry import query

# The catalog plus a gallery of one-word names and long names of all parts (thousands of them), with official counts 50 + n % 9.
LONG = "lower(replace(p_brand, '#', '')) || ' ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) ELSE '' END"
FC = """fc AS (SELECT set_id, local_id, name, 50 + CAST(substr(set_id, 2) AS INT) % 9 AS official_count FROM catalog_card
  UNION ALL SELECT set_id, 'TG' || local_id, split_part(name, ' ', 2), 50 + CAST(substr(set_id, 2) AS INT) % 9 FROM catalog_card WHERE set_id IN ('S02', 'S10') AND local_id < '030'
  UNION ALL SELECT 'S' || lpad(CAST(p_partkey % 12 AS VARCHAR), 2, '0'), 'P' || CAST(p_partkey AS VARCHAR), """ + LONG + """, 50 + p_partkey % 12 % 9 FROM part),
ky AS (SELECT DISTINCT lower(name) AS key FROM fc)"""
TEXT = "CASE WHEN num % 16 = 0 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) WHEN num % 16 = 4 THEN name || ' extra' WHEN num % 4 = 0 THEN name WHEN num % 4 = 1 THEN split_part(name, ' ', 2) || 's' ELSE substr(name, 1, num % length(name)) || substr(name, 2 + num % length(name)) END"
_DEN = "CASE num % 3 WHEN 0 THEN '0' || CAST(50 + CAST(substr(set_id, 2) AS INT) % 9 AS {s}) WHEN 1 THEN 'TG30' END"
HAZ = """hz AS (SELECT DISTINCT a.key FROM ky a JOIN ky b ON length(b.key) > length(a.key) AND contains(' ' || b.key || ' ', ' ' || a.key || ' '))"""
def edit_sql(a, b):
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END"


_SCORE = edit_sql("q", "key")
_ALIGNED = """CASE WHEN least(length(q), length(key)) > 0 AND greatest(length(q), length(key)) >= 1.5 * least(length(q), length(key)) THEN
  CASE WHEN greatest(length(q), length(key)) <= 8 * least(length(q), length(key)) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END * (100.0::DOUBLE * (1.0::DOUBLE - list_min(list_transform(
  range(1, abs(length(q) - length(key)) + 2), lambda i: levenshtein(CASE WHEN length(q) <= length(key) THEN q ELSE key END,
  substr(CASE WHEN length(q) <= length(key) THEN key ELSE q END, i, least(length(q), length(key))))))::DOUBLE / least(length(q), length(key)))) ELSE 0.0::DOUBLE END"""


def composite_sql(pairs):
    """(all columns of ``pairs``, score): the token-aware score of q and key, spelled out."""
    toks = "list_filter(string_split({}, ' '), lambda x: x <> '')"
    return f"""(SELECT * EXCLUDE (tq, tk, sq, sk, dq, dk, sh, le, ri), greatest({_SCORE}, 0.95::DOUBLE * ({edit_sql('sq', 'sk')}),
  0.95::DOUBLE * (CASE WHEN sh = '' THEN {edit_sql('le', 'ri')} ELSE greatest({edit_sql('le', 'ri')}, {edit_sql('sh', 'le')}, {edit_sql('sh', 'ri')}) END), {_ALIGNED}) AS score FROM (
 SELECT *, trim(sh || ' ' || array_to_string(list_filter(dq, lambda x: NOT list_contains(dk, x)), ' ')) AS le, trim(sh || ' ' || array_to_string(list_filter(dk, lambda x: NOT list_contains(dq, x)), ' ')) AS ri FROM (
 SELECT *, array_to_string(list_filter(dq, lambda x: list_contains(dk, x)), ' ') AS sh FROM (
 SELECT *, array_to_string(list_sort(tq), ' ') AS sq, array_to_string(list_sort(tk), ' ') AS sk, list_sort(list_distinct(tq)) AS dq, list_sort(list_distinct(tk)) AS dk FROM (
 SELECT *, {toks.format('q')} AS tq, {toks.format('key')} AS tk FROM ({pairs}) p0) p1) p2) p3) p4)"""


def fuzzy_catalog(t):
    count = F.lit(50) + F.substring("set_id", 2, 2).cast("int") % 9
    c = t.catalog.select("set_id", "local_id", "name", count.alias("official_count"))
    g = c.filter("set_id IN ('S02', 'S10') AND local_id < '030'").select(
        "set_id", F.concat(F.lit("TG"), "local_id").alias("local_id"), F.split_part("name", F.lit(" "), F.lit(2)).alias("name"), "official_count")
    return c.unionByName(g)


def wide_catalog(t):
    """``fuzzy_catalog`` and the long names of all parts."""
    part = t.table("part")
    number = F.col("p_partkey") % 12
    long = part.select(F.concat(F.lit("S"), F.lpad(number.cast("string"), 2, "0")).alias("set_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("local_id"),
                       F.expr(LONG).alias("name"), (F.lit(50) + number % 9).cast("int").alias("official_count"))
    return fuzzy_catalog(t).unionByName(long)


def noisy_names(t):
    return t.cards_unordered.select(F.expr(TEXT).alias("text"), F.expr(_DEN.format(s="STRING")).alias("denominator"), "set_id", "num").distinct()


_ASK = f"""ask AS (SELECT DISTINCT text, denominator, trim(lower(text)) AS q FROM (SELECT {TEXT} AS text, {_DEN.format(s='VARCHAR')} AS denominator FROM pull_card) x)"""
MATCH = f"""{FC}, {HAZ}, {_ASK},
sc AS (SELECT q, key, score FROM {composite_sql("SELECT q, key FROM (SELECT DISTINCT q FROM ask WHERE length(q) >= 3) a, ky")}),
bk AS (SELECT q, key, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS r FROM sc WHERE score >= 82 - 1e-9) x WHERE r = 1 AND length(q) >= 0.5 * length(key)),
pr AS (SELECT a.text, a.denominator, b.key, b.score, fc.set_id, fc.local_id, fc.name, coalesce(CASE WHEN regexp_matches(a.denominator, '^[0-9]+$') THEN fc.official_count = TRY_CAST(a.denominator AS INT)
     WHEN a.denominator IS NOT NULL THEN starts_with(fc.local_id, regexp_extract(a.denominator, '^[A-Z]+')) END, FALSE) AS inn FROM ask a JOIN bk b ON a.q = b.q JOIN fc ON lower(fc.name) = b.key),
ag AS (SELECT text, denominator, key, score, count(*) AS n, count(*) FILTER (WHERE inn) AS n_in, arg_min((set_id, local_id, name), (set_id, local_id)) AS f, arg_min((set_id, local_id, name), (set_id, local_id)) FILTER (WHERE inn) AS fi FROM pr GROUP BY 1, 2, 3, 4),
mt AS (SELECT text, denominator, key, score, CASE WHEN n_in = 1 THEN fi ELSE f END AS c, CASE WHEN n_in = 1 OR n = 1 THEN key IN (SELECT key FROM hz) ELSE TRUE END AS ambiguous FROM ag)"""


@query("C8", "match_name", f"WITH {MATCH} SELECT text, denominator, key, round(score, 6) AS score, c[1] AS set_id, c[2] AS local_id, c[3] AS card_name, ambiguous FROM mt".replace("c[1]", "struct_extract(c, 1)").replace("c[2]", "struct_extract(c, 2)").replace("c[3]", "struct_extract(c, 3)"))
def _match(t):
    return fuzzy.match_name(noisy_names(t), wide_catalog(t)).select(
        "text", "denominator", "key", F.round("score", 6).alias("score"), "set_id", "local_id", "card_name", "ambiguous")


@query("C9", "match_name_in_set", f"""WITH {FC}, ask AS (SELECT DISTINCT {TEXT} AS text, CASE WHEN num % 2 = 0 THEN set_id END AS set_id, {_DEN.format(s='VARCHAR')} AS denominator FROM pull_card),
oc AS (SELECT official_count, min(set_id) AS s FROM fc GROUP BY 1 HAVING count(DISTINCT set_id) = 1),
op AS (SELECT regexp_extract(local_id, '^[A-Z]+') AS p, min(set_id) AS s FROM fc WHERE regexp_matches(local_id, '^[A-Z]') GROUP BY 1 HAVING count(DISTINCT set_id) = 1),
a AS (SELECT ask.*, lower(text) AS q, coalesce(ask.set_id, oc.s, op.s) AS scope FROM ask LEFT JOIN oc ON TRY_CAST(ask.denominator AS INT) = oc.official_count
   LEFT JOIN op ON regexp_extract(ask.denominator, '^[A-Z]+') = op.p WHERE length(text) >= 3),
k AS (SELECT set_id, lower(name) AS key, count(*) AS n, arg_min(local_id, local_id) AS local_id, arg_min(name, local_id) AS card_name FROM fc GROUP BY 1, 2),
sc AS {composite_sql("SELECT a.*, k.key, k.n, k.local_id, k.card_name FROM a JOIN k ON a.scope = k.set_id")},
rk AS (SELECT *, row_number() OVER (PARTITION BY text, set_id, denominator ORDER BY score DESC, key) AS r, lead(score) OVER (PARTITION BY text, set_id, denominator ORDER BY score DESC, key) AS second FROM sc WHERE score >= 80 - 1e-9)
SELECT text, set_id, denominator, scope, key, round(score, 6) AS score, local_id, card_name, n > 1 OR coalesce(second >= score, FALSE) AS ambiguous FROM rk WHERE r = 1""")
def _match_in_set(t):
    asked = noisy_names(t).select("text", F.when(F.col("num") % 2 == 0, F.col("set_id")).alias("set_id"), "denominator")
    return fuzzy.match_name_in_set(asked, wide_catalog(t)).select(
        "text", "set_id", "denominator", "scope", "key", F.round("score", 6).alias("score"), "local_id", "card_name", "ambiguous")


@query("C10", "hazard_keys", f"WITH {FC}, {HAZ} SELECT key FROM hz")
def _hazard(t):
    return fuzzy.hazard_keys(wide_catalog(t).select(S.normalize_name(F.col("name")).alias("key")))


@query("B14", "query_guards", """SELECT turn, conv_id, length(q) >= 3 AND regexp_matches(q, '[a-z]') AS usable, length(q) >= 0.5 * 24 AS long_enough FROM (
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM conversations) x""".replace("\\\\", "\\"))
def _guards(t):
    q = S.normalize_name(F.col("text"))
    return t.table("conversations").select("conv_id", "turn", fuzzy.query_ok(q).alias("usable"),
                                           fuzzy.long_enough(q, F.lit("x" * 24)).alias("long_enough"))


@query("B15", "numerator_corroborated", """SELECT pull_id, row_index, CASE WHEN claim = '' THEN FALSE ELSE contains(regexp_replace(up, '[^A-Z0-9]', '', 'g'), claim) OR numerator IS NULL
   OR coalesce(nullif(ltrim(numerator, '0'), ''), '0') = coalesce(nullif(ltrim(claim, '0'), ''), '0') END AS ok
FROM (SELECT *, CASE WHEN num % 8 = 0 THEN '' ELSE CAST(num + CASE WHEN num % 3 = 0 THEN 100 ELSE 0 END AS VARCHAR) END AS claim FROM reading) r""")
def _corroborated(t):
    num = F.col("num")
    claim = F.when(num % 8 == 0, "").otherwise((num + F.when(num % 3 == 0, 100).otherwise(0)).cast("string"))
    return t.readings.select("pull_id", "row_index", fuzzy.numerator_corroborated(claim, F.array("text", F.lit("ABC"))).alias("ok"))


@query("B13", "name_contradicts_number", f"""WITH {FC},
c AS (SELECT DISTINCT lower(name) AS key, {_DEN.format(s='VARCHAR')} AS denominator, CAST(num AS VARCHAR) AS numerator FROM pull_card)
SELECT c.*, NOT EXISTS (SELECT 1 FROM fc WHERE lower(fc.name) = c.key AND regexp_replace(fc.local_id, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') = c.numerator
  AND CASE WHEN c.denominator IS NULL THEN TRUE WHEN regexp_matches(c.denominator, '^[0-9]+$') THEN fc.official_count = TRY_CAST(c.denominator AS INT)
      ELSE fc.set_id IN (SELECT set_id FROM fc f2 WHERE starts_with(f2.local_id, regexp_extract(c.denominator, '^[A-Z]+'))) END) AS contradicts FROM c""".replace("\\\\", "\\"))
def _contradicts(t):
    c = t.cards_unordered.select(S.normalize_name(F.col("name")).alias("key"), F.expr(_DEN.format(s="STRING")).alias("denominator"),
                                 F.col("num").cast("string").alias("numerator")).distinct()
    return fuzzy.name_contradicts_number(c, wide_catalog(t))


_SCRAPED = "sn AS (SELECT DISTINCT 'p' || CAST(pull_id % 300 AS {s}) AS slug, CASE pull_id % 6 WHEN 0 THEN 'Realm & Rift ' WHEN 1 THEN 'Relm and Rift ' WHEN 2 THEN 'REALM & RFT ' WHEN 3 THEN 'Realms and Rifts ' WHEN 4 THEN 'Other ' ELSE 'Realm Rift ' END || CAST(pull_id % 12 AS {s}) AS name, CASE WHEN pull_id % 5 = 0 THEN CAST(pull_id % 3 AS {s}) WHEN pull_id % 5 = 1 THEN 'qq' END AS pin FROM pull)"


@query("C25", "best_set_match", f"""WITH {_SCRAPED.format(s='VARCHAR')}, n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM sn),
k AS (SELECT set_id, 'realm and rift ' || CAST(n AS VARCHAR) AS key FROM set_dim), bd AS (SELECT DISTINCT pin FROM sn JOIN k ON contains(key, pin)),
s AS {composite_sql("SELECT slug, set_id, q, key FROM n, k WHERE (pin IS NULL OR pin NOT IN (SELECT pin FROM bd) OR contains(key, pin))")},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, set_id) AS r FROM s WHERE score >= 82 - 1e-9) x WHERE r = 1)
SELECT n.slug, n.name, b.set_id, round(b.score, 1) AS score, CASE WHEN b.set_id IS NULL THEN 'no_fuzzy_match' END AS reason FROM n LEFT JOIN b ON n.slug = b.slug""")
def _best_set(t):
    p = F.col("pull_id")
    base = (F.when(p % 6 == 0, "Realm & Rift ").when(p % 6 == 1, "Relm and Rift ").when(p % 6 == 2, "REALM & RFT ")
            .when(p % 6 == 3, "Realms and Rifts ").when(p % 6 == 4, "Other ").otherwise("Realm Rift "))
    names = t.submissions.select(
        F.concat(F.lit("p"), (p % 300).cast("string")).alias("slug"), F.concat(base, (p % 12).cast("string")).alias("name"),
        F.when(p % 5 == 0, (p % 3).cast("string")).when(p % 5 == 1, "qq").alias("pin")).distinct()
    return fuzzy.best_set_match(names, t.sets.select("set_id", F.col("set_name").alias("name")))


@query("J2", "fuzzy_scorer", f"""WITH {_ASK}, {FC} SELECT q, key, round({_SCORE}, 6) AS score FROM (SELECT DISTINCT q FROM ask) a, ky WHERE {_SCORE} >= 70 - 1e-9""")
def _scorer(t):
    q = noisy_names(t).select(S.normalize_name(F.col("text")).alias("q")).distinct()
    k = wide_catalog(t).select(S.normalize_name(F.col("name")).alias("key")).distinct()
    return fuzzy.candidate_pairs(q, k, 70.0).withColumn("score", F.round(fuzzy.edit_score(F.col("q"), F.col("key")), 6))


@query("J2", "composite_scorer", f"""WITH {_ASK}, {FC} SELECT q, key, round(score, 4) AS score FROM {composite_sql("SELECT q, key FROM (SELECT DISTINCT q FROM ask) a, ky")} WHERE score >= 82 - 1e-9""")
def _composite(t):
    """Token-aware score over pairs that lose none above the floor."""
    q = noisy_names(t).select(S.normalize_name(F.col("text")).alias("q")).distinct()
    k = wide_catalog(t).select(S.normalize_name(F.col("name")).alias("key")).distinct()
    return (fuzzy.token_pairs(q, k, 82.0).withColumn("score", fuzzy.composite_score(F.col("q"), F.col("key")))
            .filter(F.col("score") >= 82 - 1e-9).withColumn("score", F.round("score", 4)))
