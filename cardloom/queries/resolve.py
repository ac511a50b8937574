"""Set and card resolution, consensus and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import numbers as N
from cardloom.operators import layout, resolve
from cardloom.plans.skew import ordinal
from cardloom.plans.session import stage
from cardloom.queries.registry import query

_CODES = "code AS (SELECT upper(set_code) AS k, set_id FROM set_dim)"
_DEN = "den AS (SELECT upper(denominator) AS k, min(set_id) AS set_id, count(DISTINCT set_id) AS owners FROM set_denominator GROUP BY 1)"
# Hash winners of shared denominators are stood in for by the true set.
RESOLVED = f"""{_CODES}, {_DEN},
promo AS (SELECT upper(promo_prefix) AS k, min(set_id) AS set_id FROM set_dim WHERE promo_prefix IS NOT NULL GROUP BY 1),
tok AS (SELECT pull_id, row_index, unnest(regexp_split_to_array(trim(up), '\\s+')) AS tok, generate_subscripts(regexp_split_to_array(trim(up), '\\s+'), 1) AS pos FROM reading),
ct AS (SELECT pull_id, row_index, arg_min(c.set_id, pos) AS set_id FROM tok JOIN code c ON tok.tok = c.k GROUP BY 1, 2),
res AS (SELECT r.*, CASE WHEN prefix IS NOT NULL THEN CASE WHEN p.set_id IS NOT NULL THEN 'promo_prefix' ELSE 'unresolved' END
    WHEN ct.set_id IS NOT NULL THEN 'code_text' WHEN den.owners = 1 THEN 'denominator_unique'
    WHEN den.owners > 1 AND num % 2 = 0 THEN 'symbol_tiebreak' ELSE 'unresolved' END AS method,
  CASE WHEN prefix IS NOT NULL THEN p.set_id WHEN ct.set_id IS NOT NULL THEN ct.set_id WHEN den.owners = 1 THEN den.set_id
    WHEN den.owners > 1 AND num % 2 = 0 THEN true_set END AS resolved_set,
  CASE WHEN prefix IS NULL AND ct.set_id IS NULL AND den.owners > 1 AND num % 2 = 0 THEN num % 10 END AS margin
  FROM reading r LEFT JOIN promo p ON r.prefix = p.k LEFT JOIN ct ON r.pull_id = ct.pull_id AND r.row_index = ct.row_index LEFT JOIN den ON upper(r.denominator) = den.k)""".replace("\\\\", "\\")


def resolved(t):
    tie = t.readings.filter("num % 2 = 0").select(
        "pull_id", "row_index", F.col("true_set").alias("set_id"), (F.col("num") % 10).alias("margin"))
    return resolve.resolve_set(t.readings, t.sets, ["pull_id", "row_index"], tie)


_CAT_SQL = """cat AS (SELECT catalog_id, n, CASE WHEN n < 6 THEN 'REALM and RIFT ' || CAST(n AS VARCHAR) WHEN n < 8 THEN 'Realm & Rift ' || CAST(n AS VARCHAR) || ': Extended'
    WHEN n = 8 THEN 'Realm & Rift 9' ELSE 'Realm & Rift ' || CAST(n AS VARCHAR) END AS name, CASE WHEN n = 7 THEN 99 ELSE 50 + n % 9 END AS official_count FROM set_dim)"""


def catalog_sets(t):
    """Catalog sets whose names partly differ from ours."""
    n = F.col("n")
    text = F.concat(F.lit("Realm & Rift "), n.cast("string"))
    name = (F.when(n < 6, F.concat(F.lit("REALM and RIFT "), n.cast("string"))).when(n < 8, F.concat(text, F.lit(": Extended")))
            .when(n == 8, "Realm & Rift 9").otherwise(text))
    return t.sets.select("catalog_id", "n", name.alias("name"), F.when(n == 7, 99).otherwise(F.lit(50) + n % 9).alias("official_count"))


_MAP = _CAT_SQL + """,
o AS (SELECT set_id, regexp_replace(replace(lower(set_name), '&', 'and'), '[^a-z0-9]', '', 'g') AS k FROM set_dim),
c AS (SELECT catalog_id, regexp_replace(replace(lower(name), '&', 'and'), '[^a-z0-9]', '', 'g') AS k, official_count FROM cat),
ex AS (SELECT set_id, count(*) AS n, min(catalog_id) AS c FROM o JOIN c ON o.k = c.k GROUP BY 1),
fb AS (SELECT set_id, count(*) AS n, min(catalog_id) AS c FROM (SELECT DISTINCT o.set_id, c.catalog_id FROM o JOIN set_denominator d ON o.set_id = d.set_id
   JOIN c ON TRY_CAST(regexp_replace(d.denominator, '[^0-9]', '', 'g') AS INT) = c.official_count WHERE contains(o.k, c.k) OR contains(c.k, o.k)) x GROUP BY 1),
mp AS (SELECT o.set_id, CASE WHEN ex.n = 1 THEN 'name' WHEN ex.n > 1 THEN 'ambiguous' WHEN fb.n = 1 THEN 'name+count' ELSE 'unmapped' END AS method,
  CASE WHEN ex.n = 1 THEN ex.c WHEN ex.n > 1 THEN NULL WHEN fb.n = 1 THEN fb.c END AS catalog_id,
  CASE WHEN ex.n = 1 THEN CAST(1.0 AS DOUBLE) WHEN ex.n > 1 THEN NULL WHEN fb.n = 1 THEN CAST(0.8 AS DOUBLE) END AS confidence
  FROM o LEFT JOIN ex ON o.set_id = ex.set_id LEFT JOIN fb ON o.set_id = fb.set_id)"""


def set_map(t):
    return resolve.map_sets(t.sets, catalog_sets(t))[0]


@query("C6", "map_sets", f"WITH {_MAP} SELECT * FROM mp")
def _map_sets(t):
    return set_map(t)


def catalog_cards(t):
    """Catalog cards keyed by catalog set id (promo set 3 carries its prefix)."""
    c = t.catalog.join(t.sets.select("set_id", "catalog_id", "n"), "set_id")
    return c.withColumn("local_id", F.when(F.col("n") == 3, F.concat(F.lit("SWSH"), "local_id"))
                        .when(F.col("name").startswith("small"), F.concat("local_id", F.lit("x"))).otherwise(F.col("local_id")))


_CC = """cc AS (SELECT d.catalog_id, c.set_id, c.card_id, c.name, c.official_count, CASE WHEN d.n = 3 THEN 'SWSH' || c.local_id WHEN starts_with(c.name, 'small') THEN c.local_id || 'x' ELSE c.local_id END AS local_id
   FROM catalog_card c JOIN set_dim d ON c.set_id = d.set_id)"""


@query("C7", "map_cards", f"""WITH {_MAP}, {_CC},
l AS (SELECT catalog_id, regexp_replace(upper(trim(local_id)), '^([A-Z]*?)0*(\\d+)$', '\\1\\2') AS k, count(DISTINCT card_id) AS hits, min(card_id) AS card_id FROM cc GROUP BY 1, 2),
k AS (SELECT DISTINCT match_id, set_id, lpad(CAST(num AS VARCHAR), 3, '0') AS numerator FROM pull_card)
SELECT k.match_id, k.set_id, CASE WHEN mp.catalog_id IS NULL THEN 'set_unmapped' WHEN l.hits IS NULL THEN 'none' WHEN l.hits > 1 THEN 'ambiguous' ELSE 'mapped' END AS outcome,
  CASE WHEN l.hits = 1 THEN l.card_id END AS card_id
FROM k LEFT JOIN mp ON k.set_id = mp.set_id LEFT JOIN l ON mp.catalog_id = l.catalog_id AND l.k = regexp_replace(k.numerator, '^([A-Z]*?)0*(\\d+)$', '\\1\\2')""".replace("\\\\", "\\"))
def _map_cards(t):
    cached = t.cards_unordered.select("match_id", "set_id", F.lpad(F.col("num").cast("string"), 3, "0").alias("numerator")).distinct()
    return resolve.map_cards(cached, set_map(t), catalog_cards(t)).select("match_id", "set_id", "outcome", "card_id")


@query("B17", "set_listing", "SELECT set_id, set_code, set_name, era, list_aggregate(list_sort(d), 'string_agg', ',') AS denominators FROM set_dim s JOIN (SELECT set_id AS sid, list(denominator) AS d FROM set_denominator GROUP BY 1) x ON s.set_id = x.sid")
def _listing(t):
    return t.sets.select("set_id", "set_code", "set_name", "era", F.array_join("denominators", ",").alias("denominators"))


_SLUG = "s AS (SELECT DISTINCT set_id || '-' || CAST(num % 3 AS VARCHAR) AS slug, CASE num % 4 WHEN 0 THEN '-1' WHEN 1 THEN 'x' WHEN 2 THEN '0' ELSE CAST(num AS VARCHAR) END AS source_id FROM pull_card)"


@query("B18", "valid_source_ids", f"""WITH {_SLUG} SELECT slug, source_id, CASE WHEN substr(slug, 1, 3) NOT IN (SELECT set_id FROM set_dim) OR substr(slug, 5) = '2' THEN 'unknown_slug'
   WHEN TRY_CAST(source_id AS INT) > 0 THEN 'kept' ELSE 'placeholder_id' END AS outcome FROM s""")
def _valid_ids(t):
    num = F.col("num")
    rows = t.cards_unordered.select(F.concat("set_id", F.lit("-"), (num % 3).cast("string")).alias("slug"),
                                    F.when(num % 4 == 0, "-1").when(num % 4 == 1, "x").when(num % 4 == 2, "0")
                                    .otherwise(num.cast("string")).alias("source_id")).distinct()
    slugs = t.sets.select(F.explode(F.array(*[F.concat("set_id", F.lit(f"-{i}")) for i in (0, 1)])).alias("slug"))
    good, bad = resolve.valid_source_ids(rows, slugs)
    return good.withColumn("outcome", F.lit("kept")).unionByName(bad.withColumnRenamed("reason", "outcome"))


@query("C4", "lookup_exact", """
WITH k AS (SELECT set_id, num, CASE WHEN pull_id % 3 = 0 THEN 'Realm' WHEN pull_id % 3 = 1 THEN NULL ELSE 'Other' END AS set_name, match_id || '/' || CAST(pull_id AS VARCHAR) AS match_id, l_shipdate FROM pull_card),
q AS (SELECT pull_id AS request_id, 'S' || lpad(CAST(pull_id % 12 AS VARCHAR), 2, '0') AS set_id, CAST(pull_id % 60 AS INT) AS num, CASE WHEN pull_id % 2 = 0 THEN 'realm & rift' END AS asked FROM pull)
SELECT q.request_id, arg_max(k.match_id, (k.l_shipdate, k.match_id)) AS match_id FROM q LEFT JOIN k ON q.set_id = k.set_id AND q.num = k.num
  AND (q.asked IS NULL OR k.set_name IS NULL OR contains(q.asked, lower(k.set_name)) OR contains(lower(k.set_name), q.asked)) GROUP BY 1""")
def _lookup(t):
    pid = F.col("pull_id")
    cards = t.cards_unordered.select("set_id", F.col("num").cast("string").alias("numerator"),
                                     F.when(pid % 3 == 0, "Realm").when(pid % 3 == 2, "Other").alias("set_name"),
                                     F.concat("match_id", F.lit("/"), pid.cast("string")).alias("match_id"),
                                     F.col("l_shipdate").alias("last_fetched"))
    asked = t.submissions.select(pid.alias("request_id"), F.concat(F.lit("S"), F.lpad((pid % 12).cast("string"), 2, "0")).alias("set_id"),
                                 F.lpad((pid % 60).cast("string"), 3, "0").alias("number"),
                                 F.when(pid % 2 == 0, "realm & rift").alias("set_name"))
    return resolve.lookup_exact(asked, cards).select("request_id", "match_id")


@query("C5", "resolve_set", f"WITH {RESOLVED} SELECT pull_id, row_index, method, resolved_set, CAST(margin AS INT) AS margin FROM res")
def _resolve(t):
    return resolved(t).select("pull_id", "row_index", "method", "resolved_set", F.col("margin").cast("int").alias("margin"))


@query("C26", "resolve_set_query", f"""WITH {_CAT_SQL},
q AS (SELECT DISTINCT CASE pull_id % 7 WHEN 0 THEN 's' || lpad(CAST(pull_id % 12 AS VARCHAR), 2, '0') WHEN 1 THEN 'c' || lpad(CAST(pull_id % 12 AS VARCHAR), 2, '0')
   WHEN 2 THEN 'realm & rift ' || CAST(pull_id % 12 AS VARCHAR) WHEN 3 THEN 'CAT' || CAST(pull_id % 12 AS VARCHAR) WHEN 4 THEN 'extended'
   WHEN 5 THEN CAST(pull_id % 12 AS VARCHAR) || ': ext' ELSE 'zz' || CAST(pull_id % 12 AS VARCHAR) END AS q FROM pull),
h AS (SELECT q, 1 AS tier, set_id FROM q JOIN set_dim ON lower(q) IN (lower(set_id), lower(set_code)) UNION ALL SELECT q, 2, set_id FROM q JOIN set_dim ON lower(q) = lower(set_name)
  UNION ALL SELECT q, 3, catalog_id FROM q JOIN cat ON lower(q) IN (lower(catalog_id), lower(name)) UNION ALL SELECT q, 4, catalog_id FROM q JOIN cat ON contains(lower(name), lower(q))),
p AS (SELECT q, tier, count(DISTINCT set_id) AS hits, min(set_id) AS set_id FROM h GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier) AS r FROM p) x WHERE r = 1)
SELECT q.q, b.tier, CASE WHEN NOT (tier = 4 AND hits > 1) THEN set_id END AS set_id, CASE WHEN b.q IS NULL THEN 'unknown' WHEN tier = 4 AND hits > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome,
  CASE WHEN tier = 4 AND hits > 1 THEN hits END AS candidates, CASE WHEN tier = 4 AND hits > 1 THEN (SELECT array_to_string(list(c.name ORDER BY c.name)[1:5], '; ') FROM cat c WHERE contains(lower(c.name), lower(q.q))) END AS candidate_names
FROM q LEFT JOIN b ON q.q = b.q""")
def _set_query(t):
    pid = F.col("pull_id")
    two, plain = F.lpad((pid % 12).cast("string"), 2, "0"), (pid % 12).cast("string")
    q = (F.when(pid % 7 == 0, F.concat(F.lit("s"), two)).when(pid % 7 == 1, F.concat(F.lit("c"), two))
         .when(pid % 7 == 2, F.concat(F.lit("realm & rift "), plain)).when(pid % 7 == 3, F.concat(F.lit("CAT"), plain))
         .when(pid % 7 == 4, "extended").when(pid % 7 == 5, F.concat(plain, F.lit(": ext"))).otherwise(F.concat(F.lit("zz"), plain)))
    return resolve.resolve_set_query(t.submissions.select(q.alias("q")), t.sets, catalog_sets(t))


@query("C32", "reverse_crosswalk", f"""WITH {_MAP} SELECT cat.catalog_id, min(mp.set_id) AS source_id FROM cat LEFT JOIN mp ON cat.catalog_id = mp.catalog_id GROUP BY 1""")
def _reverse(t):
    return resolve.reverse_crosswalk(catalog_sets(t).select("catalog_id"), set_map(t)).select("catalog_id", "source_id")


@query("C33", "payloads_by_ids", "SELECT event_id, props FROM events WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _payloads(t):
    ids = t.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return resolve.payloads_by_ids(t.table("events").select("event_id", "props"), ids, "event_id")


@query("C34", "art_reference_rows", """
WITH r AS (SELECT set_id, card_id, CASE WHEN name LIKE '%e%' OR set_id < 'S06' THEN 'https://img.example/' || card_id END AS image_url FROM catalog_card)
SELECT r.set_id, card_id, image_url, n AS refs, n < 40 AS partial FROM r JOIN (SELECT set_id, count(image_url) AS n FROM r GROUP BY 1) c ON r.set_id = c.set_id WHERE image_url IS NOT NULL""")
def _art(t):
    rows = t.catalog.select("set_id", "card_id", F.when(F.col("name").contains("e") | (F.col("set_id") < "S06"),
                                                        F.concat(F.lit("https://img.example/"), "card_id")).alias("image_url"))
    return resolve.art_reference_rows(rows)


# -- consensus -----------------------------------------------------------------------------

_MODE_DEN = """dn AS (SELECT pull_id, denominator, count(*) AS n, min(row_index) AS p FROM reading WHERE regexp_matches(denominator, '^[0-9]+$') GROUP BY 1, 2),
canon AS (SELECT pull_id, denominator AS canonical, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY pull_id ORDER BY n DESC, p, denominator) AS r,
   sum(n) OVER (PARTITION BY pull_id) AS tot FROM dn) x WHERE r = 1 AND n >= greatest(2, (tot + 1) // 2))"""


@query("D16", "modal_denominator", f"WITH {_MODE_DEN} SELECT * FROM canon")
def _modal_den(t):
    return resolve.modal_denominator(t.readings)


@query("D17", "snap_denominators", f"""WITH {_MODE_DEN} SELECT r.pull_id, r.row_index,
  CASE WHEN prefix IS NULL AND denominator IS NOT NULL AND canonical IS NOT NULL THEN canonical ELSE denominator END AS denominator,
  coalesce(prefix IS NULL AND numerator IS NOT NULL AND denominator <> canonical, FALSE) AS fixed FROM reading r LEFT JOIN canon c ON r.pull_id = c.pull_id""")
def _snap(t):
    return resolve.snap_denominators(t.readings, resolve.modal_denominator(t.readings)).select("pull_id", "row_index", "denominator", "fixed")


_DOM = """dv AS (SELECT pull_id, resolved_set AS set_id, count(*) AS n, min(row_index) AS p FROM res WHERE resolved_set IS NOT NULL GROUP BY 1, 2),
dom AS (SELECT pull_id, set_id, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY pull_id ORDER BY n DESC, p, set_id) AS r FROM (
   SELECT *, sum(n) OVER (PARTITION BY pull_id) AS tot FROM dv) y WHERE n >= greatest(2, (tot + 1) // 2) AND set_id IN (SELECT set_id FROM numerators)) x WHERE r = 1)"""
_NUMS = _MAP + f""", {_CC}, numerators AS (SELECT DISTINCT mp.set_id, CASE WHEN regexp_matches(local_id, '^[0-9]+$') THEN coalesce(nullif(ltrim(local_id, '0'), ''), '0')
   WHEN regexp_matches(local_id, '^[A-Z]+[0-9]+$') THEN regexp_replace(local_id, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') END AS numerator
   FROM mp JOIN cc ON mp.catalog_id = cc.catalog_id WHERE regexp_matches(local_id, '^[A-Z]*[0-9]+$'))"""


def numerators(t):
    return resolve.set_numerators(set_map(t), catalog_cards(t).drop("set_id"))


def votes(t):
    return resolved(t).select("pull_id", "row_index", F.col("resolved_set").alias("set_id"))


@query("D22", "set_numerators", f"WITH {_NUMS} SELECT * FROM numerators")
def _numerators(t):
    return numerators(t)


@query("D18", "dominant_set_with_catalog", f"WITH {RESOLVED}, {_NUMS}, {_DOM} SELECT pull_id, set_id, CAST(votes AS BIGINT) AS votes FROM dom")
def _dominant(t):
    return resolve.dominant_set_with_catalog(votes(t), numerators(t))


_CELLS = "cells AS (SELECT *, num % 4 = 0 OR resolved_set IS NULL AS needs_review FROM res)"


def cells(t):
    """Resolved readings as page cells (page = pull)."""
    return resolved(t).withColumn("needs_review", (F.col("num") % 4 == 0) | F.col("resolved_set").isNull())


_PAGE = f"""{RESOLVED}, {_CELLS}, pv AS (SELECT pull_id, resolved_set AS set_id, count(*) AS n FROM cells WHERE NOT needs_review GROUP BY 1, 2),
pm AS (SELECT pull_id, max(set_id) AS set_id, max(n) AS votes FROM (SELECT *, max(n) OVER (PARTITION BY pull_id) AS m FROM pv) x WHERE n = m GROUP BY 1 HAVING count(*) = 1 AND max(n) >= 2),
page AS (SELECT pm.*, d.set_name, CASE WHEN q.k = 1 THEN q.d END AS denominator FROM pm JOIN set_dim d ON pm.set_id = d.set_id
   JOIN (SELECT set_id, count(*) AS k, min(denominator) AS d FROM set_denominator GROUP BY 1) q ON q.set_id = pm.set_id)"""


def page_prior(t):
    return resolve.page_modal(cells(t).withColumn("set_id", F.col("resolved_set")), t.sets, "pull_id")


@query("D19", "page_modal", f"WITH {_PAGE} SELECT pull_id, set_id, votes, set_name, denominator FROM page")
def _page_modal(t):
    return page_prior(t)


@query("D20", "session_prior", """
WITH s AS (SELECT pull_id AS session_id, row_index, set_id, num % 5 <> 0 AS ok, split_part(card_number, '/', 2) AS d0, num FROM pull_card),
a AS (SELECT session_id, set_id FROM (SELECT session_id, set_id, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(row_index), set_id) AS r FROM s WHERE ok GROUP BY 1, 2) x WHERE r = 1),
d AS (SELECT session_id, den FROM (SELECT session_id, den, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(row_index), den) AS r FROM (
   SELECT session_id, row_index, CASE WHEN num % 3 = 0 THEN '051' ELSE d0 END AS den FROM s WHERE num % 7 <> 0) y GROUP BY 1, 2) x WHERE r = 1)
SELECT coalesce(a.session_id, d.session_id) AS session_id, a.set_id, CASE WHEN a.set_id IS NOT NULL THEN 'name ' || a.set_id END AS set_name, d.den AS denominator FROM a FULL JOIN d ON a.session_id = d.session_id""")
def _session_prior(t):
    num = F.col("num")
    s = t.cards.select(F.col("pull_id").alias("session_id"), "row_index", F.when(num % 5 != 0, "ok").otherwise("pending_vlm").alias("state"),
                       "set_id", F.concat(F.lit("name "), "set_id").alias("set_name"),
                       F.when(num % 7 == 0, None).when(num % 3 == 0, F.concat(num.cast("string"), F.lit("/051"))).otherwise(F.col("card_number")).alias("card_number"))
    return resolve.session_prior(s)


@query("D21", "printed_denominators", """SELECT set_id, upper(denominator) AS denominator, count(*) AS cards FROM (SELECT true_set AS set_id, trim(split_part(text, '/', 2)) AS denominator FROM reading_text WHERE contains(text, '/')) x GROUP BY 1, 2 HAVING count(*) >= 3""")
def _printed(t):
    return resolve.printed_denominators(t.reading_texts.select(F.col("true_set").alias("set_id"), F.col("text").alias("card_number")))


_OWN = "own AS (SELECT regexp_replace(upper(denominator), '^([A-Z]*)0*([0-9]+)$', '\\1\\2') AS den_key, count(DISTINCT set_id) AS owners, CASE WHEN count(DISTINCT set_id) = 1 THEN min(set_id) END AS owner FROM set_denominator GROUP BY 1)"


@query("D23", "denominator_owners", f"WITH {_OWN} SELECT * FROM own")
def _owners(t):
    return resolve.denominator_owners(t.sets)


_PRIOR_OK = """CASE WHEN prefix IS NOT NULL THEN coalesce((SELECT max(set_id) FROM set_dim WHERE promo_prefix = prefix) = true_set, FALSE)
  WHEN denominator IS NULL THEN TRUE ELSE coalesce(own.owner = true_set, FALSE) END"""


@query("B12", "prior_denominator_ok", f"""WITH {_OWN}, pp AS (SELECT promo_prefix, min(set_id) AS ps FROM set_dim WHERE promo_prefix IS NOT NULL GROUP BY 1)
SELECT pull_id, row_index, CASE WHEN prefix IS NOT NULL THEN coalesce(ps = true_set, FALSE) WHEN denominator IS NULL THEN TRUE ELSE coalesce(own.owner = true_set, FALSE) END AS prior_ok
FROM reading r LEFT JOIN own ON own.den_key = regexp_replace(r.denominator, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') LEFT JOIN pp ON pp.promo_prefix = r.prefix""")
def _prior_ok(t):
    return resolve.prior_denominator_ok(t.readings.withColumn("prior_set", F.col("true_set")), t.sets).select(
        "pull_id", "row_index", "prior_ok")


@query("D35", "prefix_audit", f"""WITH {_CC} SELECT d.set_id, d.promo_prefix, d.local_id_prefixed, count(local_id) AS cards, count(*) FILTER (WHERE starts_with(local_id, promo_prefix)) AS carrying,
  CASE WHEN count(local_id) = 0 THEN 'empty' WHEN (2 * count(*) FILTER (WHERE starts_with(local_id, promo_prefix)) > count(local_id)) = d.local_id_prefixed THEN 'ok' ELSE 'mismatch' END AS verdict
FROM set_dim d LEFT JOIN cc ON d.catalog_id = cc.catalog_id WHERE d.promo_prefix IS NOT NULL GROUP BY 1, 2, 3""")
def _audit(t):
    return resolve.prefix_audit(t.sets.select("set_id", "promo_prefix", "local_id_prefixed", "catalog_id"), catalog_cards(t))


@query("D37", "request_hints", f"""WITH {RESOLVED}, m AS (SELECT pull_id, set_id FROM (SELECT pull_id, resolved_set AS set_id, row_number() OVER (PARTITION BY pull_id ORDER BY count(*) DESC, min(row_index), resolved_set) AS r
   FROM res WHERE resolved_set IS NOT NULL GROUP BY 1, 2) x WHERE r = 1)
SELECT m.pull_id, m.set_id, d.set_name AS hint_set, CASE WHEN q.k = 1 THEN q.d END AS hint_denominator FROM m JOIN set_dim d ON m.set_id = d.set_id
JOIN (SELECT set_id, count(*) AS k, min(denominator) AS d FROM set_denominator GROUP BY 1) q ON q.set_id = m.set_id""")
def _hints(t):
    from cardloom.operators.stats import modal_set
    return resolve.request_hints(modal_set(votes(t)), t.sets).select("pull_id", "set_id", "hint_set", "hint_denominator")


@query("D38", "row_count_warning", """SELECT pull_id, CASE WHEN pull_id % 2 = 0 THEN CASE WHEN n <> 4 THEN 'detected ' || CAST(n AS VARCHAR) || ' rows, declared 4' END
  WHEN n NOT BETWEEN 5 AND 13 THEN 'detected ' || CAST(n AS VARCHAR) || ' rows (expected 5-13)' END AS warning FROM (SELECT pull_id, count(*) AS n FROM pull_card GROUP BY 1) x""")
def _warning(t):
    n = t.cards_unordered.groupBy("pull_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("pull_id", layout.row_count_warning(F.col("n"), F.when(F.col("pull_id") % 2 == 0, 4)).alias("warning"))


@query("D39", "build_name_index", """SELECT lower(name) AS name_key, set_id, local_id, name, official_count, count(*) OVER (PARTITION BY lower(name)) AS printings,
  row_number() OVER (PARTITION BY lower(name) ORDER BY set_id, local_id) = 1 AS is_first FROM catalog_card""")
def _name_index(t):
    return resolve.build_name_index(t.catalog)


@query("F4", "catalog_order", f"""WITH {_CC} SELECT set_id, local_id, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN starts_with(local_id, 'SWSH') THEN 'SWSH' ELSE '' END,
  CAST(regexp_extract(local_id, '[0-9]+') AS INT), local_id) AS position FROM cc""")
def _catalog_order(t):
    order = resolve.catalog_order(F.col("local_id"))
    return ordinal(catalog_cards(t).select("set_id", "local_id"), ["set_id"], order,
                   [order[0], F.floor(order[1] / 100)], "position")


@query("G4", "missing_keys", "SELECT DISTINCT set_id || '-' || CAST(num AS VARCHAR) AS key FROM pull_card WHERE set_id || '-' || CAST(num AS VARCHAR) NOT IN (SELECT card_id FROM catalog_card)")
def _missing(t):
    return resolve.missing_keys(t.cards_unordered.select(F.col("match_id").alias("key")), t.catalog.select(F.col("card_id").alias("key")), "key")


_FIXED = """vn AS (SELECT DISTINCT set_id, CAST(CAST(local_id AS INT) AS VARCHAR) AS v FROM catalog_card ),
rd AS (SELECT * REPLACE (CASE WHEN num % 3 = 0 AND regexp_matches(numerator, '^[0-9]+$') THEN '9' || substr(numerator, 2) ELSE numerator END AS numerator) FROM reading),
r0 AS (SELECT pull_id, row_index, true_set, prefix, numerator, CASE WHEN prefix IS NULL AND regexp_matches(numerator, '^[0-9]+$') THEN coalesce(nullif(ltrim(numerator, '0'), ''), '0') END AS n FROM rd),
w AS (SELECT DISTINCT true_set AS set_id, n FROM r0 WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vn WHERE vn.set_id = true_set AND vn.v = n)),
fx AS (SELECT w.set_id, w.n, min(v) AS fix FROM w JOIN vn ON vn.set_id = w.set_id AND length(vn.v) = length(w.n) AND hamming(vn.v, w.n) = 1 GROUP BY 1, 2 HAVING count(*) = 1)"""


@query("C11", "correct_numerators", f"""WITH {_FIXED} SELECT pull_id, row_index, coalesce(fix, numerator) AS numerator, fix IS NOT NULL AS corrected FROM r0 LEFT JOIN fx ON fx.set_id = true_set AND fx.n = r0.n""")
def _correct(t):
    local = F.col("local_id").cast("int")
    valid = t.catalog.select("set_id", local.cast("string").alias("numerator")).distinct()
    numerator = F.col("numerator")
    misread = F.when((F.col("num") % 3 == 0) & numerator.rlike("^[0-9]+$"), F.concat(F.lit("9"), F.substring(numerator, 2, 99))).otherwise(numerator)
    readings = t.readings.withColumn("set_id", F.col("true_set")).withColumn("numerator", misread)
    return resolve.correct_numerators(readings, valid).select(
        "pull_id", "row_index", "numerator", "corrected")


@query("B10", "needs_review", f"""WITH {RESOLVED}, {_NUMS}, {_DOM},
x AS (SELECT r.*, dom.set_id AS ms, d.promo_prefix AS mp_prefix, d.local_id_prefixed AS mpf, coalesce(r.prefix, '') = coalesce(d.promo_prefix, '') AS same FROM res r LEFT JOIN dom ON r.pull_id = dom.pull_id LEFT JOIN set_dim d ON dom.set_id = d.set_id),
y AS (SELECT *, CASE WHEN same AND mp_prefix IS NOT NULL THEN CASE WHEN mpf THEN mp_prefix ELSE '' END || CAST(TRY_CAST(numerator AS INT) AS VARCHAR)
    ELSE coalesce(prefix, '') || CAST(TRY_CAST(numerator AS INT) AS VARCHAR) END AS k FROM x)
SELECT pull_id, row_index, CASE WHEN NOT pattern_ok OR resolved_set IS NULL THEN TRUE WHEN ms IS NOT NULL AND regexp_matches(numerator, '^[0-9]+$')
  THEN NOT EXISTS (SELECT 1 FROM numerators n WHERE n.set_id = ms AND n.numerator = k) ELSE FALSE END AS needs_review FROM y""")
def _review(t):
    # Only what the check reads: the rest of a reading would go through every shuffle.
    r = stage(resolved(t).select("pull_id", "row_index", "pattern_ok", "numerator", "prefix", "resolved_set"), "resolved")
    numbers = stage(numerators(t), "numerators")
    dom = resolve.dominant_set_with_catalog(r.select("pull_id", "row_index", F.col("resolved_set").alias("set_id")), numbers)
    return resolve.needs_review(r, dom, numbers, t.sets).select("pull_id", "row_index", "needs_review")


@query("B11", "number_agrees", """
SELECT pull_id, row_index, CASE WHEN promo_set IS NULL THEN lid = regexp_replace(coalesce(upper(numerator), ''), '^([A-Z]*)0*([0-9]+)$', '\\1\\2')
   ELSE promo_set = true_set AND lid = CASE WHEN pf THEN prefix ELSE '' END || CAST(CAST(numerator AS INT) AS VARCHAR) END AS agrees FROM (
  SELECT r.*, d.set_id AS promo_set, d.local_id_prefixed AS pf, CASE WHEN true_set = 'S03' THEN 'SWSH' ELSE '' END || CAST(CASE WHEN num % 9 = 0 THEN num + 1 ELSE num END AS VARCHAR) AS lid
  FROM reading r LEFT JOIN set_dim d ON d.promo_prefix = r.prefix) x""")
def _agrees(t):
    promo = t.sets.filter("promo_prefix IS NOT NULL").select(F.col("promo_prefix").alias("prefix"), F.col("set_id").alias("promo_set"), "local_id_prefixed")
    r = t.readings.join(promo, "prefix", "left")
    num = F.when(F.col("num") % 9 == 0, F.col("num") + 1).otherwise(F.col("num"))
    lid = F.concat(F.when(F.col("true_set") == "S03", "SWSH").otherwise(""), F.lpad(num.cast("string"), 3, "0"))
    return r.select("pull_id", "row_index", resolve.number_agrees(
        lid, F.col("true_set"), F.col("numerator"), F.col("promo_set"), F.col("prefix"), F.col("local_id_prefixed")).alias("agrees"))


_SCORED = """sc AS (SELECT pull_id, row_index, CASE WHEN NOT pattern_ok THEN CASE WHEN num % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE 0.05 END ELSE round(0.5 * confidence + 0.3 * CASE method WHEN 'promo_prefix' THEN 1.0 WHEN 'code_text' THEN 1.0
   WHEN 'denominator_unique' THEN 0.95 WHEN 'symbol_tiebreak' THEN 0.5 + 0.4 * least(1.0, coalesce(margin, 0) / 8.0) ELSE 0.0 END + CASE WHEN num % 3 <> 0 THEN 0.2 ELSE 0.0 END + 1e-7, 3) END AS confidence, method, confidence AS ocr, pattern_ok, num FROM res)"""


def scored(t):
    r = resolved(t)
    s = resolve.score_card(F.col("pattern_ok"), ~F.col("pattern_ok") & (F.col("num") % 2 == 0), F.col("confidence"),
                           F.col("method"), F.col("margin"), F.col("num") % 3 != 0)
    return r.select("pull_id", "row_index", s.alias("s")).select("pull_id", "row_index", "s.*")


@query("D26", "score_card", f"""WITH {RESOLVED}, {_SCORED} SELECT pull_id, row_index, confidence, CASE WHEN NOT pattern_ok THEN CASE WHEN num % 2 = 0 THEN 'unreadable_strip' ELSE 'number_ambiguous' END
  WHEN confidence >= 0.8 THEN NULL WHEN method = 'unresolved' THEN 'set_ambiguous' WHEN num % 3 = 0 THEN 'no_db_match' WHEN ocr < 0.6 THEN 'number_ambiguous' ELSE 'set_ambiguous' END AS reason FROM sc""")
def _score(t):
    return scored(t)


@query("D27", "pack_confidence", f"""WITH {RESOLVED}, {_SCORED} SELECT p.pull_id, coalesce(round(avg(confidence), 8), 0) AS pack_confidence FROM pull p LEFT JOIN sc ON p.pull_id = sc.pull_id GROUP BY 1""")
def _pack(t):
    return resolve.pack_confidence(scored(t), t.submissions, digits=8)


_ANSWERS = "a AS (SELECT pull_id AS batch_id, row_index, CAST(num % 10 AS VARCHAR) || CASE WHEN num % 2 = 0 THEN '/050' ELSE '' END AS number, CASE WHEN num % 4 = 0 THEN NULL ELSE '050' END AS denominator, confidence FROM pull_card)"


@query("D30", "collapse_duplicate_claims", f"""WITH {_ANSWERS} SELECT batch_id, row_index, number, denominator, CASE WHEN count(*) OVER (PARTITION BY batch_id, split_part(number, '/', 1), denominator) >= 3 THEN 0.0 ELSE confidence END AS confidence FROM a""")
def _collapse(t):
    num = F.col("num")
    a = t.cards.select(F.col("pull_id").alias("batch_id"), "row_index", F.concat((num % 10).cast("string"), F.when(num % 2 == 0, "/050").otherwise("")).alias("number"),
                       F.when(num % 4 != 0, "050").alias("denominator"), "confidence")
    return resolve.collapse_duplicate_claims(a)
