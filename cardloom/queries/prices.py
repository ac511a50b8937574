"""Price snapshots, payload parsing, logs and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import prices, stats
from cardloom.queries.registry import query
from cardloom.queries.stats import LOG, VERIFIED, snapshot_log
from cardloom.plans.session import fresh_folder, stage
from cardloom.sources import logs, payloads, upserts
from cardloom.sources.keyed_table import KeyedTable

LATEST = "latest AS (SELECT match_id, usd_low, usd_high FROM card_price WHERE snapshot_id = 2)"
_NOW = "TIMESTAMP '2001-01-03 00:00:00'"


def latest_prices(t):
    return t.prices.filter("snapshot_id = 2")


@query("C2", "enrich_prices", f"""WITH {LATEST} SELECT c.pull_id, c.row_index, c.match_id, l.usd_low, l.usd_high
FROM pull_card c LEFT JOIN latest l ON c.match_id = l.match_id""")
def _enrich(t):
    return prices.enrich(t.cards, latest_prices(t)).select("pull_id", "row_index", "match_id", "usd_low", "usd_high")


@query("C3", "price_diff", """SELECT n.match_id, n.set_id, round((o.usd_low + o.usd_high) / 2, 6) AS old, round((n.usd_low + n.usd_high) / 2, 6) AS new,
  round(((n.usd_low + n.usd_high) - (o.usd_low + o.usd_high)) / (o.usd_low + o.usd_high), 6) AS pct
FROM card_price n JOIN card_price o ON n.match_id = o.match_id AND n.snapshot_id = 2 AND o.snapshot_id = 1
WHERE (o.usd_low + o.usd_high) <> 0 AND abs(((n.usd_low + n.usd_high) - (o.usd_low + o.usd_high)) / (o.usd_low + o.usd_high)) >= 0.5""")
def _diff(t):
    d = prices.price_diff(t.prices.filter("snapshot_id = 1"), latest_prices(t))
    return d.select("match_id", "set_id", *[F.round(c, 6).alias(c) for c in ("old", "new", "pct")])


def _payload(t):
    """Price payloads built from card prices; every fifth card quotes a number."""
    p = latest_prices(t).withColumn("k", F.length("match_id") + F.floor("usd_low").cast("int") % 5)
    low = F.when(F.col("k") % 5 == 0, F.lit("n/a"))
    doc = F.to_json(F.struct(
        F.struct(F.array(F.struct(F.col("usd_low").alias("market_price")), F.struct(F.col("usd_high").alias("market_price")))
                 .alias("prices")).alias("tcgplayer"),
        F.struct(F.array(F.struct(F.lit(None).cast("double").alias("trend")), F.struct(F.col("usd_low").alias("trend")))
                 .alias("prices")).alias("cardmarket")))
    broken = F.regexp_replace(doc, r'"market_price":([0-9.E]+)', '"market_price":"$1"')
    return p.select("match_id", F.when(low.isNotNull(), broken).otherwise(doc).alias("payload"))


@query("D9", "extract_prices", f"""WITH {LATEST}, k AS (SELECT *, (length(match_id) + CAST(floor(usd_low) AS INT) % 5) % 5 = 0 AS quoted FROM latest)
SELECT match_id, CASE WHEN NOT quoted THEN usd_low END AS usd_low, CASE WHEN NOT quoted THEN usd_high END AS usd_high, usd_low AS eur_trend FROM k""")
def _extract(t):
    return _payload(t).select("match_id", prices.extract_prices(F.col("payload")).alias("p")).select("match_id", "p.*")


@query("D10", "card_universe", """WITH b AS (SELECT match_id, set_id, card_number, name, CASE WHEN pull_id % 2 = 0 THEN 0 ELSE 1 END AS pref FROM pull_card)
SELECT match_id, set_id, card_number, name FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pref, set_id, card_number, name) AS r FROM b) x WHERE r = 1""")
def _universe(t):
    c = t.cards_unordered
    return prices.card_universe(c.filter("pull_id % 2 = 1"), c.filter("pull_id % 2 = 0"))


@query("D11", "staleness_gate", f"""WITH {LOG} SELECT max(created_at) AS newest, {_NOW} >= max(created_at) + INTERVAL 7 DAY AS due FROM log WHERE status = 'done'""")
def _stale(t):
    return prices.needs_refresh(snapshot_log(t), F.lit("2001-01-03 00:00:00").cast("timestamp_ntz"))


@query("D12", "pull_value", f"""WITH {LATEST} SELECT c.pull_id, round(sum((usd_low + usd_high) / 2), 8) AS value
FROM pull_card c LEFT JOIN latest l ON c.match_id = l.match_id GROUP BY 1""")
def _value(t):
    return prices.pull_value(t.cards_unordered, latest_prices(t), digits=8)


@query("D13", "collection_value", f"""WITH {LATEST}, q AS (SELECT p.trainer_id, c.match_id, count(*) AS qty FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id GROUP BY 1, 2)
SELECT trainer_id, CAST(sum(qty) AS BIGINT) AS total_qty, round(sum((usd_low + usd_high) / 2 * qty), 8) AS value,
  CASE WHEN count(usd_low) > 0 THEN '2000-12-30' END AS priced_as_of FROM q LEFT JOIN latest l ON q.match_id = l.match_id GROUP BY 1""")
def _collection_value(t):
    rows = (t.submissions.select("pull_id", "trainer_id").join(t.cards_unordered.select("pull_id", "match_id"), "pull_id")
            .groupBy("trainer_id", "match_id").agg(F.count(F.lit(1)).alias("qty")))
    return prices.collection_value(rows, latest_prices(t), F.lit("2000-12-30"), digits=8)


@query("G5", "union_with_precedence", """WITH b AS (SELECT set_id, num, name, 0 AS pref FROM pull_card UNION ALL SELECT set_id, CAST(local_id AS INT), name, 1 FROM catalog_card)
SELECT set_id, num, min(CASE WHEN pref = m THEN name END) AS name FROM (SELECT *, min(pref) OVER (PARTITION BY set_id, num) AS m FROM b) x GROUP BY 1, 2""")
def _precedence(t):
    both = t.cards_unordered.select("set_id", "num", "name", F.lit(0).alias("pref")).unionByName(
        t.catalog.select("set_id", F.col("local_id").cast("int").alias("num"), "name", F.lit(1).alias("pref")))
    return both.groupBy("set_id", "num").agg(F.min(F.struct("pref", "name")).alias("b")).select("set_id", "num", "b.name")


@query("G6", "distinct_keys", "SELECT DISTINCT match_id, set_id FROM pull_card")
def _distinct(t):
    return t.cards_unordered.select("match_id", "set_id").distinct()


# -- sources ---------------------------------------------------------------------------

@query("A2", "flatten_catalog", "SELECT set_id, set_id || '-' || local_id AS card_id, local_id, name, official_count FROM catalog_card")
def _flatten(t):
    nested = (t.catalog.groupBy("set_id").agg(
        F.first("official_count").alias("official"), F.collect_list(F.struct(F.col("local_id").alias("localId"), "name")).alias("cards"))
        .select(F.to_json(F.struct(F.col("set_id").alias("id"), F.struct("official").alias("cardCount"), "cards")).alias("payload")))
    sets, cards = payloads.flatten_catalog(nested, "payload")
    return cards.join(sets.select("set_id", "official_count"), "set_id")


@query("A3", "set_lookups", """
SELECT 'denominator' AS lookup, upper(denominator) AS key, set_id FROM set_denominator
UNION ALL SELECT 'code', upper(set_code), min(set_id) FROM set_dim GROUP BY 2
UNION ALL SELECT 'promo_prefix', upper(promo_prefix), min(set_id) FROM set_dim WHERE promo_prefix <> '' GROUP BY 2""")
def _lookups(t):
    out = [df.withColumn("lookup", F.lit(k)) for k, df in payloads.set_lookups(t.sets).items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def keyed(t, name, keys):
    return KeyedTable(t.spark, fresh_folder(t.spark, name), keys, buckets=8)


@query("A6", "upsert_update", """
WITH tab AS (SELECT set_id, num, min(name) AS name, min(unit_price) AS price, min(l_shipdate) AS first_seen, min(l_shipdate) AS updated_at FROM pull_card WHERE pull_id % 2 = 0 GROUP BY 1, 2),
new AS (SELECT * FROM (SELECT set_id, num, name, unit_price AS price, row_number() OVER (PARTITION BY set_id, num ORDER BY l_shipdate DESC, pull_id DESC, unit_price) AS r
        FROM pull_card WHERE pull_id % 2 = 1) x WHERE r = 1)
SELECT coalesce(t.set_id, n.set_id) AS set_id, coalesce(t.num, n.num) AS num, CASE WHEN t.set_id IS NULL THEN n.name ELSE t.name END AS name,
  CASE WHEN n.set_id IS NOT NULL THEN n.price ELSE t.price END AS price,
  CASE WHEN t.set_id IS NULL THEN TIMESTAMP '2002-01-01 00:00:00' ELSE t.first_seen END AS first_seen,
  CASE WHEN n.set_id IS NOT NULL THEN TIMESTAMP '2002-01-01 00:00:00' ELSE t.updated_at END AS updated_at
FROM tab t FULL JOIN new n ON t.set_id = n.set_id AND t.num = n.num""")
def _upsert(t):
    c = t.cards_unordered
    table = c.filter("pull_id % 2 = 0").groupBy("set_id", "num").agg(
        F.min("name").alias("name"), F.min("unit_price").alias("price"),
        F.min("l_shipdate").alias("first_seen"), F.min("l_shipdate").alias("updated_at"))
    rows = c.filter("pull_id % 2 = 1").withColumnRenamed("unit_price", "price").select(
        "set_id", "num", "name", "price", "l_shipdate", "pull_id")
    now = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    stored = keyed(t, "upsert", ["set_id", "num"]).create(table)
    stored.merge(rows, lambda old, new: upserts.upsert_update(old, new, ["set_id", "num"], ["price"], now, [F.desc("l_shipdate"), F.desc("pull_id"), "price"]))
    return stored.read()


@query("A7", "upsert_ignore", """
WITH tab AS (SELECT match_id, min(name) AS name FROM pull_card WHERE pull_id % 2 = 0 GROUP BY 1),
new AS (SELECT match_id, min(name) AS name FROM pull_card WHERE pull_id % 2 = 1 AND num % 9 <> 0 GROUP BY 1)
SELECT * FROM tab UNION ALL SELECT * FROM new WHERE match_id NOT IN (SELECT match_id FROM tab)""")
def _ignore(t):
    c = t.cards_unordered
    table = c.filter("pull_id % 2 = 0").groupBy("match_id").agg(F.min("name").alias("name"))
    rows = c.filter("pull_id % 2 = 1").select(F.when(F.col("num") % 9 != 0, F.col("match_id")).alias("match_id"), "name")
    stored = keyed(t, "ignore", ["match_id"]).create(table)
    stored.merge(rows, lambda old, new: upserts.upsert_ignore(old, new, ["match_id"], ["name"]))
    return stored.read()


@query("A8", "upsert_count", """
WITH ev AS (SELECT p.trainer_id, c.set_id || ':' || CAST(c.num AS VARCHAR) AS identity_key, c.name, c.species, c.l_shipdate AS moment, c.pull_id, c.row_index
            FROM pull p JOIN pull_card c ON p.pull_id = c.pull_id),
tab AS (SELECT trainer_id, identity_key, min(name) AS name, min(species) AS species, count(*) AS qty, max(moment) AS updated_at FROM ev WHERE pull_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT trainer_id, identity_key, count(*) AS n, max(moment) AS last_at,
   arg_min(name, (moment, pull_id, row_index)) AS name, arg_min(species, (moment, pull_id, row_index)) AS first_species,
   arg_max(species, (moment, pull_id, row_index)) AS species FROM ev WHERE pull_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(t.trainer_id, s.trainer_id) AS trainer_id, coalesce(t.identity_key, s.identity_key) AS identity_key,
  CASE WHEN t.trainer_id IS NULL THEN s.name ELSE t.name END AS name, CASE WHEN s.n IS NOT NULL THEN s.species ELSE t.species END AS species,
  coalesce(t.qty, 0) + coalesce(s.n, 0) AS qty, coalesce(s.last_at, t.updated_at) AS updated_at,
  CASE WHEN t.trainer_id IS NULL THEN 'added' WHEN s.n IS NOT NULL THEN 'incremented' ELSE 'kept' END AS outcome
FROM tab t FULL JOIN s ON t.trainer_id = s.trainer_id AND t.identity_key = s.identity_key""")
def _count(t):
    ev = (t.cards.join(t.submissions.select("pull_id", "trainer_id"), "pull_id")
          .withColumn("identity_key", F.concat("set_id", F.lit(":"), F.col("num").cast("string")))
          .withColumnRenamed("l_shipdate", "updated_at"))
    keys = ["trainer_id", "identity_key"]
    table = ev.filter("pull_id % 2 = 0").groupBy(*keys).agg(
        F.min("name").alias("name"), F.min("species").alias("species"), F.count(F.lit(1)).alias("qty"),
        F.max("updated_at").alias("updated_at"))
    stored, order = keyed(t, "count", keys).create(table), ["updated_at", "pull_id", "row_index"]
    saves = ev.filter("pull_id % 2 = 1")
    outcome = stage(upserts.upsert_count(stored.read(), saves, keys, order).select(*keys, "outcome"), "outcome")
    stored.merge(saves, lambda old, new: upserts.upsert_count(old, new, keys, order).drop("outcome"))
    return stored.read().join(outcome, keys)


@query("A9", "rebuild_dimension", """
WITH o AS (SELECT set_code, set_name, catalog_id FROM set_dim), f AS (SELECT CASE WHEN n <= 3 THEN 'N' || set_code ELSE set_code END AS set_code, upper(set_name) AS set_name, CASE WHEN n % 2 = 0 THEN catalog_id END AS catalog_id FROM set_dim)
SELECT coalesce(f.set_code, o.set_code) AS set_code, coalesce(f.set_name, o.set_name) AS set_name, coalesce(f.catalog_id, o.catalog_id) AS catalog_id
FROM o FULL JOIN f ON o.set_code = f.set_code""")
def _rebuild(t):
    s = t.sets.select("n", "set_code", "set_name", "catalog_id")
    fresh = s.select(F.when(F.col("n") <= 3, F.concat(F.lit("N"), "set_code")).otherwise(F.col("set_code")).alias("set_code"), F.upper("set_name").alias("set_name"),
                                     F.when(F.col("n") % 2 == 0, F.col("catalog_id")).alias("catalog_id"))
    stored = keyed(t, "dimension", ["set_code"]).create(s.drop("n"))
    stored.merge(fresh, lambda old, new: upserts.rebuild_dimension(new, old, "set_code", "catalog_id"))
    return stored.read()


@query("A11", "extract_links", """
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s+href="(/[^"]*)"[^>]*>([^<]*)</a>', 1) AS h,
             regexp_extract_all(html, '<a\\s+href="(/[^"]*)"[^>]*>([^<]*)</a>', 2) AS x FROM pages),
l AS (SELECT page_id, url, unnest(h) AS href, unnest(x) AS txt, unnest(range(len(h))) AS pos FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS r FROM l WHERE regexp_matches(href, '^/[^/?#]+$'))
SELECT page_id, substr(href, 2) AS slug, CASE WHEN trim(txt) <> '' THEN trim(txt) ELSE substr(href, 2) END AS name,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || substr(href, 2) AS link FROM f WHERE r = 1""".replace("\\\\", "\\"))
def _links(t):
    return logs.extract_links(t.table("pages"))


@query("A12", "parse_card_payload", """
SELECT event_id, CASE WHEN pos = 1 THEN 7 ELSE pos END AS row_index, CAST(pos AS VARCHAR) || '/050' AS card_number,
  CASE WHEN pos = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS confidence
FROM events, (SELECT unnest([0, 1, 2]) AS pos) p WHERE event_id % 5 <> 0 AND pos <= event_id % 3
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 5 = 0""")
def _cards_json(t):
    n = (F.col("event_id") % 3).cast("int")
    parts = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(
        F.lit('{"card_number":"'), i.cast("string"), F.lit('/050"'),
        F.when(i == 1, F.lit(',"row_index":7')).otherwise(F.lit("")),
        F.when(i == 0, F.lit(',"confidence":0.5')).otherwise(F.lit("")), F.lit("}"))), ",")
    doc = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), parts, F.lit(",{oops]"))).otherwise(
        F.concat(F.lit("["), parts, F.lit("]")))
    cards, rejects = payloads.parse_card_payload(t.table("events").select("event_id", doc.alias("doc")), "doc")
    return cards.select("event_id", "row_index", "card_number", "confidence").unionByName(
        rejects.select("event_id"), allowMissingColumns=True)


def timing_lines(t):
    return t.table("events").select(F.concat(
        F.lit("INFO timing.pack."), "event_type", F.lit(" scan="), F.col("user_id").cast("string"), F.lit(" ms="),
        F.format_string("%.2f", "value"), F.lit(" cold=1")).alias("value"))


@query("A13", "parse_timing_log", """SELECT 'pack' AS flow, event_type AS stage, CAST(user_id AS VARCHAR) AS scan, count(*) AS n, round(sum(value), 2) AS ms
FROM events WHERE value >= 0 GROUP BY 1, 2, 3""")
def _timing(t):
    """Log files of a folder, read as text."""
    folder = fresh_folder(t.spark, "logs")
    timing_lines(t).write.text(folder)
    return logs.parse_timing(logs.read_lines(t.spark, folder)).groupBy("flow", "stage", "scan").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ms"), 2).alias("ms"))


@query("D34", "latency_percentiles", """SELECT 'pack' AS flow, event_type AS stage, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max_ms, count(*) AS n FROM (SELECT event_type, round(value, 2) AS v FROM events WHERE value >= 0) e GROUP BY 1, 2""")
def _latency(t):
    return logs.latency(logs.parse_timing(timing_lines(t))).select(
        "flow", "stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max_ms", "n")


@query("A14", "search_results", """
WITH p AS (SELECT pull_id % 40 AS asked, CASE WHEN pull_id % 40 < 10 AND (num % 5 <> 0 OR pull_id % 2 = 0) THEN -1 WHEN num % 5 = 0 THEN NULL ELSE pull_id % 40 END AS got, match_id FROM pull_card),
k AS (SELECT asked, match_id FROM p WHERE got IS NULL OR got = asked),
alt AS (SELECT pull_id % 40 AS asked, 'alt-' || match_id AS match_id FROM pull_card)
SELECT asked, match_id, 'primary' AS source, count(*) AS n FROM k GROUP BY 1, 2
UNION ALL SELECT asked, match_id, 'alternate', count(*) FROM alt WHERE asked NOT IN (SELECT asked FROM k) GROUP BY 1, 2""")
def _pages(t):
    asked = F.col("pull_id") % 40
    got = (F.when((asked < 10) & ((F.col("num") % 5 != 0) | (asked % 2 == 0)), F.lit(-1).cast("bigint"))
           .when(F.col("num") % 5 == 0, None).otherwise(asked))
    primary = t.cards_unordered.select(asked.alias("asked_set"), got.alias("set_id"), "match_id")
    alternate = t.cards_unordered.select(
        asked.alias("asked_set"), asked.alias("set_id"), F.concat(F.lit("alt-"), "match_id").alias("match_id"))
    out = payloads.search_results(primary, alternate)
    return out.groupBy(F.col("asked_set").alias("asked"), "match_id", "source").agg(F.count(F.lit(1)).alias("n"))
