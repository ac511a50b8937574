"""Scalar functions (H rows), each run over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import names as S, numbers as N
from cardloom.operators import datasets, vectors
from cardloom.queries.registry import query

# Printed-number spellings derived from every card row.
_MESSY = """CASE (num + length(name)) % 8 WHEN 0 THEN ' gg' || lpad(CAST(num AS STRING), 2, '0') || ' '
  WHEN 1 THEN 'SWSH' || lpad(CAST(num AS STRING), 3, '0') WHEN 2 THEN lpad(CAST(num AS STRING), 3, '0') || '/050'
  WHEN 3 THEN '000' WHEN 4 THEN CAST(num AS STRING) || 'a' WHEN 5 THEN '' WHEN 6 THEN NULL
  ELSE 'tg' || CAST(num AS STRING) || '/TG30' END"""
_CARDS = f"(SELECT *, {_MESSY} AS raw FROM pull_card) c"


def _tally(t, *cols, base=None):
    df = (base if base is not None else t.cards_unordered).withColumn("raw", F.expr(_MESSY))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def _scalar(row, name, fn, sql_expr):
    query(row, name, f"SELECT raw, {sql_expr} AS out, count(*) AS n FROM {_CARDS} GROUP BY 1, 2")(
        lambda t: _tally(t, "raw", fn(F.col("raw")).alias("out")))


_scalar("H1", "normalize_local_id", N.normalize_local_id,
        r"regexp_replace(upper(trim(coalesce(raw, ''))), '^([A-Z]*)0*(\d+)$', '\1\2')")
_scalar("H2", "normalize_numerator", N.normalize_numerator,
        "CASE WHEN raw IS NULL THEN '0' WHEN ltrim(raw, '0') = '' THEN '0' ELSE upper(ltrim(raw, '0')) END")
_scalar("H3", "number_key", N.number_key,
        "CASE WHEN raw <> '' THEN coalesce(nullif(ltrim(upper(trim(split_part(raw, '/', 1))), '0'), ''), '0') END")
_scalar("H4", "collection_numerator", N.collection_numerator,
        "coalesce(nullif(ltrim(trim(split_part(raw, '/', 1)), '0'), ''), nullif(trim(split_part(raw, '/', 1)), ''))")
_scalar("H5", "catalog_tail_id", N.catalog_tail_id,
        r"regexp_replace(upper(trim(raw)), '^([A-Z]*?)0*(\d+)$', '\1\2')")
_scalar("H20", "alpha_prefix", N.alpha_prefix,
        "upper(regexp_extract(coalesce(raw, ''), '^[A-Za-z]+', 0))")

_KEY = """CASE num % 5 WHEN 0 THEN 'sv0' || CAST(num % 9 AS STRING) || '-' || lpad(CAST(num AS STRING), 3, '0')
  WHEN 1 THEN 'swsh12.5-GG' || CAST(num AS STRING) WHEN 2 THEN 'sm' || CAST(num % 9 AS STRING) || '.5-000'
  WHEN 3 THEN 'swsh3.5-' || CAST(num AS STRING) ELSE 'promo-' || CAST(num AS STRING) END"""


@query("H6", "reference_key", f"""
SELECT key, CASE WHEN starts_with(key, 'sv0') THEN 'sv' || substr(key, 4, 1) || '-' || ltrim(split_part(key, '-', 2), '0')
  WHEN starts_with(key, 'swsh12.5-') THEN 'swsh12pt5-' || split_part(key, '-', 2)
  WHEN starts_with(key, 'sm') THEN replace(split_part(key, '-', 1), '.5', 'pt5') || '-0'
  WHEN starts_with(key, 'swsh3.5-') THEN 'swsh35-' || split_part(key, '-', 2) END AS out, count(*) AS n
FROM (SELECT {_KEY} AS key FROM pull_card) k GROUP BY 1, 2""")
def _reference_key(t):
    df = t.cards_unordered.withColumn("key", F.expr(_KEY))
    return df.groupBy("key", N.reference_key(F.col("key")).alias("out")).agg(F.count(F.lit(1)).alias("n"))


@query("H7", "catalog_local_id", r"""
SELECT c.set_id, raw, CASE WHEN raw IS NULL THEN NULL
    WHEN promo_prefix IS NULL OR NOT regexp_matches(s, '^(' || promo_prefix || ')?\d+$')
      THEN lpad(s, CAST(greatest(3, length(s)) AS INT), '0')
    ELSE CASE WHEN local_id_prefixed THEN promo_prefix ELSE '' END
      || lpad(CAST(CAST(replace(s, promo_prefix, '') AS INT) AS VARCHAR), 3, '0') END AS out, count(*) AS n
FROM (SELECT *, upper(trim(raw)) AS s FROM """ + _CARDS + r""") c JOIN set_dim d ON c.set_id = d.set_id
GROUP BY 1, 2, 3""")
def _catalog_local_id(t):
    df = t.cards_unordered.join(t.sets.select("set_id", "promo_prefix", "local_id_prefixed"), "set_id")
    out = N.catalog_local_id(F.expr(_MESSY), F.col("promo_prefix"), F.col("local_id_prefixed"))
    return _tally(t, "set_id", "raw", out.alias("out"), base=df)


@query("H8", "normalize_name", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(text || ' ♀ ★', '♀', ' f'), '★', ''))),
  '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS out FROM documents""".replace("\\\\", "\\"))
def _normalize_name(t):
    text = F.concat(F.col("text"), F.lit(" ♀ ★"))
    return t.table("documents").select("doc_id", F.md5(S.normalize_name(text)).alias("out"))


_TITLE = """CASE num % 6 WHEN 0 THEN initcap_name || ' VMAX' WHEN 1 THEN 'Radiant ' || initcap_name
  WHEN 2 THEN 'Erika''s ' || species WHEN 3 THEN species || ' & Friend-GX' WHEN 4 THEN 'Shiny ' || species || ' ex (Full Art)'
  ELSE species || ' Prism Star' END"""


@query("H9", "species_of", f"""
SELECT title, CASE WHEN num % 6 IN (2, 3, 4, 5) THEN sp END AS species, count(*) AS n
FROM (SELECT {_TITLE} AS title, num, species AS sp
      FROM (SELECT num, species, name AS initcap_name FROM pull_card) a) b GROUP BY 1, 2""")
def _species_of(t):
    cards = t.cards_unordered.withColumn("initcap_name", F.col("name"))
    known = (t.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("display"))
             .distinct().withColumn("key", S.alnum_key(F.col("display"))))
    titled = (cards.select(F.expr(_TITLE).alias("title"))
              .groupBy("title").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("key", S.species_key(F.col("title"))))
    return titled.join(known, "key", "left").select("title", F.col("display").alias("species"), "n")


@query("H10", "set_name_keys", """
SELECT set_id, regexp_replace(replace(lower(set_name), '&', 'and'), '[^a-z0-9]', '', 'g') AS compact,
       trim(regexp_replace(regexp_replace(replace(lower(set_name), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS words
FROM set_dim""".replace("\\\\", "\\"))
def _set_name_keys(t):
    return t.sets.select("set_id", S.set_name_key(F.col("set_name")).alias("compact"),
                         S.set_name_words(F.col("set_name")).alias("words"))


@query("H11", "normalize_code", """
SELECT trainer_id, nullif(upper(regexp_replace(handle || '-x y', '[^A-Za-z0-9]', '', 'g')), '') AS out FROM trainer""")
def _normalize_code(t):
    return t.trainers.select("trainer_id", N.normalize_code(F.concat("handle", F.lit("-x y"))).alias("out"))


@query("H12", "parse_number", """
SELECT pull_id, row_index, text, numerator, denominator, prefix, confidence, pattern_ok,
       len(regexp_split_to_array(trim(up), '\\s+')) AS n_tokens FROM reading""".replace("\\\\", "\\"))
def _parse_number(t):
    return t.readings.select("pull_id", "row_index", "text", "numerator", "denominator", "prefix",
                             "confidence", "pattern_ok", F.size("tokens").cast("bigint").alias("n_tokens"))


@query("H14", "matched_token_confidence", """
SELECT pull_id, row_index, CASE WHEN strpos(trim(card_number), ' ') > 0 THEN 0.3
   WHEN num % 3 = 0 THEN CAST(0.3 AS DOUBLE) ELSE (50 + num) / 100.0 END AS out FROM pull_card""")
def _token_confidence(t):
    tokens = F.array(F.struct(F.when(F.col("num") % 3 == 0, F.lit("4012")).otherwise(F.col("card_number")).alias("text"),
                              (F.col("num") + 50).cast("double").alias("conf")),
                     F.struct(F.lit("EN").alias("text"), F.lit(99.0).alias("conf")))
    return t.cards.select("pull_id", "row_index",
                          N.matched_token_confidence(tokens, F.col("card_number")).alias("out"))


@query("H15", "card_number_forms", """
SELECT pull_id, row_index, CASE WHEN prefix IS NOT NULL AND numerator IS NOT NULL THEN prefix || numerator ELSE numerator END AS lookup,
   CASE WHEN prefix IS NOT NULL AND numerator IS NOT NULL THEN prefix || numerator
        WHEN numerator IS NOT NULL AND denominator IS NOT NULL THEN numerator || '/' || denominator END AS shown,
   CASE WHEN denominator IS NOT NULL THEN lpad(numerator, CAST(greatest(3, length(numerator)) AS INT), '0') || '/' || denominator ELSE numerator END AS identity_shown
FROM reading""")
def _number_forms(t):
    num, den, pre = F.col("numerator"), F.col("denominator"), F.col("prefix")
    return t.readings.select("pull_id", "row_index", N.lookup_number(num, pre).alias("lookup"),
                             N.display_number(num, den, pre).alias("shown"),
                             N.identity_display_number(num, den).alias("identity_shown"))


@query("H16", "identity_keys", """
WITH k AS (SELECT pull_id, row_index, CASE WHEN num % 4 = 0 THEN '' ELSE set_id END AS code,
    CASE WHEN num % 3 = 0 THEN ltrim(split_part(card_number, '/', 1), '0') END AS numb,
    CASE WHEN num % 5 = 0 THEN '' ELSE name END AS nm FROM pull_card)
SELECT pull_id, row_index, CASE WHEN code = '' AND numb IS NULL AND nm = '' THEN NULL
   ELSE CASE WHEN code = '' THEN '?' ELSE code END || ':' || coalesce(numb, CASE WHEN nm = '' THEN 'unknown' ELSE nm END) END AS live_key,
   CASE WHEN code = '' THEN '?' ELSE code END || ':' || coalesce(numb, nm) AS saved_key FROM k""")
def _identity_keys(t):
    code = F.when(F.col("num") % 4 == 0, "").otherwise(F.col("set_id"))
    number = F.when(F.col("num") % 3 == 0, N.collection_numerator(F.col("card_number")))
    name = F.when(F.col("num") % 5 == 0, "").otherwise(F.col("name"))
    none = F.lit(None).cast("string")
    return t.cards.select("pull_id", "row_index",
                          S.live_identity_key(code, none, number, name).alias("live_key"),
                          S.saved_identity_key(code, none, number, name).alias("saved_key"))


@query("H17", "catalog_card_id", """
SELECT c.pull_id, c.row_index, d.catalog_id || '-' || CASE WHEN promo_prefix IS NOT NULL AND local_id_prefixed THEN promo_prefix ELSE '' END
   || lpad(CAST(num AS VARCHAR), 3, '0') AS card_id
FROM pull_card c JOIN set_dim d ON c.set_id = d.set_id""")
def _catalog_card_id(t):
    from cardloom.operators.collection import catalog_card_id
    cards = t.cards.withColumns({
        "by_id": F.when(F.col("num") % 2 == 0, F.col("set_id")),
        "by_code": F.lower(F.concat(F.lit("C"), F.substring("set_id", 2, 2))),
        "numerator": N.collection_numerator(F.col("card_number"))})
    return catalog_card_id(cards, t.sets, "by_id", "by_code", "numerator").select(
        "pull_id", "row_index", "card_id")


@query("H18", "fields_from_payload", """
SELECT pull_id, row_index, CASE WHEN num % 4 = 0 THEN upper(name) ELSE name END AS out_name, rarity AS out_rarity,
   'https://img.example/' || replace(name, ' ', '%20') || '.png' AS image_url, match_id AS out_id FROM pull_card""")
def _payload_fields(t):
    from cardloom.sources.payloads import card_fields
    card = F.to_json(F.struct(
        F.col("match_id").alias("id"),
        F.struct(F.when(F.col("num") % 4 != 0, F.col("name")).alias("name"),
                 F.upper("name").alias("clean_name"), F.col("rarity")).alias("card_info")))
    f = card_fields(card)
    url = F.concat(F.lit("https://img.example/"),
                   F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")), F.lit(".png"))
    return t.cards.select("pull_id", "row_index", f["name"].alias("out_name"),
                          f["rarity"].alias("out_rarity"), url.alias("image_url"),
                          f["match_id"].alias("out_id"))


@query("H19", "sanitize_query", """
SELECT conv_id, turn, CASE WHEN length(q) >= 2 THEN md5(q) END AS out FROM (
  SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s\\-/]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 120) AS q
  FROM conversations) c""".replace("\\\\", "\\"))
def _sanitize_query(t):
    return t.table("conversations").select("conv_id", "turn",
                                           F.md5(S.sanitize_query(F.col("text"))).alias("out"))


@query("H21", "handle_rules", """
SELECT trainer_id, lower(trim(h)) AS handle, regexp_matches(lower(trim(h)), '^[a-z0-9_]{3,20}$') AS ok
FROM (SELECT trainer_id, ' ' || upper(handle) || CASE WHEN trainer_id % 3 = 0 THEN '!' ELSE '' END AS h FROM trainer) x""")
def _handles(t):
    h = F.concat(F.lit(" "), F.upper("handle"),
                 F.when(F.col("trainer_id") % 3 == 0, "!").otherwise(""))
    return t.trainers.select("trainer_id", S.normalize_handle(h).alias("handle"), S.handle_valid(h).alias("ok"))


_TAG = """CASE num % 6 WHEN 0 THEN 'STAGE ' || CAST(num % 3 AS STRING) WHEN 1 THEN 'Basic' WHEN 2 THEN 'HP'
  WHEN 3 THEN CAST(num AS STRING) WHEN 4 THEN 'Basic ' || name ELSE name END"""


@query("H22", "noise_names", f"""
SELECT tag, starts_with(tag, 'STAGE') OR tag = 'Basic' AS stage,
       starts_with(tag, 'STAGE') OR tag IN ('Basic', 'HP') OR regexp_matches(tag, '^[0-9]+$') AS noise, count(*) AS n
FROM (SELECT {_TAG} AS tag FROM pull_card) c GROUP BY 1, 2, 3""")
def _noise(t):
    df = t.cards_unordered.select(F.expr(_TAG).alias("tag"))
    return df.groupBy("tag", S.is_stage_label(F.col("tag")).alias("stage"),
                      S.is_noise_name(F.col("tag")).alias("noise")).agg(F.count(F.lit(1)).alias("n"))


@query("H23", "display_from_slug", """
SELECT slug, CASE slug WHEN 'ho-oh' THEN 'Ho-Oh' ELSE upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) END AS out,
       count(*) AS n
FROM (SELECT CASE WHEN num % 9 = 0 THEN 'ho-oh' ELSE replace(name, ' ', '-') END AS slug,
             split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM pull_card) c GROUP BY 1, 2""")
def _slugs(t):
    slug = F.when(F.col("num") % 9 == 0, "ho-oh").otherwise(F.replace("name", F.lit(" "), F.lit("-")))
    df = t.cards_unordered.select(slug.alias("slug"))
    return df.groupBy("slug", S.display_from_slug(F.col("slug")).alias("out")).agg(F.count(F.lit(1)).alias("n"))


@query("H24", "deterministic_split", """
SELECT pull_id, CASE WHEN pull_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM pull""")
def _split(t):
    return t.submissions.select("pull_id", datasets.deterministic_split(F.col("pull_id")).alias("split"))


@query("H25", "l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1], 6) AS first FROM (
  SELECT vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-8)) AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 7)) AS w FROM embeddings) a) b""")
def _l2(t):
    raw = F.transform("embedding", lambda x: x.cast("double") * (F.lit(1) + F.col("vec_id") % 7))
    v = t.table("embeddings").select("vec_id", vectors.l2_normalize(raw).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"),
                    F.round(F.col("v")[0], 6).alias("first"))


@query("H27", "guide_scale", """
SELECT pull_id, n_guides, CASE WHEN n_guides BETWEEN 2 AND 20 AND gap >= 1 THEN first_guide END AS first_guide,
       CASE WHEN n_guides BETWEEN 2 AND 20 AND gap >= 1 THEN gap END AS median_gap FROM (
  SELECT pull_id, 1 + pull_id % 22 AS n_guides, round(CAST(10 * 600 AS DOUBLE) / 1200, 6) AS first_guide,
         round(CAST((pull_id % 5) * 3 * 600 AS DOUBLE) / 1200, 6) AS gap FROM pull) g""")
def _guides(t):
    from cardloom.operators.layout import guide_scale
    n = (F.lit(1) + F.col("pull_id") % 22).cast("int")
    meta = F.to_json(F.struct(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.lit(10) + (n - 1 - i) * (F.col("pull_id") % 5) * 3).cast("string"))
         .alias("guide_positions"),
        F.array(F.lit(800), F.lit(1200)).alias("image_dims")))
    df = t.submissions.select("pull_id", n.cast("bigint").alias("n_guides"), meta.alias("meta"))
    return guide_scale(df, "meta", F.lit(600.0)).select(
        "pull_id", "n_guides", F.round(F.col("guides")[0], 6).alias("first_guide"),
        F.round("median_gap", 6).alias("median_gap"))
