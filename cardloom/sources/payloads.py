"""Semi-structured inputs: card payload JSON, catalogs, result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CARD_ROW = ("array<struct<row_index: int, card_number: string, set_id: string, name: string, "
            "rarity: string, match_id: string, confidence: double>>")
CARD_JSON = "struct<id: string, card_info: struct<name: string, clean_name: string, rarity: string>>"
SET_JSON = ("struct<id: string, name: string, cardCount: struct<official: int>, "
            "cards: array<struct<localId: string, name: string>>>")


def card_fields(payload: Column) -> Column:
    """STRUCT(name, rarity, match_id) of a card payload; '' counts as missing."""
    p = F.from_json(payload, CARD_JSON)
    return F.struct(
        F.coalesce(F.nullif(p["card_info"]["name"], F.lit("")), p["card_info"]["clean_name"]).alias("name"),
        p["card_info"]["rarity"].alias("rarity"), p["id"].alias("match_id"))


def parse_card_payload(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(cards, rejects) of a JSON array column. A malformed array is rejected whole;
    ``row_index`` defaults to the position and ``confidence`` to 0."""
    parsed = df.withColumn("__rows", F.try_variant_get(F.try_parse_json(payload), "$", CARD_ROW))
    rejects = parsed.filter(F.col("__rows").isNull()).drop("__rows")
    cards = (parsed.select(*[c for c in df.columns if c != payload],
                           F.posexplode("__rows").alias("__pos", "__c"))
             .select("*", "__c.*")
             .withColumns({"row_index": F.coalesce("row_index", "__pos"),
                           "confidence": F.coalesce("confidence", F.lit(0.0))})
             .drop("__pos", "__c"))
    return cards, rejects


def flatten_catalog(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(set rows, card rows) of nested set payloads; local ids become strings."""
    s = df.select(F.from_json(payload, SET_JSON).alias("s"))
    sets = s.select(F.col("s.id").alias("set_id"), F.col("s.name").alias("set_name"),
                    F.col("s.cardCount.official").alias("official_count"))
    cards = (s.select(F.col("s.id").alias("set_id"), F.explode("s.cards").alias("c"))
              .select("set_id", F.concat("set_id", F.lit("-"), "c.localId").alias("card_id"),
                      F.col("c.localId").alias("local_id"), F.col("c.name").alias("name")))
    return sets, cards


def search_results(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Rows of paged searches whose set id is the asked one (or missing); a set whose
    primary pages yield nothing falls back to the alternate source."""
    def kept(df):
        return df.filter(F.col("set_id").isNull() | (F.col("set_id") == F.col("asked_set")))

    first = kept(primary).withColumn("source", F.lit("primary"))
    rest = (kept(alternate).withColumn("source", F.lit("alternate"))
            .join(first.select("asked_set").distinct(), "asked_set", "left_anti"))
    return first.unionByName(rest)


def set_lookups(sets: DataFrame) -> dict[str, DataFrame]:
    """Three inverted lookups of the set dimension, keys upper-cased, blanks dropped:
    denominator -> many, code -> one, promo prefix -> one."""
    def one(column):
        return (sets.filter(F.nullif(F.trim(column), F.lit("")).isNotNull())
                    .groupBy(F.upper(F.trim(column)).alias("key"))
                    .agg(F.min("set_id").alias("set_id")))

    many = sets.select(F.explode("denominators").alias("d"), "set_id").select(
        F.upper("d").alias("key"), "set_id").distinct()
    return {"denominator": many, "code": one("set_code"), "promo_prefix": one("promo_prefix")}


def read_set_dimension(spark, path: str) -> DataFrame:
    """Set dimension from a JSON document ``{"sets": [...]}``; blanks become NULL."""
    schema = ("sets array<struct<set_id: string, set_code: string, set_name: string, era: string, "
              "denominators: array<string>, promo_prefix: string, catalog_id: string, "
              "local_id_prefixed: boolean>>")
    df = (spark.read.schema(schema).json(path, multiLine=True)
          .select(F.explode("sets").alias("s")).select("s.*"))
    blank = {c: F.nullif(F.trim(c), F.lit("")) for c in ("set_code", "promo_prefix", "catalog_id")}
    return df.withColumns({**blank, "local_id_prefixed": F.coalesce("local_id_prefixed", F.lit(False))})
