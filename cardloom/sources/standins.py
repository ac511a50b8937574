"""Domain views over the driver's tables.

``SQL`` holds the definitions in the dialect both engines share (used as CTEs by
the SQL checks). ``Standins`` builds the same views as DataFrames; where the SQL
ranks inside a group, the DataFrame uses the skew-safe form instead of a window.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardloom.functions import numbers as N
from cardloom.operators import claims, stats
from cardloom.plans.session import stage
from cardloom.plans.skew import ordinal
from cardloom.sources.tables import scan

_PULL_BASE = """
SELECT o_orderkey AS pull_id,
       CASE WHEN o_orderkey % 12 = 3 AND o_custkey % 10 < 6 THEN 7 ELSE o_custkey END AS trainer_id,
       o_orderdate AS created_at,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'live' WHEN '2-HIGH' THEN 'guided' ELSE 'upload' END AS capture_path,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS derive_status,
       'PK' || CAST(o_custkey AS STRING) || 'Y' || CAST(year(o_orderdate) AS STRING) AS code_normalized,
       o_orderstatus <> 'P' AS code_format_ok
FROM {orders}"""

_CARD_BASE = """
SELECT l_orderkey AS pull_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
       'S' || lpad(CAST(CASE WHEN l_discount >= 0.09 THEN l_suppkey % 12 ELSE l_orderkey % 12 END AS STRING), 2, '0') AS set_id,
       p_size AS num, p_name AS name, 1.0 - l_discount * 5 AS confidence,
       l_extendedprice / l_quantity AS unit_price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

_CARD_COLS = """set_id, num, set_id || '-' || CAST(num AS STRING) AS match_id,
       lpad(CAST(num AS STRING), 3, '0') || '/050' AS card_number, name,
       CASE WHEN num <= 25 THEN 'Common' WHEN num <= 38 THEN 'Uncommon' WHEN num <= 46 THEN 'Rare'
            WHEN num <= 49 THEN 'Double Rare' ELSE 'Secret' END AS rarity,
       split_part(name, ' ', 2) AS species, confidence, unit_price, l_shipdate"""

_SET_DIM = """
SELECT set_id, n, 'C' || substr(set_id, 2) AS set_code, 'Realm & Rift ' || CAST(n AS STRING) AS set_name,
       CASE WHEN n < 6 THEN 'first' ELSE 'second' END AS era,
       CASE n WHEN 3 THEN 'SWSH' WHEN 4 THEN 'SVP' WHEN 5 THEN 'MEP' END AS promo_prefix,
       n = 3 AS local_id_prefixed, 'cat' || CAST(n AS STRING) AS catalog_id
FROM (SELECT DISTINCT 'S' || lpad(CAST(o_orderkey % 12 AS STRING), 2, '0') AS set_id,
             CAST(o_orderkey % 12 AS INT) AS n FROM {orders}) t"""

_SET_DENOMINATOR = """
SELECT set_id, lpad(CAST(50 + n % 9 AS STRING), 3, '0') AS denominator FROM {set_dim}
UNION ALL SELECT set_id, 'TG30' AS denominator FROM {set_dim} WHERE n IN (2, 10)"""

_READING_TEXT = """CASE num % 7
    WHEN 0 THEN CASE set_id WHEN 'S03' THEN 'SWSH' WHEN 'S04' THEN 'SVP' WHEN 'S05' THEN 'MEP' ELSE 'mep' END
                || ' ' || lpad(CAST(num AS STRING), 3, '0')
    WHEN 1 THEN 'C' || substr(set_id, 2) || ' EN'
    WHEN 2 THEN 'TG' || lpad(CAST(num AS STRING), 2, '0') || '/TG30'
    WHEN 3 THEN 'ABC HP 120'
    WHEN 4 THEN 'C' || substr(set_id, 2) || ' ' || lpad(CAST(num AS STRING), 3, '0') || '/' ||
         CASE WHEN confidence < 0.6 THEN '0' || CAST((51 + CAST(substr(set_id, 2) AS INT) % 9) AS STRING)
              ELSE '0' || CAST((50 + CAST(substr(set_id, 2) AS INT) % 9) AS STRING) END
    ELSE lpad(CAST(num AS STRING), 3, '0') || ' / 0' || CAST((50 + CAST(substr(set_id, 2) AS INT) % 9) AS STRING) END"""

_OCR = """
SELECT user_id AS page_id, event_id AS line_id, CAST(event_id * 37 % 1000 AS DOUBLE) AS x, CAST(event_id * 91 % 1400 AS DOUBLE) AS y,
       CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id % 50 + 1 AS STRING), 3, '0') || '/050'
            WHEN event_id % 3 = 1 THEN upper(event_type) ELSE 'MEP EN' END AS text,
       CAST(50 + event_id % 50 AS DOUBLE) / 100 AS conf, CAST(60 AS DOUBLE) AS w, CAST(14 + event_id % 5 AS DOUBLE) AS h
FROM {events}"""

_FRAME = """
SELECT user_id AS session_id, event_id AS frame_id, ts, event_type || ':' || CAST(CAST(floor(value) AS INT) % 5 AS STRING) AS identity_key,
       CAST(50 + event_id % 50 AS DOUBLE) / 100 AS confidence, event_type = 'error' AS needs_second_opinion
FROM {events}"""

_CALIBRATION = """
SELECT d.doc_id AS record_id, CAST(50 + (d.doc_id * 37) % 50 AS DOUBLE) / 100 AS confidence,
       (50 + (d.doc_id * 37) % 50) < 80 AS flagged, l.quality = 1 AS correct
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

_NAMES = dict(orders="orders", lineitem="lineitem", part="part", events="events",
              documents="documents", labels="labels", set_dim="set_dim")

#: Shared-dialect definitions, in dependency order.
SQL: dict[str, str] = {
    "trainer": """SELECT c_custkey AS trainer_id, lower(replace(c_name, '#', '_')) AS handle,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'analyst' ELSE 'trainer' END AS role FROM customer""",
    "pull": f"""SELECT pull_id, trainer_id, created_at, capture_path, derive_status, code_normalized, code_format_ok,
       code_format_ok AND row_number() OVER (PARTITION BY code_normalized, code_format_ok
                                             ORDER BY created_at, pull_id) = 1 AS verified
       FROM ({_PULL_BASE.format(**_NAMES)}) t""",
    "pull_card": f"""SELECT pull_id, CAST(row_number() OVER (PARTITION BY pull_id
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS row_index,
       {_CARD_COLS} FROM ({_CARD_BASE.format(**_NAMES)}) t""",
    "card_price": """SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-06-01 00:00:00' THEN 1 ELSE 2 END AS snapshot_id, set_id, match_id,
       min(unit_price) AS usd_low, max(unit_price) AS usd_high FROM pull_card GROUP BY 1, 2, 3""",
    "catalog_card": """SELECT c.set_id, c.set_id || '-' || CAST(p_size AS STRING) AS card_id, lpad(CAST(p_size AS STRING), 3, '0') AS local_id,
       min(p_name) AS name, 50 + CAST(substr(c.set_id, 2) AS INT) % 5 AS official_count
       FROM part JOIN (SELECT DISTINCT set_id FROM pull_card) c
         ON p_partkey % 12 = CAST(substr(c.set_id, 2) AS INT) GROUP BY c.set_id, p_size""",
    "set_dim": _SET_DIM.format(**_NAMES),
    "set_denominator": _SET_DENOMINATOR.format(**_NAMES),
    "reading_text": f"""SELECT pull_id, row_index, set_id AS true_set, num, name, confidence,
       {_READING_TEXT} AS text FROM pull_card""",
    "reading": rf"""SELECT pull_id, row_index, true_set, num, name, text, round(confidence, 3) AS confidence,
       CASE WHEN d <> '' THEN CASE WHEN regexp_matches(d, '^[A-Z]') THEN n ELSE regexp_replace(n, '^[A-Z]+', '') END
            WHEN p <> '' THEN pn END AS numerator,
       CASE WHEN d <> '' THEN d END AS denominator, CASE WHEN d = '' AND p <> '' THEN p END AS prefix,
       (d <> '' OR p <> '') AS pattern_ok, upper(text) AS up
       FROM (SELECT *, regexp_extract(upper(text), '{N.NUMBER_PATTERN}', 1) AS n,
                    regexp_extract(upper(text), '{N.NUMBER_PATTERN}', 2) AS d,
                    regexp_extract(upper(text), '{N.PROMO_PATTERN}', 1) AS p,
                    regexp_extract(upper(text), '{N.PROMO_PATTERN}', 2) AS pn FROM reading_text) t""",
    "ocr_line": _OCR.format(**_NAMES),
    "frame": _FRAME.format(**_NAMES),
    "calibration": _CALIBRATION.format(**_NAMES),
}


class Standins:
    """The views of ``SQL`` as lazily built DataFrames for one (session, folder)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def trainers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS trainer_id", "lower(replace(c_name, '#', '_')) AS handle",
            "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'analyst' ELSE 'trainer' END AS role")

    @cached_property
    def submissions(self) -> DataFrame:
        """Pulls before verification."""
        return self._sql(_PULL_BASE, orders=self.table("orders"))

    @cached_property
    def verified(self) -> DataFrame:
        return claims.first_valid_claim(self.submissions)

    @cached_property
    def pulls(self) -> DataFrame:
        return claims.mark_verified(self.submissions)

    @cached_property
    def cards_unordered(self) -> DataFrame:
        """Cards without ``row_index`` (no shuffle beyond the part join)."""
        base = self._sql(_CARD_BASE, lineitem=self.table("lineitem"), part=self.table("part"))
        return base.selectExpr("pull_id", *_split_columns(_CARD_COLS), "l_linenumber",
                               "l_partkey", "l_suppkey", "l_extendedprice")

    @cached_property
    def verified_cards(self) -> DataFrame:
        """Cards of verified pulls. ``row_index`` is an ordering struct here: enough for
        tie-breaks and cheaper than a rank."""
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        return (self.cards_unordered.withColumn("row_index", order)
                .join(self.verified.select("pull_id", "trainer_id", "created_at"), "pull_id"))

    @cached_property
    def modal(self) -> DataFrame:
        """(pull_id, set_id) of verified pulls, staged: statistics join it several times."""
        return stage(stats.modal_set(self.verified_cards), "modal")

    @cached_property
    def cards(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        ranked = ordinal(self.cards_unordered, ["pull_id"], order,
                         [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 10000)],
                         name="row_index", start=0)
        return ranked.select("pull_id", F.col("row_index").cast("int").alias("row_index"),
                             "set_id", "num", "match_id", "card_number", "name", "rarity",
                             "species", "confidence", "unit_price", "l_shipdate")

    @cached_property
    def prices(self) -> DataFrame:
        snap = F.when(F.col("l_shipdate") < F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"), 1)
        return (self.cards_unordered.groupBy(snap.otherwise(2).alias("snapshot_id"), "set_id", "match_id")
                .agg(F.min("unit_price").alias("usd_low"), F.max("unit_price").alias("usd_high")))

    @cached_property
    def catalog(self) -> DataFrame:
        """Catalog cards, staged: name matching reads them for keys, hazards and printings."""
        return stage(self._sql("""
            SELECT set_id, set_id || '-' || CAST(p_size AS STRING) AS card_id,
                   lpad(CAST(p_size AS STRING), 3, '0') AS local_id, min(p_name) AS name,
                   50 + CAST(substr(set_id, 2) AS INT) % 5 AS official_count
            FROM {part} JOIN {sets} ON p_partkey % 12 = CAST(substr(set_id, 2) AS INT)
            GROUP BY set_id, p_size""",
            part=self.table("part"), sets=self.cards_unordered.select("set_id").distinct()), "catalog")

    @cached_property
    def sets(self) -> DataFrame:
        """Set dimension with a ``denominators`` array."""
        dim = self._sql(_SET_DIM, orders=self.table("orders"))
        main = F.lpad((F.lit(50) + F.col("n") % 9).cast("string"), 3, "0")
        return stage(dim.withColumn("denominators", F.when(
            F.col("n").isin(2, 10), F.array(main, F.lit("TG30"))).otherwise(F.array(main))), "sets")

    @cached_property
    def reading_texts(self) -> DataFrame:
        return self.cards.select("pull_id", "row_index", F.col("set_id").alias("true_set"), "num",
                                 "name", "confidence", F.expr(_READING_TEXT).alias("text"))

    @cached_property
    def readings(self) -> DataFrame:
        """Number readings: one parsed row per printed card, staged because every
        consumer reads them more than once."""
        # Strips print the same numbers over and over: each text is parsed once.
        texts = self.cards_unordered.select(F.expr(_READING_TEXT).alias("__text")).distinct()
        parsed = stage(texts.withColumn("r", N.parse_number(F.col("__text"), F.lit(0.0)))
                       .select("__text", "r.numerator", "r.denominator", "r.prefix", "r.pattern_ok", "r.tokens"), "parsed")
        rows = self.reading_texts.join(parsed, F.col("text").eqNullSafe(F.col("__text")))
        return stage(rows.select("pull_id", "row_index", "true_set", "num", "name", "text", "numerator", "denominator", "prefix",
                                 F.round("confidence", 3).alias("confidence"), "pattern_ok", "tokens"), "readings")

    @cached_property
    def ocr(self) -> DataFrame:
        return self._sql(_OCR, events=self.table("events"))

    @cached_property
    def frames(self) -> DataFrame:
        return self._sql(_FRAME, events=self.table("events"))

    @cached_property
    def calibration(self) -> DataFrame:
        return self._sql(_CALIBRATION, documents=self.table("documents"), labels=self.table("labels"))


def _split_columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return out + [cur.strip()]
