"""Dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import numbers as N
from cardloom.operators import datasets
from cardloom.plans.session import fresh_folder, stage
from cardloom.queries.registry import query

_MAN = """mf AS (SELECT pull_id, row_index, CASE WHEN num % 6 <> 0 THEN match_id END AS card_key, set_id, CASE WHEN pull_id % 10 = 0 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN confidence > 0.8 THEN 'upload' ELSE 'synthetic' END AS source FROM pull_card)"""


def manifest(t):
    return t.cards.select("pull_id", "row_index", F.when(F.col("num") % 6 != 0, F.col("match_id")).alias("card_key"), "set_id",
                          datasets.deterministic_split(F.col("pull_id")).alias("split"),
                          F.when(F.col("confidence") > 0.8, "upload").otherwise("synthetic").alias("source"))


@query("A4", "manifest_roundtrip", f"""WITH {_MAN} SELECT count(*) AS strips, count(card_key) AS labeled, count(*) - count(card_key) AS unlabeled FROM mf""")
def _manifest(t):
    """Write newline JSON per split, read it back, count."""
    path = fresh_folder(t.spark, "manifest")
    rows = manifest(t).select(F.concat_ws("/", "pull_id", "row_index").alias("path"), "card_key", F.col("set_id").alias("set"), "split", "source")
    datasets.write_manifest(rows, path)
    return datasets.manifest_counts(datasets.read_manifest(t.spark, path))


_PHOTO = "ph AS (SELECT pull_id AS photo_id, CASE WHEN pull_id % 2 = 0 THEN 'stress' ELSE 'standard' END AS tier, CASE WHEN pull_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, derive_status = 'done' AS labeled, created_at FROM pull)"


def photos(t):
    p = F.col("pull_id")
    return t.submissions.select(p.alias("photo_id"), F.when(p % 2 == 0, "stress").otherwise("standard").alias("tier"),
                                F.when(p % 10 == 0, "test").otherwise("train").alias("split"),
                                (F.col("derive_status") == "done").alias("labeled"), "created_at")


@query("A10", "export_labelled", f"""WITH {_MAN}, {_PHOTO} SELECT 'strips/' || CAST(pull_id AS VARCHAR) || '_' || CAST(row_index AS VARCHAR) || '.jpg' AS file, card_key, set_id, ph.split, tier, source, photo_id, row_index
FROM mf JOIN ph ON mf.pull_id = ph.photo_id WHERE card_key IS NOT NULL AND labeled""")
def _export(t):
    return datasets.export_labelled(manifest(t).withColumnRenamed("pull_id", "photo_id").drop("split"), photos(t))


@query("B6", "list_photos", f"""WITH {_MAN}, {_PHOTO} SELECT photo_id, tier, created_at, row_index, card_key FROM ph LEFT JOIN mf ON ph.photo_id = mf.pull_id WHERE ph.split = 'train' AND labeled AND tier = 'stress'""")
def _photos(t):
    kept = photos(t).filter((F.col("split") == "train") & F.col("labeled") & (F.col("tier") == "stress"))
    rows = manifest(t).select(F.col("pull_id").alias("photo_id"), "row_index", "card_key")
    return kept.select("photo_id", "tier", "created_at").join(rows, "photo_id", "left").orderBy(
        F.desc("created_at"), "photo_id", "row_index")


@query("C22", "references", """SELECT set_id, card_id AS key, card_id AS card_key, name FROM catalog_card UNION ALL SELECT set_id, 'cached-' || match_id, match_id, min(name) FROM pull_card GROUP BY 1, 3""")
def _references(t):
    cat = t.catalog.select("set_id", F.col("card_id").alias("key"), F.col("card_id").alias("card_key"), "name")
    cached = t.cards_unordered.groupBy("set_id", F.col("match_id").alias("card_key")).agg(F.min("name").alias("name"))
    return datasets.references(cat, cached)


_UP = """u AS (SELECT pull_id, row_index, CASE WHEN pull_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, num, CASE WHEN num % 5 = 0 THEN 'ME-' WHEN pull_id % 9 = 0 THEN 'sv99-' ELSE 'sv' || substr(set_id, 2) || '-' END || lpad(CAST(CASE WHEN num > 45 THEN num + 900 ELSE num END AS VARCHAR), 3, '0') AS card_key,
   pull_id % 6 <> 5 AS file_present FROM pull_card),
k AS (SELECT *, CASE WHEN num % 5 <> 0 THEN 'sv' || CAST(CAST(substr(card_key, 3, 2) AS INT) AS VARCHAR) END AS slug, CASE WHEN num % 5 <> 0 THEN 'sv' || CAST(CAST(substr(card_key, 3, 2) AS INT) AS VARCHAR) || '-' || CAST(CASE WHEN num > 45 THEN num + 900 ELSE num END AS VARCHAR) END AS ref_key FROM u)"""


@query("C23", "merge_uploads", f"""WITH {_UP} SELECT pull_id, row_index, ref_key, CASE WHEN split <> 'train' THEN 'skip_not_train' WHEN ref_key IS NULL THEN 'skip_unmappable_set' WHEN slug NOT IN (SELECT 'sv' || CAST(n AS VARCHAR) FROM set_dim) THEN 'skip_no_refs'
   WHEN num > 45 THEN 'skip_no_ref_crop' WHEN NOT file_present THEN 'skip_missing_file' ELSE 'merged' END AS outcome FROM k""")
def _merge(t):
    num = F.col("num")
    two = F.substring("set_id", 2, 2)
    uploads = t.cards.select("pull_id", "row_index", F.when(F.col("pull_id") % 10 == 0, "test").otherwise("train").alias("split"),
                             F.concat(F.when(num % 5 == 0, "ME-").when(F.col("pull_id") % 9 == 0, "sv99-").otherwise(F.concat(F.lit("sv"), two, F.lit("-"))),
                                      F.lpad(F.when(num > 45, num + 900).otherwise(num).cast("string"), 3, "0")).alias("card_key"),
                             (F.col("pull_id") % 6 != 5).alias("file_present"))
    sets = t.sets.select(F.concat(F.lit("sv"), F.col("n").cast("string")).alias("slug"))
    keys = t.cards_unordered.select(
        F.concat(F.lit("sv"), two.cast("int").cast("string"), F.lit("-"), num.cast("string")).alias("ref_key")).distinct()
    return datasets.merge_uploads(uploads, sets, keys).select("pull_id", "row_index", "ref_key", "outcome")


_LAB = """sub AS (SELECT pull_id AS photo_id, CASE WHEN pull_id % 5 = 0 THEN 'X99' ELSE set_id END AS set_id, row_index, num, CASE WHEN num % 10 <> 0 THEN card_number END AS number FROM pull_card),
cat AS (SELECT set_id, CAST(local_id AS INT) AS num, max(card_id) AS card_id FROM catalog_card GROUP BY 1, 2),
r AS (SELECT s.*, CASE WHEN number IS NOT NULL THEN CASE WHEN s.set_id = 'X99' THEN 'X99-' || CAST(s.num AS VARCHAR) ELSE c.card_id END END AS card_key FROM sub s LEFT JOIN cat c ON s.set_id = c.set_id AND s.num = c.num),
g AS (SELECT photo_id FROM r GROUP BY 1 HAVING NOT bool_or(number IS NOT NULL AND card_key IS NULL) AND count(*) = (SELECT count(*) FROM pull_card p WHERE p.pull_id = photo_id) + CASE WHEN photo_id % 11 = 0 THEN 1 ELSE 0 END)"""


@query("C24", "label_rows", f"""WITH {_LAB} SELECT photo_id, row_index, CASE WHEN card_key IS NOT NULL THEN set_id END AS set_id, card_key, FALSE AS error FROM r WHERE photo_id IN (SELECT photo_id FROM g)
UNION ALL SELECT photo_id, row_index, NULL, number, TRUE FROM r WHERE number IS NOT NULL AND card_key IS NULL""")
def _labels(t):
    # Strips and numbers are read from one numbering of the cards.
    base = stage(t.cards.select("pull_id", "row_index", "set_id", "num", "card_number"), "cards")
    sub = base.select(
        F.col("pull_id").alias("photo_id"), F.when(F.col("pull_id") % 5 == 0, "X99").otherwise(F.col("set_id")).alias("set_id"),
        "row_index", F.when(F.col("num") % 10 != 0, F.col("card_number")).alias("number"))
    cat = t.catalog.select(F.col("set_id").alias("catalog_id"), "local_id", "card_id")
    mapping = t.sets.select("set_id", F.col("set_id").alias("catalog_id"))
    # Every eleventh photo has a row that was not submitted.
    asked = base.select(F.col("pull_id").alias("photo_id"), F.explode(F.array_repeat(
        F.lit(1), F.when((F.col("pull_id") % 11 == 0) & (F.col("row_index") == 0), 2).otherwise(1))).alias("copy")).drop("copy")
    labels, errors = datasets.label_rows(asked, sub, cat, mapping)
    bad = errors.select("photo_id", "row_index", F.lit(None).cast("string").alias("set_id"), F.col("number").alias("card_key"), F.lit(True).alias("error"))
    return labels.withColumn("error", F.lit(False)).unionByName(bad)


@query("D24", "pools_summary", f"WITH {_PHOTO} SELECT tier, split, labeled, count(*) AS photos, CAST(grouping(tier) * 4 + grouping(split) * 2 + grouping(labeled) AS INT) AS level FROM ph GROUP BY CUBE (tier, split, labeled)")
def _pools(t):
    return datasets.pools_summary(photos(t))


@query("E15", "systematic_sample", f"""WITH ph AS (SELECT pull_id, row_number() OVER (ORDER BY pull_id) - 1 AS p, count(*) OVER () AS n FROM pull WHERE derive_status = 'done')
SELECT pull_id FROM ph WHERE p % greatest(1, n // 500) = 0 AND p // greatest(1, n // 500) < 500""")
def _sample(t):
    return datasets.systematic_sample(t.submissions.filter("derive_status = 'done'"), "pull_id", 500).select("pull_id")


@query("E19", "content_hash_dedup", """SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS reading_of, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents""")
def _dedup(t):
    return datasets.content_dedup(t.table("documents"), "text", "doc_id").select("doc_id", "reading_of", "copies")


@query("F6", "latest_100_runs", "SELECT pull_id, created_at FROM pull ORDER BY created_at DESC, pull_id DESC LIMIT 100")
def _runs(t):
    return t.submissions.select("pull_id", "created_at").orderBy(F.desc("created_at"), F.desc("pull_id")).limit(100)


@query("H26", "oversample", f"""WITH {_MAN} SELECT pull_id, row_index, card_key, CAST(c.copy AS INT) AS copy FROM mf, (SELECT unnest([1, 2, 3]) AS copy) c
WHERE split = 'train' AND card_key IN (SELECT card_id FROM catalog_card) AND (copy = 1 OR source = 'upload')""")
def _oversample(t):
    return datasets.oversample(manifest(t), t.catalog.select(F.col("card_id").alias("card_key"))).select(
        "pull_id", "row_index", "card_key", "copy")
