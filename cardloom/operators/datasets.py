"""Dataset building: splits, oversampling, labelling, merging, sampling, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import numbers as N
from cardloom.plans.skew import global_ordinal


def deterministic_split(seed: Column, every: int = 10) -> Column:
    return F.when(F.pmod(seed, F.lit(every)) == 0, "val").otherwise("train")


def oversample(rows: DataFrame, refs: DataFrame, times: int = 3) -> DataFrame:
    """Train rows that have a reference; uploads are repeated ``times``."""
    paired = rows.filter((F.col("split") == "train") & F.col("card_key").isNotNull()) \
                 .join(refs.select("card_key").distinct(), "card_key", "left_semi")
    reps = F.when(F.col("source") == "upload", times).otherwise(1)
    return paired.withColumn("copy", F.explode(F.sequence(F.lit(1), reps)))


def systematic_sample(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Every max(1, count/n)-th row in ``by`` order, at most ``n``. Sampling is the
    feature here; positions come from a bucketed scan, not from one sorted task."""
    placed = global_ordinal(rows, by, [], "__pos")
    step = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max(1, n))).alias("s")).scalar()
    out = placed.withColumn("__s", step)
    return out.filter((F.col("__pos") % F.col("__s") == 0) & (F.col("__pos") / F.col("__s") < n)) \
              .drop("__pos", "__s")


def merge_uploads(uploads: DataFrame, ref_sets: DataFrame, ref_keys: DataFrame) -> DataFrame:
    """Each upload with the first reason that skips it, or ``merged``."""
    keyed = uploads.withColumn("ref_key", N.reference_key(F.col("card_key"))) \
                   .withColumn("slug", F.regexp_extract("ref_key", r"^(.*)-[^-]*$", 1))
    known = (keyed.join(ref_sets.select("slug").distinct().withColumn("__set", F.lit(True)), "slug", "left")
             .join(ref_keys.select("ref_key").distinct().withColumn("__key", F.lit(True)), "ref_key", "left"))
    return known.withColumn(
        "outcome", F.when(F.col("split") != "train", "skip_not_train")
        .when(F.col("ref_key").isNull(), "skip_unmappable_set")
        .when(F.col("__set").isNull(), "skip_no_refs")
        .when(F.col("__key").isNull(), "skip_no_ref_crop")
        .when(~F.coalesce("file_present", F.lit(True)), "skip_missing_file")
        .otherwise("merged")).drop("__set", "__key")


def label_rows(strips: DataFrame, submitted: DataFrame, catalog: DataFrame,
               mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, errors): submitted numbers matched to strips by position.

    ``strips``: photo_id, row_index; ``submitted``: photo_id, set_id, row_index, number
    (NULL = skip); ``catalog``: catalog_id, local_id, card_id; ``mapping``: set_id,
    catalog_id. A number outside a mapped set is an error and any error (or a wrong row
    count) rejects the whole photo; an unmapped set yields a synthetic key."""
    cards = catalog.withColumn("num", N.number_key(F.col("local_id"))).groupBy("catalog_id", "num").agg(
        F.max("card_id").alias("card_id"))
    rows = (submitted.join(mapping, "set_id", "left").withColumn("num", N.number_key(F.col("number")))
            .join(cards, ["catalog_id", "num"], "left"))
    key = F.when(F.col("num").isNotNull(), F.when(F.col("catalog_id").isNotNull(), F.col("card_id"))
                 .otherwise(F.concat("set_id", F.lit("-"), "num")))
    rows = rows.withColumns({"card_key": key, "bad": F.col("num").isNotNull() & key.isNull()})
    counts = (rows.groupBy("photo_id").agg(F.count(F.lit(1)).alias("given"), F.bool_or("bad").alias("any_bad"))
              .join(strips.groupBy("photo_id").agg(F.count(F.lit(1)).alias("have")), "photo_id"))
    good = counts.filter(~F.col("any_bad") & (F.col("given") == F.col("have"))).select("photo_id")
    labels = (rows.join(good, "photo_id", "left_semi")
              .select("photo_id", "row_index", F.when(F.col("card_key").isNotNull(), F.col("set_id")).alias("set_id"),
                      "card_key"))
    errors = rows.filter("bad").select("photo_id", "row_index", "number", F.lit("not in set").alias("error"))
    return labels, errors


def export_labelled(strips: DataFrame, photos: DataFrame) -> DataFrame:
    """Manifest rows of labelled strips of labelled photos."""
    return (strips.filter(F.col("card_key").isNotNull())
            .join(photos.filter("labeled").select("photo_id", "split", "tier"), "photo_id")
            .select(F.concat(F.lit("strips/"), F.col("photo_id"), F.lit("_"), F.col("row_index"), F.lit(".jpg"))
                    .alias("file"), "card_key", "set_id", "split", "tier", "source", "photo_id", "row_index"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Newline JSON, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


MANIFEST = "path string, card_key string, set string, split string, source string"


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def manifest_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("strips"),
                    F.count_if(N.blank_to_null(F.col("card_key")).isNotNull()).alias("labeled"),
                    F.count_if(N.blank_to_null(F.col("card_key")).isNull()).alias("unlabeled"))


def pools_summary(photos: DataFrame) -> DataFrame:
    """Photo counts by tier, split and label state with all subtotals."""
    return photos.cube("tier", "split", "labeled").agg(
        F.count(F.lit(1)).alias("photos"), F.grouping_id().cast("int").alias("level"))


def content_dedup(items: DataFrame, content: str, item: str) -> DataFrame:
    """Identical contents share one reading: each item with its digest and the smallest
    item of that digest. Only digests are shuffled, never contents."""
    hashed = items.select(item, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min(item).alias("reading_of"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, "digest")


def read_uploads(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files of a folder, as bytes; ``content_dedup`` digests them where they are read. An empty
    file gives no row; one of more than 2 GB fails (a row can't hold it)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "content")


def references(catalog: DataFrame, cached: DataFrame) -> DataFrame:
    """Catalog cards and cached cards of a set; keys carry different prefixes, so
    neither hides the other."""
    return catalog.unionByName(cached.withColumn("key", F.concat(F.lit("cached-"), "card_key")))
