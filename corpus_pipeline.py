"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardloom.llm import lines, mixing, packing, quality, simhash
from cardloom.llm.common import key_of
from cardloom.plans.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text=None) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it now is."""
    text = F.col("text") if text is None else text
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor stand on a host that fails."""
    return quality.judge(docs, "text", "source", carry=COLUMNS).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; all documents stay."""
    return _documents(lines.drop_templates(docs.select(*COLUMNS), "doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs, "doc_id", "text").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, and a second time where at least half of a
    second pass is taken; left out where less than half of a first is. Rows repeated under one id are all taken as often
    as the one taken most often."""
    mixed = mixing.mix(docs, "doc_id", "text", "source")
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = stage(mixed.select(key_of(F.col("strip_id")).alias("_key"), times.alias("_times"))
                  .groupBy("_key").agg(F.max("_times").alias("_times")).filter("_times > 0"), "taken")
    # By merge at every size: the list of what is taken grows with the documents.
    rows = docs.withColumn("_key", key_of(F.col("doc_id"))).join(taken.hint("merge"), "_key")
    return rows.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    return packing.pack(docs, "doc_id", "text", with_ids=False)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_duplicates),
          ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: Near duplicates and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
