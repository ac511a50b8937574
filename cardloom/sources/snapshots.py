"""Publish-last snapshots: facts first, the log row that makes them visible last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _log(spark: SparkSession, root: str, snapshot_id: int, created_at: str, status: str, trigger: str) -> None:
    row = spark.range(1).select(F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
                                F.lit(created_at).cast("timestamp").alias("created_at"),
                                F.lit(status).alias("status"), F.lit(trigger).alias("trigger"))
    row.write.mode("append").parquet(f"{root}/snapshot_log")


def write_snapshot(facts: dict[str, DataFrame], root: str, snapshot_id: int, created_at: str,
                   trigger: str = "manual") -> None:
    """Log the snapshot as ``running``, write each fact table under its own ``snapshot_id``
    partition, then log it as ``done``, or as ``failed`` where a write fails (and raise).

    Readers see ``done`` ones only; a job that dies on the way leaves ``running``, and a rerun
    overwrites only its own partition."""
    spark = next(iter(facts.values())).sparkSession
    _log(spark, root, snapshot_id, created_at, "running", trigger)
    try:
        for name, df in facts.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/snapshot_id={snapshot_id}")
    except Exception:
        _log(spark, root, snapshot_id, created_at, "failed", trigger)
        raise
    _log(spark, root, snapshot_id, created_at, "done", trigger)


def snapshot_status(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_id, status): where each snapshot stands; ``done`` is final."""
    rank = F.when(F.col("status") == "done", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return spark.read.parquet(f"{root}/snapshot_log").groupBy("snapshot_id").agg(F.max_by("status", rank).alias("status"))


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Facts of the newest ``done`` snapshot; other partitions are not listed."""
    log = spark.read.parquet(f"{root}/snapshot_log").filter("status = 'done'")
    newest = log.agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("id")).first()["id"]
    facts = spark.read.option("basePath", f"{root}/{name}")
    return facts.parquet(f"{root}/{name}").limit(0) if newest is None else facts.parquet(f"{root}/{name}/snapshot_id={newest}")
