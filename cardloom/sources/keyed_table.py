"""A keyed table in buckets of files: a merge rewrites the buckets that its rows fall into, and nothing else."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardloom.plans.session import path_exists

BUCKETS = 64


class KeyedTable:
    """Rows of one key lie in one of ``buckets`` buckets by its hash. Every write puts its buckets in a new folder, then a manifest that
    names the live folder of every bucket, then, last, a row in the log that makes the manifest the newest. A reader
    follows the log, so it sees a merge whole or not at all; what a writer that died has left is never named. One writer
    at a time."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self) -> tuple[int, dict[int, str]]:
        """(version, live folder by bucket)."""
        if not path_exists(self.spark, f"{self.root}/log"):
            return -1, {}
        version, name = self.spark.read.schema("version long, manifest string").parquet(f"{self.root}/log").agg(
            F.max(F.struct("version", "manifest")).alias("m")).select("m.*").first()
        live = self.spark.read.schema("bucket int, folder string").parquet(f"{self.root}/manifests/{name}").collect()
        return version, {r["bucket"]: r["folder"] for r in live}

    def _publish(self, version: int, live: dict[int, str]) -> None:
        name = uuid.uuid4().hex
        self.spark.createDataFrame(sorted(live.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("manifest")).write.mode("append").parquet(f"{self.root}/log")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        folder = f"files/{uuid.uuid4().hex}"
        cut = rows.withColumn("_bucket", self._bucket())
        # A large bucket is written by several tasks, small ones by one together.
        cut.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        met = self.spark.read.schema("_bucket int").parquet(f"{self.root}/{folder}").select("_bucket").distinct().collect()
        return {r["_bucket"]: folder for r in met}

    def create(self, rows: DataFrame) -> "KeyedTable":
        """Write the first version, or replace all rows."""
        version, _ = self._newest()
        self._schema(rows)
        self._publish(version + 1, self._write(rows))
        return self

    def _schema(self, rows: DataFrame) -> None:
        self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its buckets: their files alone are listed and read."""
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        _, live = self._newest()
        paths = [f"{self.root}/{folder}/_bucket={b}" for b, folder in sorted(live.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that ``rows`` fall into by ``how(their rows now, rows)``; returns these buckets. ``rows`` with a NULL key column
        fall into a bucket like any other."""
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        if touched:
            version, live = self._newest()
            old = self.read(touched)
            written = self._write(how(old, rows).select(*old.columns))
            self._publish(version + 1, {b: f for b, f in live.items() if b not in touched} | written)
        return sorted(touched)
