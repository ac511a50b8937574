"""Typed table scans over a folder of Parquet tables (or JDBC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scan(spark: SparkSession, folder: str, table: str, where: Column | str | None = None,
         columns: list[str] | None = None) -> DataFrame:
    """Scan one table; the predicate and the projection reach the Parquet reader."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, split_column: str, lower: int,
              upper: int, splits: int, properties: dict[str, str] | None = None) -> DataFrame:
    """Scan a relational table in parallel slices; filters are pushed to the database."""
    return spark.read.jdbc(url, table, column=split_column, lowerBound=lower,
                           upperBound=upper, numPartitions=splits,
                           properties=properties or {})
