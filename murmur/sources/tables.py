"""Base-table access.  Reads stay lazy so Catalyst prunes columns and pushes filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """Parquet tables of one data directory (``{dir}/{name}.parquet``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
