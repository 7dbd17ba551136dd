"""The four-table store: users, personas, conversations, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("users", "personas", "conversations", "messages")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in TABLES}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()
