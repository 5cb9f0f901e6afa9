"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder`` (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
