"""Readers for the lexicon tables: one Parquet file or folder per table under a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`. Only the columns a query uses are read (column pruning)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
