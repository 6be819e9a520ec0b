"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.sources.package import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder`` (a file or a directory of part files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
