"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The table of live benchmark observations, under the name that the data give it.
OBSERVATIONS = "cortex_additive_faithful_seed7"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder` (one parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
