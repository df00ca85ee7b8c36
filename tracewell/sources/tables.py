"""Named Parquet tables below one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``, a file or a directory of part files, in any store Spark can read."""
    return spark.read.parquet(f"{root}/{name}.parquet")
