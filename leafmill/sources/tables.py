"""Scans of the named tables of a data folder (one Parquet file or folder per table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` under `folder`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, columns: Sequence[str], version: str = "loaded_at") -> DataFrame:
    """`columns` (key among them) of the latest delivery of each key; of equally late ones the greatest row."""
    rest = [c for c in columns if c != key]
    if version not in df.columns:
        return df.select(*columns).dropDuplicates([key])
    row = F.max(F.struct(version, *(F.col(c).alias(f"_{c}") for c in rest)))
    return df.groupBy(key).agg(row.alias("_row")).select(*(F.col(key) if c == key else F.col(f"_row._{c}").alias(c) for c in columns))
