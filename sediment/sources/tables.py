"""Parquet tables of a store: one file or folder ``<dir>/<name>.parquet`` per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table with its zone-less timestamps read as UTC instants (the session runs in UTC)."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [table(spark, directory, n) for n in names]
