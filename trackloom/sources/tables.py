"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that hold wall-clock times without zone and are read as timestamps in the session's zone.
TIMES = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """folder/name.parquet, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """table with its times cast to timestamp."""
    df = table(spark, folder, name)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in TIMES.get(name, []) if c in df.columns})
