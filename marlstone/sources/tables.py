"""Parquet tables, folders of them, and rows from the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone become UTC times."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, TimestampNTZType)}
    return df.withColumns(zoned) if zoned else df


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name."""
    return reduce(DataFrame.unionByName, tables)


def calendar(spark: SparkSession, dates: Iterable[dt.date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "covered_date date")
