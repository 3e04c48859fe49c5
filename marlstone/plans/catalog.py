"""Writing tables once, with their row count and plan, and naming them in a catalog."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW_GROUP = 32 << 20
#: Tables of raw lines are laid out by source hour, others by date where they have one.
BY_HOUR = ("quarantine", "ods_github_event_raw", "excluded_duplicates", "unknown_events")


def partition_columns(name: str, df: DataFrame) -> list[str]:
    if name in BY_HOUR:
        return ["source_date", "source_hour"]
    return next(([c] for c in ("week_start", "cohort_week", "event_date") if c in df.columns and not name.startswith("dim_")), [])


def explained(df: DataFrame) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, row_group: int | None = None) -> dict:
    """Writes a new table and says what it has: rows (counted while they are written, not by reading them again), path, partition columns, schema and plan. A path that exists is an error."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    partition_by = partition_by or []
    if partition_by:  # rows of a partition meet, so a task has few open files; one that is too large for a task is split
        counted = counted.hint("rebalance", *partition_by)
    writer = counted.write.mode("errorifexists").option("compression", "snappy")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    try:
        rows = seen.get["rows"]
    except Py4JJavaError:  # a plan that turned out empty has no metrics
        rows = df.sparkSession.read.schema(df.schema).parquet(path).count()
    return {"path": path, "rows": rows, "partitions": partition_by, "schema": df.schema.jsonValue(), "plan": explained(df)}


def register(spark: SparkSession, name: str, path: str, schema: dict, partitions: list[str] | None = None) -> None:
    """An external table over Parquet files with these columns, and their partitions."""
    layout = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE {name} ({StructType.fromJson(schema).toDDL()}) USING PARQUET {layout} LOCATION '{path}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)


def location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0].data_type


def relocate(spark: SparkSession, name: str, path: str) -> None:
    """Points a table, and its partitions, at files that moved."""
    schema = spark.table(name).schema.jsonValue()
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    spark.sql(f"DROP TABLE {name}")  # external: its files stay
    register(spark, name, path, schema, partitions)
    check_table(spark, name, path, schema)


def check_table(spark: SparkSession, name: str, path: str, schema: dict) -> None:
    """Raises unless a table has this place and these columns."""
    here = location(spark, name)
    if here.removeprefix("file:").rstrip("/") != path.removeprefix("file:").replace("//", "/").rstrip("/"):
        raise ValueError(f"{name} lies at {here}, not at {path}")
    shape = lambda s: {f["name"]: f["type"] for f in s["fields"]}
    if shape(spark.table(name).schema.jsonValue()) != shape(schema):
        raise ValueError(f"{name} has other columns")
