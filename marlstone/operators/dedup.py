"""Repeated keys: one canonical row each, the others set aside, conflicting copies found. No wide row is sorted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line number takes the lower 40 bits of a position.
LINES = 1 << 40


@dataclass(frozen=True)
class Deduplicated:
    unique: DataFrame
    excluded: DataFrame
    repeated: DataFrame


def deduplicate(rows: DataFrame, key: str = "event_id", *, hour: str = "source_hour", line: str = "line_number") -> Deduplicated:
    """The row at the smallest (hour, line) of each key is canonical; `excluded` has the others with the canonical position, `repeated` all rows of keys with copies.

    The position is one long, so the smallest is a hash aggregate over narrow rows; only keys with copies are joined back, and the optimizer broadcasts them or not by their size.
    """
    position = F.col(hour).cast("long") * LINES + F.col(line)
    keys = rows.groupBy(key).agg(F.min(position).alias("__first"), F.count("*").alias("__copies")).where("__copies > 1").drop("__copies")
    marked = rows.join(keys, key, "left").withColumn("__other", F.col("__first").isNotNull() & (position != F.col("__first")))
    first_hour, first_line = F.floor(F.col("__first") / LINES).cast("int"), (F.col("__first") % LINES).cast("long")
    return Deduplicated(
        marked.where("not __other").select(*rows.columns),
        marked.where("__other").select(*rows.columns, first_hour.alias("canonical_source_hour"), first_line.alias("canonical_line_number")),
        marked.where("__first is not null").select(*rows.columns),
    )


def deduplicate_by_line(rows: DataFrame, key: str = "event_id", line: str = "line_number") -> tuple[DataFrame, DataFrame]:
    """The same for one file by row numbers: (kept, excluded with rn); right only where the line alone orders the copies."""
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(line)))
    return numbered.where("rn = 1").drop("rn"), numbered.where("rn > 1")


def conflicts(repeated: DataFrame, key: str = "event_id", content: str = "raw_json") -> DataFrame:
    """Keys whose copies differ in content: least and greatest digest say so without a distinct count."""
    digest = F.sha2(F.coalesce(F.concat(F.lit("v"), content), F.lit("n")), 256)
    return repeated.groupBy(key).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select(key)
