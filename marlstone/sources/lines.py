"""Lines of gzip files with stable numbers and their file's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "source_file string, source_date string, source_hour int, source_sha256 string"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, line_number, raw_json): lines end at LF only, a CR before it is cut; numbers start at 1 in each file.

    A gzip file is read by one task in order, so a row's number is its place among the file's increasing ids: the first id of each file is found by a sum over files and joined back, without sorting a line.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("raw_json")
    )
    firsts = lines.groupBy("source_file").agg(F.min("__id").alias("__first"))
    return lines.join(firsts, "source_file").select("source_file", (F.col("__id") - F.col("__first") + 1).alias("line_number"), "raw_json")


def numbered(lines: DataFrame, order: str, file: str = "source_file") -> DataFrame:
    """line_number for lines that come with any order column, as from splittable files."""
    return lines.withColumn("line_number", F.row_number().over(Window.partitionBy(file).orderBy(order)).cast("long"))


def with_manifest(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """Adds each file's date, hour and checksum; lines of files without a manifest go. A local file's address may have one slash or three."""
    files = manifests.select(F.regexp_replace("source_file", "^file:/+", "file:/").alias("source_file"), "source_date", "source_hour", "source_sha256")
    return lines.withColumn("source_file", F.regexp_replace("source_file", "^file:/+", "file:/")).join(files, "source_file")
