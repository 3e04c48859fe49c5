"""Files in any store that Hadoop reaches: checksums by Spark tasks, and raw files that are published once."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.release import ReleaseError


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file of at most 2 GB below a folder, hashed where Spark's tasks run. Names that begin with _ or . are markers of writers and left out."""
    at, fs = _at(spark, path)
    root = fs.makeQualified(at).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    return files.select(F.substring(inside, len(root) + 2, 1 << 20).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differing(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files that only one of two lists of checksums has, or that differ; both sides are joined, so neither reaches the driver."""
    f, w = found.alias("f"), wanted.alias("w")
    same = (F.col("f.bytes") == F.col("w.bytes")) & (F.col("f.sha256") == F.col("w.sha256"))
    return f.join(w, F.col("f.file") == F.col("w.file"), "full").where(~F.coalesce(same, F.lit(False))).select(F.coalesce("f.file", "w.file").alias("file"))


def publish_raw(spark: SparkSession, local: str | Path, home: str, sha256: str) -> str:
    """Puts a local file into a store for good: copied beside its place, read back and hashed there, renamed, made read-only. A file that is there must be the same; nothing is overwritten."""
    place, fs = _at(spark, home)

    def hashed(path) -> str:
        return spark.read.format("binaryFile").load(path.toString()).select(F.sha2("content", 256)).first()[0]

    if fs.exists(place):
        if hashed(place) != sha256:
            raise ReleaseError(f"{home} holds another file")
        return home
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    part = jvm.Path(place.getParent(), f"part-{uuid.uuid4().hex}")
    try:
        fs.mkdirs(place.getParent())
        fs.copyFromLocalFile(False, False, jvm.Path(f"file:{Path(local).resolve()}"), part)
        if hashed(part) != sha256:
            raise ReleaseError(f"{local} arrived changed")
        if fs.exists(place) or not fs.rename(part, place):
            raise ReleaseError(f"{home} appeared meanwhile")
    finally:
        fs.delete(part, False)
    fs.setPermission(place, jvm.permission.FsPermission("444"))
    return home
