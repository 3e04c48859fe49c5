"""Versions of names over time (SCD2) and as-of joins to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.fields import micros_text, owner_of


class ConflictError(ValueError):
    """Two names at one instant; nothing may be published."""


def observations(events: DataFrame, time: str = "event_time") -> DataFrame:
    return events.select("repo_id", "repo_name", F.col(time).alias("observed_at")).distinct()


def name_conflicts(observed: DataFrame) -> DataFrame:
    """(repo_id, observed_at, observed_names) of instants with more than one name."""
    names = observed.groupBy("repo_id", "observed_at").agg(F.array_sort(F.collect_set("repo_name")).alias("observed_names"))
    return names.where(F.size("observed_names") > 1)


def scd2(observed: DataFrame) -> DataFrame:
    """A version for each change of a repository's name, valid from its first observation to before the next version's; going back to a name makes a new one.

    Repositories with a conflict at any instant have no versions. The same observations in any order give the same rows and keys, and late ones take their place when the whole is built again.
    Both windows share one shuffle and sort by repository.
    """
    observed = observed.select("repo_id", "repo_name", "observed_at").distinct()
    clear = observed.join(name_conflicts(observed).select("repo_id"), "repo_id", "left_anti")
    history = Window.partitionBy("repo_id").orderBy("observed_at")
    before = F.lag("repo_name").over(history)
    changes = clear.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("repo_name")))
    versions = changes.select("repo_id", "repo_name", owner_of("repo_name").alias("owner_name"), F.col("observed_at").alias("valid_from"), F.lead("observed_at").over(history).alias("valid_to"))
    versions = versions.withColumn("attribute_hash", F.sha2(F.to_json(F.struct("repo_name", "owner_name")), 256))
    key = F.sha2(F.to_json(F.struct("repo_id", micros_text("valid_from").alias("valid_from"), "attribute_hash")), 256)
    return versions.select(key.alias("repo_sk"), "repo_id", "repo_name", "owner_name", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), "attribute_hash")


def as_of(facts: DataFrame, dimension: DataFrame, *, time: str = "event_time", key: str = "repo_id", value: str = "repo_sk") -> DataFrame:
    """facts with the version that holds at their time: [valid_from, valid_to), null before the first. Versions are disjoint, so rows don't multiply."""
    f, d = facts.alias("f"), dimension.select(key, "valid_from", "valid_to", value).alias("d")
    at = F.col(f"f.{time}")
    holds = (F.col(f"f.{key}") == F.col(f"d.{key}")) & (at >= F.col("d.valid_from")) & (F.col("d.valid_to").isNull() | (at < F.col("d.valid_to")))
    return f.join(d, holds, "left").select("f.*", f"d.{value}")


def require_publishable(conflicting: DataFrame, path: str) -> None:
    """Keeps conflicts at path, which must not exist, and raises; does nothing if there are none."""
    if not conflicting.isEmpty():
        conflicting.write.mode("errorifexists").parquet(path)
        raise ConflictError(f"simultaneous names, kept at {path}")


def broken_versions(dimension: DataFrame) -> DataFrame:
    """Versions whose end isn't the next one's start, is not after their start, or disagrees with is_current."""
    following = F.lead("valid_from").over(Window.partitionBy("repo_id").orderBy("valid_from"))
    ends = ~F.col("valid_to").eqNullSafe(F.col("following")) | F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False)) | (F.col("is_current") != F.col("valid_to").isNull())
    return dimension.withColumn("following", following).where(ends)


def not_one_current(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("repo_id").agg(F.count_if("is_current").alias("current")).where("current <> 1")


def broken_links(enriched: DataFrame, dimension: DataFrame) -> DataFrame:
    """Facts whose key is missing, of another repository or name, or not valid at their time."""
    f, d = enriched.alias("f"), dimension.alias("d")
    at = F.col("f.event_time")
    wrong = (F.col("f.repo_id") != F.col("d.repo_id")) | (F.col("f.repo_name") != F.col("d.repo_name")) | (at < F.col("d.valid_from")) | F.coalesce(at >= F.col("d.valid_to"), F.lit(False))
    return f.join(d, F.col("f.repo_sk") == F.col("d.repo_sk"), "left").where(F.col("d.repo_sk").isNull() | wrong).select("f.event_id")
