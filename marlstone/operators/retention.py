"""Cohorts of actors and who of them comes back the week after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.rollups import week_coverage


def retention(weekly: DataFrame, covered: DataFrame) -> DataFrame:
    """A row for each week in which actors are first seen. Until all seven days of it and of the next week are covered, what is retained is unknown, not zero."""
    weeks = weekly.select("actor_id", "week_start")
    first = weeks.groupBy("actor_id").agg(F.min("week_start").alias("cohort_week"))
    back = weeks.select("actor_id", F.date_sub("week_start", 7).alias("cohort_week"), F.lit(1).alias("back"))
    cohorts = first.join(back, ["actor_id", "cohort_week"], "left").groupBy("cohort_week").agg(F.count("*").alias("cohort_size"), F.count("back").alias("returned"))
    days = week_coverage(covered)
    own, following = days.withColumnsRenamed({"week_start": "cohort_week", "covered_days": "own"}), days.withColumnsRenamed({"week_start": "observation_week", "covered_days": "following"})
    rows = cohorts.withColumn("observation_week", F.date_add("cohort_week", 7)).join(own, "cohort_week", "left").join(following, "observation_week", "left")
    mature = F.coalesce((F.col("own") == 7) & (F.col("following") == 7), F.lit(False))
    return rows.select(
        "cohort_week",
        "observation_week",
        "cohort_size",
        F.coalesce("own", F.lit(0)).cast("long").alias("cohort_covered_days"),
        F.coalesce("following", F.lit(0)).cast("long").alias("observation_covered_days"),
        F.when(mature, F.col("returned")).alias("retained_count"),
        F.when(mature, F.col("returned").cast("double") / F.col("cohort_size")).alias("retention_rate"),
        F.when(mature, "MATURE").otherwise("IMMATURE").alias("maturity"),
        F.lit("first_observed_in_selected_sample").alias("cohort_definition"),
    )
