"""Daily and weekly sums of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fields import json_text, owner_of, week_of

TREND = ("event_date", "repo_id", "event_count", "push_events", "active_actors", "release_events", "watch_events", "fork_events", "coverage", "observed_hours")
THROUGHPUT = ("event_date", "repo_id", "pr_opened", "pr_closed", "pr_merged", "issue_opened", "issue_closed", "coverage", "observed_hours")


def observed_dimension(events: DataFrame) -> DataFrame:
    """Each name that a repository had, with its owner and first and last time."""
    seen = events.groupBy("repo_id", "repo_name").agg(F.min("event_time").alias("first_observed_at"), F.max("event_time").alias("last_observed_at"))
    return seen.select("repo_id", "repo_name", owner_of("repo_name").alias("owner_name"), "first_observed_at", "last_observed_at")


def repository_daily(events: DataFrame, *, coverage: str = "COMPLETE", observed_hours: int = 24) -> DataFrame:
    """Counts of a repository's day; JSON is read once for each event that needs it. A day without such events counts 0, not null."""
    kind, acts = F.col("event_type"), F.col("event_type").isin("PullRequestEvent", "IssuesEvent")
    narrow = events.select(
        "event_date", "repo_id", "actor_id", "event_type",
        F.when(acts, json_text("payload_json", "action")).alias("action"),
        F.when(kind == "PullRequestEvent", json_text("payload_json", "pull_request.merged")).alias("merged"),
    )

    def counted(event_type: str, action: str | None = None, more: Column | None = None) -> Column:
        rule = kind == event_type
        rule = rule if action is None else rule & (F.col("action") == action)
        return F.count_if(rule if more is None else rule & more)

    return narrow.groupBy("event_date", "repo_id").agg(
        F.count("*").alias("event_count"),
        counted("PushEvent").alias("push_events"),
        counted("PullRequestEvent", "opened").alias("pr_opened"),
        counted("PullRequestEvent", "closed").alias("pr_closed"),
        counted("PullRequestEvent", "closed", F.col("merged") == "true").alias("pr_merged"),
        counted("IssuesEvent", "opened").alias("issue_opened"),
        counted("IssuesEvent", "closed").alias("issue_closed"),
        F.countDistinct("actor_id").alias("active_actors"),
        counted("ReleaseEvent").alias("release_events"),
        counted("WatchEvent").alias("watch_events"),
        counted("ForkEvent").alias("fork_events"),
        F.lit(coverage).alias("coverage"),
        F.lit(observed_hours).alias("observed_hours"),
    )


def activity_trend(daily: DataFrame) -> DataFrame:
    return daily.select(*TREND)


def pr_issue_throughput(daily: DataFrame) -> DataFrame:
    return daily.select(*THROUGHPUT)


def owner_daily(events: DataFrame, *, coverage: str = "COMPLETE") -> DataFrame:
    """Counts of an owner's day, distinct ones from the events themselves. The sum of stated commits is null where no push states one.

    Events are first summed by owner, repository and actor, so both distinct counts expand those sums instead of the events.
    """
    push, size = F.col("event_type") == "PushEvent", F.when(F.col("event_type") == "PushEvent", json_text("payload_json", "size"))
    narrow = events.select("event_date", owner_of("repo_name").alias("owner_name"), "repo_id", "actor_id", push.alias("push"), size.alias("size"))
    sums = narrow.groupBy("event_date", "owner_name", "repo_id", "actor_id").agg(
        F.count("*").alias("n"), F.count_if("push").alias("pushes"), F.sum(F.col("size").try_cast("bigint")).alias("declared"), F.count_if(F.col("push") & F.col("size").isNull()).alias("undeclared")
    )
    return sums.groupBy("event_date", "owner_name").agg(
        F.lit("observed_owner_prefix").alias("owner_classification"),
        F.sum("n").alias("event_count"),
        F.countDistinct("repo_id").alias("repository_count"),
        F.countDistinct("actor_id").alias("active_actor_count"),
        F.sum(F.when(F.col("actor_id").isNull(), F.col("n")).otherwise(0)).alias("missing_actor_events"),
        F.sum("pushes").alias("push_events"),
        F.sum("declared").alias("declared_commit_count"),
        F.sum("undeclared").alias("missing_declared_commit_events"),
        F.lit(coverage).alias("coverage"),
    )


def week_coverage(covered: DataFrame) -> DataFrame:
    """(week_start, covered_days) of a calendar of covered dates."""
    return covered.groupBy(week_of("covered_date").alias("week_start")).agg(F.count("*").alias("covered_days"))


def contributor_weekly(events: DataFrame, covered: DataFrame) -> DataFrame:
    """Known actors' weeks, summed by day and repository first; weeks without a covered day go."""
    days = events.where("actor_id is not null").groupBy(week_of("event_time").alias("week_start"), "actor_id", "event_date", "repo_id").agg(F.count("*").alias("n"))
    weeks = days.groupBy("week_start", "actor_id").agg(F.sum("n").alias("event_count"), F.countDistinct("event_date").alias("active_days"), F.countDistinct("repo_id").alias("repository_count"))
    return weeks.join(week_coverage(covered), "week_start").withColumn("coverage", F.when(F.col("covered_days") == 7, "COMPLETE").otherwise("PARTIAL"))


def type_totals(events: DataFrame) -> DataFrame:
    """Events by type, with a sum of ids that can't overflow."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.col("repo_id").cast("decimal(38,0)")).alias("repo_sum"), F.count("actor_id").alias("known_actor_events"))


def published_summary(daily: DataFrame) -> DataFrame:
    """One row of totals over a published daily rollup."""
    return daily.agg(F.count("*").alias("repositories"), *(F.sum(c).alias(c) for c in ("event_count", "push_events", "pr_opened", "pr_closed", "pr_merged", "issue_opened", "issue_closed")))


def declared_by_owner(push_facts: DataFrame, events: DataFrame) -> DataFrame:
    """Stated commits of owners' days from typed facts, for checks against owner_daily."""
    joined = push_facts.select("event_id", "declared_commit_count").join(events.select("event_id", "event_date", "repo_name"), "event_id")
    return joined.groupBy("event_date", owner_of("repo_name").alias("owner_name")).agg(F.count("*").alias("n"), F.sum("declared_commit_count").alias("declared"), F.count_if(F.col("declared_commit_count").isNull()).alias("missing"))


