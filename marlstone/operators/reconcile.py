"""Independent checks: what stored tables say against what facts say. Each gives the rows that disagree; none means equal."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fields import monday_of, owner_of
from marlstone.operators.rollups import THROUGHPUT, TREND, declared_by_owner

DAY = ["event_date", "repo_id"]


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, by the left's columns, whose copies differ in number, with surplus: copies on the left less those on the right. One aggregate proves both directions."""
    names = left.columns
    both = left.withColumn("__side", F.lit(1)).unionByName(right.select(*names).withColumn("__side", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("__side").alias("surplus")).where("surplus <> 0")


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the left has more copies of, as often as it has more."""
    return left.exceptAll(right.select(*left.columns))


def _differ(counted: DataFrame, daily: DataFrame, pairs: Mapping[str, str], *, sparse: bool = True) -> DataFrame:
    """Days of repositories where a derived column and its stored one disagree; in sparse facts a missing side is 0, else it is a difference itself."""
    d, s = counted.alias("d"), daily.select(*DAY, *(F.col(v).alias(f"s_{v}") for v in pairs.values())).alias("s")
    value = (lambda c: F.coalesce(c, F.lit(0))) if sparse else (lambda c: c)
    rule: Column = F.lit(False)
    for mine, stored in pairs.items():
        rule = rule | ~value(F.col(f"d.{mine}")).eqNullSafe(value(F.col(f"s.s_{stored}")))
    return d.join(s, DAY, "full_outer").where(rule).select(*DAY)


@dataclass(frozen=True)
class DayTables:
    """The tables that a day's reconciliation reads."""

    events: DataFrame
    pushes: DataFrame
    pull_requests: DataFrame
    issues: DataFrame
    releases: DataFrame
    daily: DataFrame
    trend: DataFrame
    throughput: DataFrame


def statements(t: DayTables) -> dict[str, DataFrame]:
    """The eleven independent statements over a day's tables, joined by date and repository."""
    acted = lambda action, *more: F.count(F.when((F.col("action") == action) & (more[0] if more else F.lit(True)), 1))
    of_type = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    repos = ["repo_id"]
    return {
        "events_and_actors": _differ(t.events.groupBy(*DAY).agg(F.count("*").alias("n"), F.countDistinct("actor_id").alias("actors")), t.daily, {"n": "event_count", "actors": "active_actors"}, sparse=False),
        "pushes": _differ(t.pushes.groupBy(*DAY).agg(F.count("*").alias("n")), t.daily, {"n": "push_events"}),
        "pull_requests": _differ(t.pull_requests.groupBy(*DAY).agg(acted("opened").alias("o"), acted("closed").alias("c"), acted("closed", F.col("merged")).alias("m")), t.daily, {"o": "pr_opened", "c": "pr_closed", "m": "pr_merged"}),
        "trend_repositories": one_sided(t.trend.select(*repos), t.daily),
        "throughput_in_daily": one_sided(t.throughput.select(*THROUGHPUT), t.daily),
        "issues": _differ(t.issues.groupBy(*DAY).agg(acted("opened").alias("o"), acted("closed").alias("c")), t.daily, {"o": "issue_opened", "c": "issue_closed"}),
        "releases": _differ(t.releases.groupBy(*DAY).agg(F.count("*").alias("n")), t.daily, {"n": "release_events"}),
        "watches_and_forks": _differ(t.events.groupBy(*DAY).agg(of_type("WatchEvent").alias("w"), of_type("ForkEvent").alias("f")), t.daily, {"w": "watch_events", "f": "fork_events"}),
        "trend_in_daily": one_sided(t.trend.select(*TREND), t.daily),
        "daily_in_trend": one_sided(t.daily.select(*TREND), t.trend),
        "daily_in_throughput": one_sided(t.daily.select(*THROUGHPUT), t.throughput),
    }


def owner_differences(events: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners' days whose events or actors aren't those of the facts, both ways."""
    derived = events.groupBy("event_date", owner_of("repo_name").alias("owner_name")).agg(F.count("*").alias("event_count"), F.countDistinct("actor_id").alias("active_actor_count"))
    return multiset_diff(derived, owners)


def owner_commit_differences(push_facts: DataFrame, events: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners' days whose pushes and stated commits aren't those of the typed facts; unknown sums must be unknown on both sides."""
    derived, day = declared_by_owner(push_facts, events), ["event_date", "owner_name"]
    wrong = F.col("event_count").isNull() | (F.col("push_events") != F.coalesce("n", F.lit(0))) | ~F.col("declared_commit_count").eqNullSafe(F.col("declared")) | (F.col("missing_declared_commit_events") != F.coalesce("missing", F.lit(0)))
    return owners.join(derived, day, "full_outer").where(wrong).select(*day)


def weekly_differences(events: DataFrame, weekly: DataFrame) -> DataFrame:
    derived = events.where("actor_id is not null").groupBy(monday_of("event_date").alias("week_start"), "actor_id").agg(F.count("*").alias("event_count"), F.countDistinct("event_date").alias("active_days"), F.countDistinct("repo_id").alias("repository_count"))
    return multiset_diff(derived, weekly)


class GateError(ValueError):
    """A gate that failed; later stages must not run."""


@dataclass
class Gates:
    """Named checks of a run, in order; the first failure stops it and stays in the report."""

    results: list[dict] = field(default_factory=list)

    def check(self, name: str, passed: bool, detail: object = None) -> None:
        self.results.append({"name": name, "passed": bool(passed), "detail": detail})
        if not passed:
            raise GateError(name)

    def none(self, name: str, rows: DataFrame) -> None:
        """Passes if there are no rows; one is enough to know."""
        self.check(name, rows.isEmpty())
