"""Events of known types, and typed facts of five of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fields import json_bool, json_long, json_text, json_time

# The event types that facts are made of.
KNOWN_TYPES = (
    "PushEvent", "PullRequestEvent", "IssuesEvent", "IssueCommentEvent", "ReleaseEvent", "WatchEvent", "ForkEvent", "CreateEvent", "DeleteEvent",
    "PublicEvent", "PullRequestReviewEvent", "CommitCommentEvent", "GollumEvent", "MemberEvent", "PullRequestReviewCommentEvent",
)
KEYS = ("event_id", "event_date", "event_time", "repo_id", "actor_id")


def split_known(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with event_date and without the raw line, rows of other types)."""
    known = F.col("event_type").isin(*KNOWN_TYPES)
    return unique.where(known).drop("raw_json").withColumn("event_date", F.to_date("event_time")), unique.where(~known)


def _typed(events: DataFrame, event_type: str, **columns: Column) -> DataFrame:
    return events.where(F.col("event_type") == event_type).select(*KEYS, *(c.alias(n) for n, c in columns.items()))


def pushes(events: DataFrame) -> DataFrame:
    p = "payload_json"
    return _typed(events, "PushEvent", ref=json_text(p, "ref"), declared_commit_count=json_long(p, "size"), observed_commit_array_count=F.json_array_length(json_text(p, "commits")))


def pull_requests(events: DataFrame) -> DataFrame:
    p, pr = "payload_json", "pull_request"
    return _typed(
        events, "PullRequestEvent", action=json_text(p, "action"), pr_number=json_long(p, "number"), author_id=json_long(p, f"{pr}.user.id"), state=json_text(p, f"{pr}.state"), merged=json_bool(p, f"{pr}.merged"),
        created_at=json_time(p, f"{pr}.created_at"), closed_at=json_time(p, f"{pr}.closed_at"), merged_at=json_time(p, f"{pr}.merged_at"),
    )


def issues(events: DataFrame) -> DataFrame:
    p = "payload_json"
    return _typed(events, "IssuesEvent", action=json_text(p, "action"), issue_number=json_long(p, "issue.number"), state=json_text(p, "issue.state"), created_at=json_time(p, "issue.created_at"), closed_at=json_time(p, "issue.closed_at"))


def issue_comments(events: DataFrame) -> DataFrame:
    p = "payload_json"
    return _typed(events, "IssueCommentEvent", action=json_text(p, "action"), issue_number=json_long(p, "issue.number"), comment_id=json_long(p, "comment.id"))


def releases(events: DataFrame) -> DataFrame:
    p, r = "payload_json", "release"
    return _typed(events, "ReleaseEvent", tag=json_text(p, f"{r}.tag_name"), draft=json_bool(p, f"{r}.draft"), prerelease=json_bool(p, f"{r}.prerelease"), published_at=json_time(p, f"{r}.published_at"))


FACTS = {"dwd_push_event": pushes, "dwd_pull_request_event": pull_requests, "dwd_issue_event": issues, "dwd_issue_comment_event": issue_comments, "dwd_release_event": releases}
