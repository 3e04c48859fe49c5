"""The driver's events table read as an event log: the same rules in DataFrame functions and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import read_table

E = F.expr

# Rules over k (an integer of props), user_id, event_id and ts, in words that both dialects share.
TYPE = (
    "CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'PullRequestEvent' WHEN 'purchase' THEN 'IssuesEvent' WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'ReleaseEvent' ELSE 'WatchEvent' END"
    " ELSE CASE WHEN k % 2 = 0 THEN 'IssueCommentEvent' ELSE 'ForkEvent' END END"
)
ACTOR = "CASE WHEN k % 10 = 0 THEN NULL ELSE user_id END"
REPO = "user_id % 40 + 1"
ACTION = "CASE k % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' ELSE 'reopened' END"
PAYLOAD = f"""CASE event_type
 WHEN 'click' THEN concat('{{"ref":"refs/heads/b', k % 3, '"', CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"size":', k) END, ',"commits":[', CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '{{"sha":"a"}}' ELSE '{{"sha":"a"}},{{"sha":"b"}}' END, ']}}')
 WHEN 'view' THEN concat('{{"action":"', {ACTION}, '","number":', k, ',"pull_request":{{"user":{{"id":', user_id, '}},"state":"', CASE WHEN k % 3 = 1 THEN 'closed' ELSE 'open' END, '","merged":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, ',"created_at":"2024-01-01T00:00:', lpad(CAST(k % 60 AS STRING), 2, '0'), 'Z"', CASE WHEN k % 7 = 0 THEN ',"merged_at":"nope"' ELSE '' END, '}}}}')
 WHEN 'purchase' THEN concat('{{"action":"', {ACTION}, '","issue":{{"number":', k, ',"state":"', CASE WHEN k % 3 = 1 THEN 'closed' ELSE 'open' END, '","created_at":"2024-01-02T03:04:', lpad(CAST(k % 60 AS STRING), 2, '0'), 'Z"}}}}')
 WHEN 'signup' THEN concat('{{"action":"published","release":{{"tag_name":"v', k, '","draft":', CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END, ',"prerelease":', CASE WHEN k % 6 = 0 THEN '"maybe"' ELSE 'false' END, ',"published_at":"2024-01-03T00:00:00Z"}}}}')
 ELSE concat('{{"action":"created","issue":{{"number":', k, '}},"comment":{{"id":', k + 1000, '}}}}') END"""

ORACLE_EVENTS = f"""
x AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS event_date, (CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS week FROM events),
ev AS (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id, {TYPE} AS event_type, {ACTOR} AS actor_id, {REPO} AS repo_id,
              concat('o', (({REPO}) + week % 2) % 7, '/r', {REPO}) AS repo_name, ts AS event_time, event_date, week, user_id, k, {PAYLOAD.replace("AS STRING", "AS VARCHAR")} AS payload_json,
              CAST(hour(ts) AS INTEGER) AS source_hour, event_id AS line_number, strftime(ts, '%Y-%m-%d') AS source_date FROM x)
"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Typed events, each once: event_id, event_type, actor_id, repo_id, repo_name, event_time, event_date, payload_json, source_date, source_hour, line_number; and n, week, user_id, k for rules of single queries."""
    rows = read_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    rows = rows.withColumn("event_date", F.to_date("ts")).withColumn("week", F.floor(F.datediff("event_date", F.lit("2024-01-01").cast("date")) / 7))
    return rows.select(
        F.col("event_id").alias("n"),
        F.col("event_id").cast("string").alias("event_id"),
        E(TYPE).alias("event_type"),
        E(ACTOR).alias("actor_id"),
        E(REPO).alias("repo_id"),
        E(f"concat('o', (({REPO}) + week % 2) % 7, '/r', {REPO})").alias("repo_name"),
        F.col("ts").alias("event_time"),
        "event_date",
        "week",
        "user_id",
        "k",
        E(PAYLOAD).alias("payload_json"),
        F.date_format("ts", "yyyy-MM-dd").alias("source_date"),
        F.hour("ts").alias("source_hour"),
        F.col("event_id").alias("line_number"),
    )


#: What is wrong with a line, by k % 40; None elsewhere.
FAULTS = {3: "invalid_json_or_event_id", 7: "invalid_json_or_event_id", 9: "missing_event_type", 11: "invalid_repository", 13: "invalid_event_time", 15: "not_public", 17: "source_hour_mismatch"}


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the log as JSON text, some of them broken on purpose, with their file's facts."""
    rows = events(spark, folder)
    fault = F.col("k") % 40
    envelope = F.concat(
        F.lit('{"id":"'), F.when(fault == 7, "x").otherwise(""), "event_id", F.lit('"'),
        F.when(fault == 9, "").otherwise(F.concat(F.lit(',"type":"'), "event_type", F.lit('"'))),
        F.lit(',"actor":{'), F.coalesce(F.concat(F.lit('"id":'), F.col("actor_id").cast("string"), F.lit(",")), F.lit("")), F.lit('"login":"u'), F.col("user_id").cast("string"),
        F.lit('"},"repo":{"id":'), F.col("repo_id").cast("string"), F.lit(',"name":"'), F.when(fault == 11, "nameless").otherwise(F.col("repo_name")),
        F.lit('"},"public":'), F.when(fault == 15, "false").otherwise("true"), F.lit(',"created_at":"'),
        F.when(fault == 13, "nope").otherwise(F.date_format(F.when(fault == 17, F.col("event_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("event_time")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit('","payload":'), "payload_json", F.lit("}"),
    )
    return rows.select("line_number", F.when(fault == 3, F.lit("{broken")).otherwise(envelope).alias("raw_json"), "source_date", "source_hour", F.concat(F.lit("log/"), "source_date", F.lit("-"), F.col("source_hour").cast("string")).alias("source_file"), F.sha2("source_date", 256).alias("source_sha256"))


def with_copies(rows: DataFrame, *, conflicting: bool = False) -> DataFrame:
    """Events with a copy of each 97th, up to two hours before and on a later line; raw_json is the payload, which conflicting copies of each 194th change."""
    rows = rows.withColumn("raw_json", F.col("payload_json"))
    copies = rows.where("n % 97 = 0").withColumn("source_hour", F.greatest(F.col("source_hour") - F.col("n") % 3, F.lit(0)).cast("int")).withColumn("line_number", F.col("line_number") + 1_000_000)
    if conflicting:
        copies = copies.withColumn("raw_json", F.when(F.col("n") % 194 == 0, F.concat("raw_json", F.lit(" "))).otherwise(F.col("raw_json")))
    return rows.unionByName(copies)


#: Whose event it is where users come and go: their own in weeks in which they are active, in others that of somebody seen in that week only.
PASSER_BY = "CASE WHEN week >= user_id % 5 AND (user_id + week) % 3 <> 0 THEN actor_id ELSE actor_id + 1000000 * (week + 1) END"


def coming_and_going(rows: DataFrame) -> DataFrame:
    """All events, by actors of whom cohorts differ."""
    return rows.withColumn("actor_id", E(PASSER_BY).cast("bigint"))


def covered_dates(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_date").alias("covered_date")).distinct()


def spoiled(daily: DataFrame) -> DataFrame:
    """A daily rollup with known errors, for the checks to find."""
    more = {"event_count": 7, "push_events": 5, "pr_opened": 4, "issue_opened": 6, "release_events": 8, "watch_events": 9}
    add = lambda c, m: (F.col(c) + F.when(F.col("repo_id") % m == 0, 1).otherwise(0)).alias(c)
    return daily.where("repo_id % 11 <> 0").select(*(add(c, more[c]) if c in more else F.col(c) for c in daily.columns))


