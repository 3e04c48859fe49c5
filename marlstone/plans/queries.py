"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from marlstone.functions.fields import hash_sample as sampled
from marlstone.operators import dedup, facts, ingest, reconcile, retention, rollups, scd2
from marlstone.plans import adapter, layouts
from marlstone.plans.scratch import scratch
from marlstone.sources import lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them, and whole numbers as bigint, so that both engines give the same types."""
    kinds = {f.name: "timestamp_ntz" if isinstance(f.dataType, TimestampType) else "bigint" for f in df.schema if isinstance(f.dataType, (TimestampType, DecimalType))}
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, folder: plain(function(spark, folder))
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def with_events(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([adapter.ORACLE_EVENTS.strip(), *ctes]) + "\n" + select


def _count_if(rule: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {rule}) AS {name}"


ACTION = "json_extract_string(payload_json, '$.action')"
DAILY = f"""daily AS (SELECT event_date, repo_id, count(*) AS event_count, {_count_if("event_type = 'PushEvent'", "push_events")},
 {_count_if(f"event_type = 'PullRequestEvent' AND {ACTION} = 'opened'", "pr_opened")}, {_count_if(f"event_type = 'PullRequestEvent' AND {ACTION} = 'closed'", "pr_closed")},
 {_count_if(f"event_type = 'PullRequestEvent' AND {ACTION} = 'closed' AND json_extract_string(payload_json, '$.pull_request.merged') = 'true'", "pr_merged")},
 {_count_if(f"event_type = 'IssuesEvent' AND {ACTION} = 'opened'", "issue_opened")}, {_count_if(f"event_type = 'IssuesEvent' AND {ACTION} = 'closed'", "issue_closed")},
 count(DISTINCT actor_id) AS active_actors, {_count_if("event_type = 'ReleaseEvent'", "release_events")}, {_count_if("event_type = 'WatchEvent'", "watch_events")}, {_count_if("event_type = 'ForkEvent'", "fork_events")},
 'COMPLETE' AS coverage, 24 AS observed_hours FROM ev GROUP BY event_date, repo_id)"""
SPOILED = """spoiled AS (SELECT event_date, repo_id, event_count + (repo_id % 7 = 0)::BIGINT AS event_count, push_events + (repo_id % 5 = 0)::BIGINT AS push_events, pr_opened + (repo_id % 4 = 0)::BIGINT AS pr_opened, pr_closed, pr_merged,
 issue_opened + (repo_id % 6 = 0)::BIGINT AS issue_opened, issue_closed, active_actors, release_events + (repo_id % 8 = 0)::BIGINT AS release_events, watch_events + (repo_id % 9 = 0)::BIGINT AS watch_events, fork_events, coverage, observed_hours
 FROM daily WHERE repo_id % 11 <> 0)"""
TREND, THROUGHPUT = ", ".join(rollups.TREND), ", ".join(rollups.THROUGHPUT)


@query(with_events(DAILY, select="SELECT * FROM daily"))
def repository_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.repository_daily(adapter.events(spark, folder))


@query(with_events(DAILY, select=f"SELECT {TREND} FROM daily"))
def activity_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.activity_trend(repository_daily(spark, folder))


@query(with_events(DAILY, select=f"SELECT {THROUGHPUT} FROM daily"))
def pr_issue_throughput(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.pr_issue_throughput(repository_daily(spark, folder))


@query(with_events(select="SELECT repo_id, repo_name, split_part(repo_name, '/', 1) AS owner_name, min(event_time) AS first_observed_at, max(event_time) AS last_observed_at FROM ev GROUP BY repo_id, repo_name"))
def observed_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.observed_dimension(adapter.events(spark, folder))


FAULT = "CASE k % 40 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in adapter.FAULTS.items()) + " END"


@query(with_events(select=f"SELECT event_id, event_type, repo_id, repo_name, actor_id, concat('u', user_id) AS actor_login, true AS public, date_trunc('second', event_time) AS event_time, payload_json, line_number, source_date, source_hour FROM ev WHERE {FAULT} IS NULL"))
def ingest_valid(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = ingest.ingest(adapter.raw_lines(spark, folder))
    return valid.select("event_id", "event_type", "repo_id", "repo_name", "actor_id", "actor_login", "public", "event_time", "payload_json", "line_number", "source_date", "source_hour")


@query(with_events(select=f"SELECT {FAULT} AS reason, count(*) AS lines FROM ev WHERE {FAULT} IS NOT NULL GROUP BY 1"))
def ingest_quarantine_reasons(spark: SparkSession, folder: str) -> DataFrame:
    _, quarantine = ingest.ingest(adapter.raw_lines(spark, folder))
    return quarantine.groupBy("reason").agg(F.count("*").alias("lines"))


@query(with_events(select="SELECT event_id, 'SponsorshipEvent' AS event_type, repo_id FROM ev WHERE k % 50 = 7"))
def unknown_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapter.events(spark, folder).withColumns({"event_type": F.when(F.col("k") % 50 == 7, "SponsorshipEvent").otherwise(F.col("event_type")), "raw_json": F.col("payload_json")})
    _, unknown = facts.split_known(rows)
    return unknown.select("event_id", "event_type", "repo_id")


def _sql_time(path: str) -> str:
    return f"TRY_CAST(replace(json_extract_string(payload_json, '$.{path}'), 'Z', '') AS TIMESTAMP)"


def _sql_long(path: str) -> str:
    return f"TRY_CAST(json_extract_string(payload_json, '$.{path}') AS BIGINT)"


def _sql_fact(event_type: str, columns: str) -> str:
    return with_events(select=f"SELECT event_id, event_date, event_time, repo_id, actor_id, {columns} FROM ev WHERE event_type = '{event_type}'")


@query(_sql_fact("PushEvent", f"json_extract_string(payload_json, '$.ref') AS ref, {_sql_long('size')} AS declared_commit_count, CAST(json_array_length(json_extract(payload_json, '$.commits')) AS INTEGER) AS observed_commit_array_count"))
def fact_push(spark: SparkSession, folder: str) -> DataFrame:
    return facts.pushes(adapter.events(spark, folder))


@query(
    _sql_fact(
        "PullRequestEvent",
        f"{ACTION} AS action, {_sql_long('number')} AS pr_number, {_sql_long('pull_request.user.id')} AS author_id, json_extract_string(payload_json, '$.pull_request.state') AS state, TRY_CAST(json_extract_string(payload_json, '$.pull_request.merged') AS BOOLEAN) AS merged,"
        f" {_sql_time('pull_request.created_at')} AS created_at, {_sql_time('pull_request.closed_at')} AS closed_at, {_sql_time('pull_request.merged_at')} AS merged_at",
    )
)
def fact_pull_request(spark: SparkSession, folder: str) -> DataFrame:
    return facts.pull_requests(adapter.events(spark, folder))


@query(_sql_fact("IssuesEvent", f"{ACTION} AS action, {_sql_long('issue.number')} AS issue_number, json_extract_string(payload_json, '$.issue.state') AS state, {_sql_time('issue.created_at')} AS created_at, {_sql_time('issue.closed_at')} AS closed_at"))
def fact_issue(spark: SparkSession, folder: str) -> DataFrame:
    return facts.issues(adapter.events(spark, folder))


@query(_sql_fact("IssueCommentEvent", f"{ACTION} AS action, {_sql_long('issue.number')} AS issue_number, {_sql_long('comment.id')} AS comment_id"))
def fact_issue_comment(spark: SparkSession, folder: str) -> DataFrame:
    return facts.issue_comments(adapter.events(spark, folder))


@query(
    _sql_fact(
        "ReleaseEvent",
        f"json_extract_string(payload_json, '$.release.tag_name') AS tag, TRY_CAST(json_extract_string(payload_json, '$.release.draft') AS BOOLEAN) AS draft, TRY_CAST(json_extract_string(payload_json, '$.release.prerelease') AS BOOLEAN) AS prerelease, {_sql_time('release.published_at')} AS published_at",
    )
)
def fact_release(spark: SparkSession, folder: str) -> DataFrame:
    return facts.releases(adapter.events(spark, folder))


COPIES = """c AS (SELECT n, event_id, payload_json AS raw_json, source_hour, line_number FROM ev UNION ALL
 SELECT n, event_id, payload_json || CASE WHEN n % 194 = 0 THEN ' ' ELSE '' END, CAST(greatest(source_hour - n % 3, 0) AS INTEGER), line_number + 1000000 FROM ev WHERE n % 97 = 0)"""
POSITIONS = """p AS (SELECT *, row_number() OVER w AS rn, first_value(source_hour) OVER w AS canonical_source_hour, first_value(line_number) OVER w AS canonical_line_number FROM c WINDOW w AS (PARTITION BY event_id ORDER BY source_hour, line_number))"""


@query(with_events(COPIES, POSITIONS, select="SELECT event_id, source_hour, line_number FROM p WHERE rn = 1"))
def dedup_unique(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(adapter.with_copies(adapter.events(spark, folder))).unique.select("event_id", "source_hour", "line_number")


@query(with_events(COPIES, POSITIONS, select="SELECT event_id, source_hour, line_number, canonical_source_hour, canonical_line_number FROM p WHERE rn > 1"))
def dedup_excluded(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(adapter.with_copies(adapter.events(spark, folder))).excluded.select("event_id", "source_hour", "line_number", "canonical_source_hour", "canonical_line_number")


@query(with_events(COPIES, select="SELECT event_id, line_number, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY line_number) AS INTEGER) AS rn FROM c) WHERE rn > 1"))
def dedup_row_number(spark: SparkSession, folder: str) -> DataFrame:
    _, excluded = dedup.deduplicate_by_line(adapter.with_copies(adapter.events(spark, folder)))
    return excluded.select("event_id", "line_number", "rn")


@query(with_events(COPIES, select="SELECT event_id FROM c GROUP BY event_id HAVING count(DISTINCT raw_json) > 1"))
def conflicting_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.conflicts(dedup.deduplicate(adapter.with_copies(adapter.events(spark, folder), conflicting=True)).repeated)


OBSERVED = "o AS (SELECT DISTINCT repo_id, repo_name, event_time AS observed_at FROM ev)"
VERSIONS = """ch AS (SELECT * FROM (SELECT *, lag(repo_name) OVER (PARTITION BY repo_id ORDER BY observed_at) AS before FROM o) WHERE before IS NULL OR before <> repo_name),
iv AS (SELECT repo_id, repo_name, split_part(repo_name, '/', 1) AS owner_name, observed_at AS valid_from, lead(observed_at) OVER (PARTITION BY repo_id ORDER BY observed_at) AS valid_to FROM ch),
ha AS (SELECT *, sha256(CAST(to_json({'repo_name': repo_name, 'owner_name': owner_name}) AS VARCHAR)) AS attribute_hash FROM iv),
dim AS (SELECT sha256(CAST(to_json({'repo_id': repo_id, 'valid_from': strftime(valid_from, '%Y-%m-%dT%H:%M:%S.%fZ'), 'attribute_hash': attribute_hash}) AS VARCHAR)) AS repo_sk, repo_id, repo_name, owner_name, valid_from, valid_to, valid_to IS NULL AS is_current, attribute_hash FROM ha)"""


def _dimension(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.scd2(scd2.observations(adapter.events(spark, folder)))


@query(with_events(OBSERVED, VERSIONS, select="SELECT * FROM dim"))
def scd2_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return _dimension(spark, folder)


@query(with_events(select="SELECT repo_id, min(event_time) AS observed_at, array_to_string(list_sort([min_by(repo_name, event_time), 'zz/other']), ',') AS observed_names FROM ev WHERE repo_id % 13 = 0 GROUP BY repo_id"))
def scd2_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    seen = scd2.observations(adapter.events(spark, folder))
    second = seen.where("repo_id % 13 = 0").groupBy("repo_id").agg(F.lit("zz/other").alias("repo_name"), F.min("observed_at").alias("observed_at"))
    return scd2.name_conflicts(seen.unionByName(second)).withColumn("observed_names", F.array_join("observed_names", ","))


ENRICHED = "en AS (SELECT ev.*, dim.repo_sk FROM ev LEFT JOIN dim ON ev.repo_id = dim.repo_id AND ev.event_time >= dim.valid_from AND (dim.valid_to IS NULL OR ev.event_time < dim.valid_to))"


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.as_of(adapter.events(spark, folder), _dimension(spark, folder))


@query(with_events(OBSERVED, VERSIONS, ENRICHED, select="SELECT event_id, event_time, repo_id, repo_sk FROM en"))
def asof_enriched(spark: SparkSession, folder: str) -> DataFrame:
    return _enriched(spark, folder).select("event_id", "event_time", "repo_id", "repo_sk")


INTEGRITY = """SELECT (SELECT count(*) FROM en LEFT JOIN dim d USING (repo_sk) WHERE d.repo_sk IS NULL OR en.repo_id <> d.repo_id OR en.repo_name <> d.repo_name OR en.event_time < d.valid_from OR en.event_time >= d.valid_to) AS broken_links,
 (SELECT count(*) FROM (SELECT *, lead(valid_from) OVER (PARTITION BY repo_id ORDER BY valid_from) AS following FROM dim) WHERE valid_to IS DISTINCT FROM following OR valid_to <= valid_from OR is_current <> (valid_to IS NULL)) AS broken_versions,
 (SELECT count(*) FROM (SELECT repo_id FROM dim GROUP BY repo_id HAVING count(*) FILTER (WHERE is_current) <> 1)) AS not_one_current"""


def _integrity(enriched: DataFrame, dimension: DataFrame) -> DataFrame:
    counts = [(scd2.broken_links(enriched, dimension), "broken_links"), (scd2.broken_versions(dimension), "broken_versions"), (scd2.not_one_current(dimension), "not_one_current")]
    rows = [df.select(F.lit(name).alias("name")) for df, name in counts]
    found = rows[0].union(rows[1]).union(rows[2])
    return found.agg(*(F.count_if(F.col("name") == name).alias(name) for _, name in counts))


@query(with_events(OBSERVED, VERSIONS, ENRICHED, select=INTEGRITY))
def scd2_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return _integrity(_enriched(spark, folder), _dimension(spark, folder))


#: The same checks over versions with known errors: late ends, lost versions, versions that are current beside the last one.
WRONG = """wrong AS (SELECT * REPLACE (CASE WHEN repo_id % 5 = 0 THEN valid_to + INTERVAL 1 HOUR ELSE valid_to END AS valid_to, is_current OR (repo_id % 7 = 0 AND hour(valid_from) % 2 = 0) AS is_current)
 FROM dim WHERE NOT (repo_id % 11 = 0 AND day(valid_from) % 2 = 0))"""


@query(with_events(OBSERVED, VERSIONS, ENRICHED, WRONG, select=INTEGRITY.replace("FROM dim", "FROM wrong").replace("JOIN dim", "JOIN wrong")))
def scd2_integrity_of_errors(spark: SparkSession, folder: str) -> DataFrame:
    late = F.when(F.col("repo_id") % 5 == 0, F.col("valid_to") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("valid_to"))
    wrong = _dimension(spark, folder).where("not (repo_id % 11 = 0 and day(valid_from) % 2 = 0)")
    wrong = wrong.withColumns({"valid_to": late, "is_current": F.col("is_current") | ((F.col("repo_id") % 7 == 0) & (F.hour("valid_from") % 2 == 0))})
    return _integrity(_enriched(spark, folder), wrong)


@query(with_events(select="SELECT source_file, line_number, CAST(row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS BIGINT) AS place FROM (SELECT 'log/' || source_date || '-' || source_hour AS source_file, line_number FROM ev)"))
def lines_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Places of lines within their files."""
    rows = adapter.raw_lines(spark, folder).select("source_file", F.col("line_number").alias("n"))
    return lines.numbered(rows, "n").select("source_file", F.col("n").alias("line_number"), F.col("line_number").alias("place"))


@query(with_events(select="SELECT line_number, 'log/' || f.source_date || '-' || f.source_hour AS source_file, f.source_hour, f.source_date FROM ev JOIN (SELECT DISTINCT source_date, source_hour FROM ev) f USING (source_date, source_hour)"))
def lines_with_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with what their files' manifests say."""
    rows = adapter.raw_lines(spark, folder)
    manifests = rows.select("source_file", "source_date", "source_hour", "source_sha256").distinct()
    return lines.with_manifest(rows.select("line_number", "source_file"), manifests).select("line_number", "source_file", "source_hour", "source_date")


OWNERS = """ow AS (SELECT event_date, split_part(repo_name, '/', 1) AS owner_name, 'observed_owner_prefix' AS owner_classification, count(*) AS event_count, count(DISTINCT repo_id) AS repository_count, count(DISTINCT actor_id) AS active_actor_count,
 count(*) FILTER (WHERE actor_id IS NULL) AS missing_actor_events, count(*) FILTER (WHERE event_type = 'PushEvent') AS push_events, CAST(sum(CASE WHEN event_type = 'PushEvent' THEN TRY_CAST(json_extract_string(payload_json, '$.size') AS BIGINT) END) AS BIGINT) AS declared_commit_count,
 count(*) FILTER (WHERE event_type = 'PushEvent' AND json_extract_string(payload_json, '$.size') IS NULL) AS missing_declared_commit_events, 'COMPLETE' AS coverage FROM ev GROUP BY 1, 2)"""


@query(with_events(OWNERS, select="SELECT * FROM ow"))
def owner_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.owner_daily(adapter.events(spark, folder))


WEEKLY = """cov AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS covered_days FROM (SELECT DISTINCT event_date AS d FROM ev) GROUP BY 1),
ac AS (SELECT CAST(date_trunc('week', event_time) AS DATE) AS week_start, actor_id, count(*) AS event_count, count(DISTINCT event_date) AS active_days, count(DISTINCT repo_id) AS repository_count FROM av
 WHERE actor_id IS NOT NULL GROUP BY 1, 2),
wk AS (SELECT ac.*, covered_days, CASE WHEN covered_days = 7 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM ac JOIN cov USING (week_start))"""


ALL_EVENTS, VARIED = "av AS (SELECT * FROM ev)", f"av AS (SELECT * REPLACE (CAST({adapter.PASSER_BY} AS BIGINT) AS actor_id) FROM ev)"


def _weekly(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    covered = adapter.covered_dates(rows)
    return rollups.contributor_weekly(rows, covered), covered


@query(with_events(ALL_EVENTS, WEEKLY, select="SELECT * FROM wk"))
def contributor_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _weekly(adapter.events(spark, folder))[0]


@query(
    with_events(
        VARIED,
        WEEKLY,
        "fs AS (SELECT actor_id, min(week_start) AS cohort_week FROM wk GROUP BY actor_id)",
        "co AS (SELECT cohort_week, count(*) AS cohort_size, count(b.actor_id) AS returned FROM fs LEFT JOIN (SELECT actor_id, week_start FROM wk) b ON b.actor_id = fs.actor_id AND b.week_start = fs.cohort_week + 7 GROUP BY cohort_week)",
        select="SELECT cohort_week, CAST(cohort_week + 7 AS DATE) AS observation_week, cohort_size, coalesce(a.covered_days, 0) AS cohort_covered_days, coalesce(b.covered_days, 0) AS observation_covered_days,"
        " CASE WHEN a.covered_days = 7 AND b.covered_days = 7 THEN returned END AS retained_count, CASE WHEN a.covered_days = 7 AND b.covered_days = 7 THEN CAST(returned AS DOUBLE) / cohort_size END AS retention_rate,"
        " CASE WHEN a.covered_days = 7 AND b.covered_days = 7 THEN 'MATURE' ELSE 'IMMATURE' END AS maturity, 'first_observed_in_selected_sample' AS cohort_definition"
        " FROM co LEFT JOIN cov a ON a.week_start = cohort_week LEFT JOIN cov b ON b.week_start = cohort_week + 7",
    )
)
def contributor_retention(spark: SparkSession, folder: str) -> DataFrame:
    return retention.retention(*_weekly(adapter.coming_and_going(adapter.events(spark, folder))))


def _day_tables(spark: SparkSession, folder: str) -> reconcile.DayTables:
    """A day's tables with a rollup that has known errors."""
    rows = adapter.events(spark, folder)
    daily = rollups.repository_daily(rows)
    return reconcile.DayTables(rows, facts.pushes(rows), facts.pull_requests(rows), facts.issues(rows), facts.releases(rows), adapter.spoiled(daily), rollups.activity_trend(daily), rollups.pr_issue_throughput(daily))


def _sql_differ(*columns: str, sparse: bool = True) -> str:
    value = "coalesce({}.{}, 0)" if sparse else "{}.{}"
    rule = " OR ".join(f"{value.format('g', c)} IS DISTINCT FROM {value.format('s', c)}" for c in columns)
    return f"FROM daily g FULL JOIN spoiled s ON g.event_date = s.event_date AND g.repo_id = s.repo_id WHERE {rule}"


def _sql_except(columns: str, left: str, right: str) -> str:
    return f"FROM (SELECT {columns} FROM {left} EXCEPT ALL SELECT {columns} FROM {right})"


_STATEMENTS = {
    "events_and_actors": _sql_differ("event_count", "active_actors", sparse=False),
    "pushes": _sql_differ("push_events"),
    "pull_requests": _sql_differ("pr_opened", "pr_closed", "pr_merged"),
    "trend_repositories": _sql_except("repo_id", "daily", "spoiled"),
    "throughput_in_daily": _sql_except(THROUGHPUT, "daily", "spoiled"),
    "issues": _sql_differ("issue_opened", "issue_closed"),
    "releases": _sql_differ("release_events"),
    "watches_and_forks": _sql_differ("watch_events", "fork_events"),
    "trend_in_daily": _sql_except(TREND, "daily", "spoiled"),
    "daily_in_trend": _sql_except(TREND, "spoiled", "daily"),
    "daily_in_throughput": _sql_except(THROUGHPUT, "spoiled", "daily"),
}


def _statement(name: str) -> Query:
    return lambda spark, folder: reconcile.statements(_day_tables(spark, folder))[name].agg(F.count("*").alias("mismatches"))


for _name, _sql in _STATEMENTS.items():
    QUERIES[f"reconcile_{_name}"] = _statement(_name)
    ORACLE_SQL[f"reconcile_{_name}"] = with_events(DAILY, SPOILED, select=f"SELECT count(*) AS mismatches {_sql}")


@query(with_events(DAILY, SPOILED, select=f"SELECT {TREND}, CAST(sum(side) AS BIGINT) AS surplus FROM (SELECT {TREND}, 1 AS side FROM daily UNION ALL SELECT {TREND}, -1 FROM spoiled) GROUP BY ALL HAVING sum(side) <> 0"))
def multiset_diff(spark: SparkSession, folder: str) -> DataFrame:
    daily = repository_daily(spark, folder)
    return reconcile.multiset_diff(rollups.activity_trend(daily), rollups.activity_trend(adapter.spoiled(daily)))


@query(with_events(OWNERS, select="SELECT event_date, owner_name FROM ow WHERE owner_name = 'o3' AND declared_commit_count IS NOT NULL"))
def owner_commit_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapter.events(spark, folder)
    owners = rollups.owner_daily(rows).withColumn("declared_commit_count", F.col("declared_commit_count") + F.when(F.col("owner_name") == "o3", 1).otherwise(0))
    return reconcile.owner_commit_differences(facts.pushes(rows), rows, owners)


@query(with_events(OWNERS, select="SELECT event_date, owner_name, unnest([event_count, event_count + 1]) AS event_count, active_actor_count, unnest([1::BIGINT, -1::BIGINT]) AS surplus FROM ow WHERE owner_name = 'o5'"))
def owner_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapter.events(spark, folder)
    return reconcile.owner_differences(rows, rollups.owner_daily(rows).withColumn("event_count", F.col("event_count") + F.when(F.col("owner_name") == "o5", 1).otherwise(0)))


@query(with_events(ALL_EVENTS, WEEKLY, select="SELECT week_start, actor_id, event_count, active_days, repository_count, 1::BIGINT AS surplus FROM wk WHERE actor_id % 9 = 0"))
def weekly_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapter.events(spark, folder)
    return reconcile.weekly_differences(rows, _weekly(rows)[0].where("actor_id % 9 <> 0"))


TOTALS = "SELECT event_type, count(*) AS events, CAST(sum(repo_id) AS BIGINT) AS repo_sum, count(actor_id) AS known_actor_events FROM ev"


@query(with_events(select=f"{TOTALS} GROUP BY event_type"))
def type_totals_all(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.type_totals(adapter.events(spark, folder))


@query(with_events(select=f"{TOTALS} WHERE event_date = DATE '2024-01-01' GROUP BY event_type"))
def type_totals_one_day(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.type_totals(adapter.events(spark, folder).where("event_date = DATE '2024-01-01'"))


def _join_query(strategy: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch(spark)
        _dimension(spark, folder).write.parquet(path)  # planned and run once, then measured, joined as of a time, and joined by key
        dimension = spark.read.parquet(path)
        return layouts.joined(scd2.as_of(adapter.events(spark, folder), dimension), dimension, strategy)

    QUERIES[f"join_{strategy}"] = lambda spark, folder: plain(run(spark, folder))
    ORACLE_SQL[f"join_{strategy}"] = with_events(OBSERVED, VERSIONS, ENRICHED, select="SELECT dim.owner_name, count(*) AS events, CAST(sum(en.repo_id) AS BIGINT) AS repo_sum FROM en JOIN dim USING (repo_sk) GROUP BY dim.owner_name")


for _name in layouts.JOIN_NODES:
    _join_query(_name)


def _layout_query(name: str, hourly: bool) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = adapter.events(spark, folder).where("event_date = DATE '2024-01-01'").select("event_id", "event_type", "repo_id", "actor_id", "source_hour")
        return rollups.type_totals(layouts.write_layout(rows, scratch(spark), hourly=hourly).where("source_hour = 12"))

    QUERIES[f"hour_totals_{name}_layout"] = lambda spark, folder: plain(run(spark, folder))
    ORACLE_SQL[f"hour_totals_{name}_layout"] = with_events(select=f"{TOTALS} WHERE event_date = DATE '2024-01-01' AND source_hour = 12 GROUP BY event_type")


_layout_query("hourly", True)
_layout_query("compact", False)


@query(with_events(DAILY, select="SELECT count(*) AS repositories, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("event_count", "push_events", "pr_opened", "pr_closed", "pr_merged", "issue_opened", "issue_closed")) + " FROM daily WHERE event_date = DATE '2024-01-01'"))
def published_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.published_summary(repository_daily(spark, folder).where("event_date = DATE '2024-01-01'"))


@query()
def partition_homogeneity(spark: SparkSession, folder: str) -> DataFrame:
    """Input partitions of the table with more than one hour: here its one file has them all."""
    return ingest.mixed_partitions(adapter.raw_lines(spark, folder))


@query()
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _dimension(spark, folder).where(sampled("repo_sk", 4)).select("repo_sk", "owner_name")
