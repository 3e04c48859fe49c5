"""Whole runs: a day from its hourly files to a publication, a week's model from seven published days, and what consumers read."""

from __future__ import annotations

import datetime as dt
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import dedup, facts, ingest, reconcile, retention, rollups, scd2
from marlstone.plans.catalog import ROW_GROUP, partition_columns, write_table
from marlstone.plans.metrics import job_group, of_group
from marlstone.release import Lease, Publisher, ReleaseError, Run, Watchdog, code_digest, complete_week, run_identity
from marlstone.sources.acquire import input_identity, require_hours
from marlstone.sources.lines import MANIFEST, read_lines, with_manifest
from marlstone.sources.tables import calendar, union_tables

PACKAGE = Path(__file__).resolve().parents[1]


def engine_digest() -> str:
    """Of the code that makes the tables."""
    return code_digest([p for part in ("functions", "sources", "operators", "plans") for p in (PACKAGE / part).glob("*.py")], PACKAGE)


class Staged:
    """Tables that a run writes below one folder, each once, and reads back from there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables = spark, folder, {}

    def write(self, name: str, df: DataFrame) -> int:
        big_lines = name == "ods_github_event_raw"
        about = write_table(df, f"{self.folder}/{name}", partition_by=partition_columns(name, df), row_group=ROW_GROUP if big_lines else None)
        self.tables[name] = {k: about[k] for k in ("rows", "partitions", "schema")}
        plan = Path(self.folder, "plans", f"{name}.txt")
        plan.parent.mkdir(exist_ok=True)
        plan.write_text(about["plan"])
        return about["rows"]

    def read(self, name: str) -> DataFrame:
        return read_stored(self.spark, self.folder, name, self.tables[name])


def read_stored(spark: SparkSession, folder: str, name: str, about: dict) -> DataFrame:
    """A table of a release with the columns it was written with; partition values are text in paths, so types come from the release."""
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{folder}/{name}")


def run_day(spark: SparkSession, root: str | Path, date: str, sources: list[dict], *, run_id: str, hours: Iterable[int] = range(24), force: bool = False, reserve_bytes: int = 0, fail_after: str | None = None, usage=shutil.disk_usage) -> dict:
    """Publishes a day from manifests with the path of each file, or returns the publication that is there if inputs and code are the same.

    Stages are kept under run_id and not run again after they passed. The first gate that fails ends the run; then nothing is published.
    force: builds and publishes again what is there. reserve_bytes: free space without which no stage starts, and below which a running one is cancelled. fail_after: a stage after which the run fails once, to try recovery.
    """
    publisher, run, hours = Publisher(root), Run(root, run_id), sorted(hours)
    coverage = require_hours(sources, date, hours)

    def identity() -> str:
        return run_identity(engine_digest(), map(input_identity, sources))

    made_of = identity()
    if not force and publisher.is_noop(date, made_of):
        return publisher.current(date)
    lease = Lease(Path(root) / "leases", date)
    lease.take(run_id)
    try:
        context = run.prepare(date)
        staged = Staged(spark, context["staging"])

        def stage(name: str, work) -> None:
            def watched() -> dict:
                with job_group(spark, f"{date}-{run_id}-{name}") as group, Watchdog(root, reserve_bytes, lambda: spark.sparkContext.cancelJobGroup(group), usage=usage):
                    gates = work().results
                return {"gates": gates, "tables": staged.tables, "cost": of_group(spark, group)}

            report = run.stage(date, name, watched, reserve_bytes=reserve_bytes, usage=usage)
            staged.tables |= report["result"]["tables"]
            if fail_after == name:
                run.fail_once(f"{date}-{name}")

        stage("ods", lambda: _ods(staged, sources, run_id))
        stage("dwd", lambda: _dwd(staged))
        stage("dws", lambda: _dws(staged, coverage, len(hours)))
        stage("ads", lambda: _ads(staged))
        stage("quality", lambda: _quality(staged, date, coverage, len(hours)))
        about = {"date": date, "coverage": coverage, "hours": hours, "tables": staged.tables}
        return publisher.publish(date, staged.folder, release=context["release"], identity=made_of, facts=about, recheck=identity)
    finally:
        lease.give_back(run_id)


def _ods(staged: Staged, sources: list[dict], run_id: str) -> reconcile.Gates:
    gates, spark = reconcile.Gates(), staged.spark
    files = spark.createDataFrame([(f"file:{Path(m['path']).resolve()}", m["source_date"], m["source_hour"], m["sha256"]) for m in sources], MANIFEST)
    rows = ingest.classified(with_manifest(read_lines(spark, [str(m["path"]) for m in sources]), files), run_id).persist(StorageLevel.DISK_ONLY)
    try:
        rejected = staged.write("quarantine", rows.where("reason is not null"))
        valid = staged.write("ods_github_event_raw", rows.where("reason is null").drop("reason"))
        wanted = sum(m["line_count"] for m in sources)
        gates.check("raw_line_reconciliation", rows.count() == wanted == valid + rejected, {"expected": wanted, "ods": valid, "quarantine": rejected})
    finally:
        rows.unpersist()
    return gates


def _dwd(staged: Staged) -> reconcile.Gates:
    gates, ods = reconcile.Gates(), staged.read("ods_github_event_raw")
    found = dedup.deduplicate(ods)
    gates.none("conflicting_duplicate_ids", dedup.conflicts(found.repeated))
    excluded = staged.write("excluded_duplicates", found.excluded)
    events, unknown = facts.split_known(found.unique)
    strange, known = staged.write("unknown_events", unknown), staged.write("dwd_event", events)
    stored = staged.read("dwd_event")
    for name, make in facts.FACTS.items():
        staged.write(name, make(stored))
    counts = {"ods": staged.tables["ods_github_event_raw"]["rows"], "dwd": known, "duplicates": excluded, "unknown": strange}
    gates.check("ods_dwd_reconciliation", counts["ods"] == known + excluded + strange, counts)
    gates.check("quarantine_zero", staged.tables["quarantine"]["rows"] == 0, staged.tables["quarantine"]["rows"])
    gates.check("unknown_zero", strange == 0, strange)
    gates.none("event_id_unique", stored.groupBy("event_id").count().where("count > 1"))
    return gates


def _dws(staged: Staged, coverage: str, hours: int) -> reconcile.Gates:
    events = staged.read("dwd_event")
    staged.write("dim_repository_observed", rollups.observed_dimension(events))
    staged.write("dws_repository_daily", rollups.repository_daily(events, coverage=coverage, observed_hours=hours))
    return reconcile.Gates()


def _ads(staged: Staged) -> reconcile.Gates:
    daily = staged.read("dws_repository_daily")
    staged.write("ads_repository_activity_trend", rollups.activity_trend(daily))
    staged.write("ads_pr_issue_throughput", rollups.pr_issue_throughput(daily))
    return reconcile.Gates()


def _quality(staged: Staged, date: str, coverage: str, hours: int) -> reconcile.Gates:
    gates, daily = reconcile.Gates(), staged.read("dws_repository_daily")
    names = ("dwd_event", "dwd_push_event", "dwd_pull_request_event", "dwd_issue_event", "dwd_release_event")
    tables = reconcile.DayTables(*map(staged.read, names), daily, staged.read("ads_repository_activity_trend"), staged.read("ads_pr_issue_throughput"))
    for name, mismatches in reconcile.statements(tables).items():
        gates.none(f"independent_{name}", mismatches)
    gates.none("coverage", daily.where((F.col("coverage") != coverage) | (F.col("observed_hours") != hours)))
    gates.none("event_date", tables.events.where(F.col("event_date") != F.lit(date).cast("date")))
    return gates


def read_published(spark: SparkSession, root: str | Path, date: str) -> tuple[DataFrame, DataFrame]:
    """A complete day for consumers: (events by type, in order, and one row of totals)."""
    pointer = Publisher(root).published(date)
    events, daily = (read_stored(spark, pointer["path"], n, pointer["tables"][n]) for n in ("dwd_event", "dws_repository_daily"))
    return events.groupBy("event_type").agg(F.count("*").alias("events")).orderBy("event_type"), rollups.published_summary(daily)


def run_model(spark: SparkSession, root: str | Path, start: str, end: str, *, run_id: str) -> dict:
    """Publishes the model of seven complete published days: versions, events with their version, owners, contributors and cohorts."""
    publisher, run, name = Publisher(root), Run(root, run_id), f"model-{start}-{end}"
    days = complete_week(publisher, start, end)

    def identity() -> str:
        return run_identity(engine_digest(), [d["identity"] for d in complete_week(publisher, start, end)])

    made_of = identity()
    if publisher.is_noop(name, made_of):
        return publisher.current(name)
    lease = Lease(Path(root) / "leases", name)
    lease.take(run_id)
    try:
        staged = Staged(spark, str(Path(root) / "staging" / f"{name}-{run_id}"))
        report = run.stage(start, name, lambda: {"gates": _model(staged, days).results, "tables": staged.tables})
        tables = report["result"]["tables"]
        return publisher.publish(name, staged.folder, release=f"{name}-{run_id}", identity=made_of, facts={"start": start, "end": end, "coverage": "COMPLETE", "tables": tables}, recheck=identity)
    finally:
        lease.give_back(run_id)


def _model(staged: Staged, days: list[dict]) -> reconcile.Gates:
    gates, spark = reconcile.Gates(), staged.spark
    events = union_tables(read_stored(spark, d["path"], "dwd_event", d["tables"]["dwd_event"]) for d in days)
    wanted = sum(d["tables"]["dwd_event"]["rows"] for d in days)
    gates.check("input_row_counts", events.count() == wanted, wanted)
    gates.none("cross_date_event_id_unique", events.groupBy("event_id").count().where("count > 1"))
    observed = scd2.observations(events)
    scd2.require_publishable(scd2.name_conflicts(observed), f"{staged.folder}-conflicts")
    versions = staged.write("dim_repository_scd2", scd2.scd2(observed))
    dimension = staged.read("dim_repository_scd2")
    gates.check("surrogate_unique", dimension.select("repo_sk").distinct().count() == versions, versions)
    gates.none("one_current", scd2.not_one_current(dimension))
    linked = staged.write("dwd_event", scd2.as_of(events, dimension))
    gates.check("asof_no_row_multiplication", linked == wanted, linked)
    enriched = staged.read("dwd_event")
    gates.none("asof_no_missing_keys", enriched.where("repo_sk is null"))
    covered = calendar(spark, [dt.date.fromisoformat(d["date"]) for d in days])
    staged.write("dws_organisation_daily", rollups.owner_daily(enriched))
    staged.write("dws_contributor_weekly", rollups.contributor_weekly(enriched, covered))
    weekly = staged.read("dws_contributor_weekly")
    staged.write("ads_contributor_retention", retention.retention(weekly, covered))
    gates.check("owner_total_reconciles", staged.read("dws_organisation_daily").agg(F.sum("event_count")).first()[0] == wanted)
    gates.check("weekly_total_reconciles", (weekly.agg(F.sum("event_count")).first()[0] or 0) == enriched.where("actor_id is not null").count())
    gates.none("immature_retention_null", staged.read("ads_contributor_retention").where("maturity = 'IMMATURE' and (retained_count is not null or retention_rate is not null)"))
    return gates


def verify_model(spark: SparkSession, root: str | Path, start: str, end: str) -> list[dict]:
    """Checks a published model against its days by other ways than those that made it; raises at the first difference."""
    publisher, gates = Publisher(root), reconcile.Gates()
    model, days = publisher.published(f"model-{start}-{end}"), complete_week(publisher, start, end)
    stored = {n: read_stored(spark, model["path"], n, about) for n, about in model["tables"].items()}
    for name, table in stored.items():
        gates.check(f"{name}_rows", table.count() == model["tables"][name]["rows"])
    events, dimension, weekly = stored["dwd_event"], stored["dim_repository_scd2"], stored["dws_contributor_weekly"]
    pushes = union_tables(read_stored(spark, d["path"], "dwd_push_event", d["tables"]["dwd_push_event"]) for d in days)
    gates.none("scd_intervals", scd2.broken_versions(dimension))
    gates.none("asof_links", scd2.broken_links(events, dimension))
    gates.none("owner_independent", reconcile.owner_differences(events, stored["dws_organisation_daily"]))
    gates.none("owner_commit_independent", reconcile.owner_commit_differences(pushes, events, stored["dws_organisation_daily"]))
    gates.none("weekly_independent", reconcile.weekly_differences(events, weekly))
    actors = events.where("actor_id is not null").select("actor_id").distinct().count()
    gates.check("cohort_denominator", (stored["ads_contributor_retention"].agg(F.sum("cohort_size")).first()[0] or 0) == actors, actors)
    return gates.results


def raw_line(spark: SparkSession, root: str | Path, date: str, event: dict) -> dict:
    """The stored raw line of an event, found by its hour, line and file checksum, with the digest of its text."""
    pointer = Publisher(root).published(date)
    ods = read_stored(spark, pointer["path"], "ods_github_event_raw", pointer["tables"]["ods_github_event_raw"])
    where = (F.col("source_hour") == event["source_hour"]) & (F.col("line_number") == event["line_number"]) & (F.col("source_sha256") == event["source_sha256"])
    found = ods.where(where).select("event_id", F.sha2("raw_json", 256).alias("raw_line_sha256")).collect()
    if len(found) != 1 or found[0].event_id != event["event_id"]:
        raise ReleaseError("the line isn't where its event says")
    return found[0].asDict()
