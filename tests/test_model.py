import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dedup, facts, reconcile, retention, rollups, scd2
from marlstone.sources.tables import calendar

UTC = dt.UTC


def day(n: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, n, hour, tzinfo=UTC)


OBSERVED = "repo_id long, repo_name string, observed_at timestamp"
BASE = [(1, "o/a", day(1)), (1, "o/a", day(2)), (1, "p/b", day(4)), (1, "o/a", day(6)), (1, "o/a", day(6))]


def versions(spark, rows):
    return [tuple(r) for r in scd2.scd2(spark.createDataFrame(rows, OBSERVED)).orderBy("repo_id", "valid_from").select("repo_sk", "repo_id", "repo_name", "owner_name", F.dayofmonth("valid_from"), F.dayofmonth("valid_to"), "is_current").collect()]


def test_versions_collapse_and_come_back(spark):
    found = versions(spark, BASE)
    assert [r[2:] for r in found] == [("o/a", "o", 1, 4, False), ("p/b", "p", 4, 6, False), ("o/a", "o", 6, None, True)]
    assert len({r[0] for r in found}) == 3


def test_versions_dont_depend_on_order_and_take_late_rows(spark):
    found = versions(spark, BASE)
    for seed in range(3):
        rows = BASE[:]
        random.Random(seed).shuffle(rows)
        assert versions(spark, rows) == found
    late = versions(spark, [*BASE, (1, "o/c", day(3))])
    assert [r[4:6] for r in late] == [(1, 3), (3, 4), (4, 6), (6, None)]


def test_conflicts_take_the_repository_out_and_block(spark, tmp_path):
    rows = [*BASE, (1, "o/x", day(4)), (2, "q/z", day(1))]
    assert {r[1] for r in versions(spark, rows)} == {2}
    conflicts = scd2.name_conflicts(spark.createDataFrame(rows, OBSERVED))
    assert [r.observed_names for r in conflicts.collect()] == [["o/x", "p/b"]]
    with pytest.raises(scd2.ConflictError):
        scd2.require_publishable(conflicts, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    scd2.require_publishable(conflicts.where("false"), str(tmp_path / "q"))


def test_as_of_is_half_open(spark):
    dimension = scd2.scd2(spark.createDataFrame(BASE, OBSERVED))
    times = [day(4), day(6), dt.datetime(2023, 12, 31, tzinfo=UTC), day(5, 23)]
    rows = scd2.as_of(spark.createDataFrame([(1, t) for t in times], "repo_id long, event_time timestamp"), dimension).collect()
    keys = {r.event_time.replace(tzinfo=None): r.repo_sk for r in rows}
    ids = [r[0] for r in versions(spark, BASE)]
    assert len(rows) == 4 and [keys[t.replace(tzinfo=None)] for t in times] == [ids[1], ids[2], None, ids[1]]
    assert scd2.broken_versions(dimension).isEmpty() and scd2.not_one_current(dimension).isEmpty()
    assert scd2.broken_versions(dimension.withColumn("is_current", F.lit(True))).count() == 2


EVENTS = "actor_id long, repo_id long, repo_name string, event_time timestamp, event_date date, event_type string, payload_json string"


def pushes(*rows):
    return [(actor, repo, f"o/r{repo}", day(d, 1), dt.date(2024, 1, d), "PushEvent", payload) for actor, repo, d, payload in rows]


PUSHES = pushes((1, 1, 1, "{}"), (2, 1, 1, '{"size":0}'), (1, 2, 1, '{"size":2}'), (1, 1, 8, "{}"))


def dates(n: int):
    return [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def test_owner_counts_are_distinct_and_unknown_is_not_zero(spark):
    first, second = rollups.owner_daily(spark.createDataFrame(PUSHES, EVENTS)).orderBy("event_date").collect()
    assert (first.event_count, first.active_actor_count, first.repository_count, first.declared_commit_count, first.missing_declared_commit_events) == (3, 2, 2, 2, 1)
    assert (second.declared_commit_count, second.missing_declared_commit_events, second.push_events) == (None, 1, 1)


@pytest.mark.parametrize(("rows", "days", "expected"), [(PUSHES, 14, (2, 1, 0.5, "MATURE")), (PUSHES, 7, (2, None, None, "IMMATURE")), (PUSHES[:3], 14, (2, 0, 0.0, "MATURE")), (PUSHES, 13, (2, None, None, "IMMATURE"))])
def test_retention_waits_for_its_week(spark, rows, days, expected):
    covered = calendar(spark, dates(days))
    weekly = rollups.contributor_weekly(spark.createDataFrame(rows, EVENTS), covered)
    first = retention.retention(weekly, covered).orderBy("cohort_week").first()
    assert (first.cohort_size, first.retained_count, first.retention_rate, first.maturity) == expected


def test_weeks_without_coverage_go_and_partial_ones_say_so(spark):
    weekly = rollups.contributor_weekly(spark.createDataFrame(PUSHES, EVENTS), calendar(spark, dates(5)))
    assert [(r.actor_id, r.covered_days, r.coverage) for r in weekly.orderBy("actor_id").collect()] == [(1, 5, "PARTIAL"), (2, 5, "PARTIAL")]


COPIES = "event_id string, source_hour int, line_number long, raw_json string"
ROWS = [("1", 3, 2, "x"), ("1", 1, 9, "x"), ("2", 2, 1, "y"), ("3", 2, 2, "z"), ("3", 2, 5, "z")]


def test_canonical_copies(spark):
    found = dedup.deduplicate(spark.createDataFrame(ROWS, COPIES))
    assert {tuple(r)[:3] for r in found.unique.collect()} == {("1", 1, 9), ("2", 2, 1), ("3", 2, 2)}
    assert {(r.event_id, r.line_number, r.canonical_source_hour, r.canonical_line_number) for r in found.excluded.collect()} == {("1", 2, 1, 9), ("3", 5, 2, 2)}
    assert found.repeated.count() == 4 and dedup.conflicts(found.repeated).isEmpty()
    kept, excluded = dedup.deduplicate_by_line(spark.createDataFrame(ROWS, COPIES))
    assert {(r.event_id, r.line_number) for r in kept.collect()} == {("1", 2), ("2", 1), ("3", 2)} and excluded.count() == 2


def test_conflicting_copies(spark):
    rows = spark.createDataFrame([*ROWS, ("1", 4, 1, "other"), ("4", 1, 1, None), ("4", 1, 2, "v")], COPIES)
    assert {r.event_id for r in dedup.conflicts(dedup.deduplicate(rows).repeated).collect()} == {"1", "4"}


def test_malformed_payloads_are_null(spark):
    rows = [(str(i), dt.date(2024, 1, 1), day(1), 1, 1, kind, p) for i, (kind, p) in enumerate([("PushEvent", '{"size":"x","commits":{}}'), ("PushEvent", "nope"), ("ReleaseEvent", '{"release":{"draft":"maybe","published_at":"nope"}}')])]
    events = spark.createDataFrame(rows, "event_id string, event_date date, event_time timestamp, repo_id long, actor_id long, event_type string, payload_json string")
    assert [(r.declared_commit_count, r.observed_commit_array_count) for r in facts.pushes(events).collect()] == [(None, None)] * 2
    assert [(r.draft, r.published_at) for r in facts.releases(events).collect()] == [(None, None)]


def test_multiset_difference(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert {tuple(r) for r in reconcile.multiset_diff(a, b).collect()} == {(1, 1), (2, 1), (3, -1)}
    assert reconcile.multiset_diff(a, a).isEmpty() and sorted(str(r.x) for r in reconcile.one_sided(a, b).collect()) == ["1", "2"]


def test_gates_stop_at_the_first_failure(spark):
    gates = reconcile.Gates()
    gates.none("none", spark.range(0))
    with pytest.raises(reconcile.GateError, match="some"):
        gates.none("some", spark.range(1))
    assert [g["passed"] for g in gates.results] == [True, False]
