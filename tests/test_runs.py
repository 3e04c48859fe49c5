import gzip
import hashlib
import json

import pytest

from marlstone.operators.reconcile import GateError
from marlstone.operators.scd2 import ConflictError
from marlstone.plans import coordinator, runs
from marlstone.release import Publisher, ReleaseError, dates_between
from marlstone.sources.acquire import source_url


def line(i: int, date: str, hour: int, **more) -> str:
    return json.dumps({"id": str(i), "type": "PushEvent", "actor": {"id": i % 3, "login": "u"}, "repo": {"id": 7, "name": "o/r"}, "public": True, "created_at": f"{date}T{hour:02}:10:00Z", "payload": {"size": 2, "commits": []}} | more)


def source(folder, date: str, hour: int, lines: list[str]) -> dict:
    path = folder / f"{date}-{hour}.json.gz"
    path.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    return {"path": str(path), "source_url": source_url(date, hour), "source_date": date, "source_hour": hour, "sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "line_count": len(lines)}


def reports(root, run_id):
    return {p.name.split("-")[-1].split(".")[0]: json.loads(p.read_text()) for p in (root / "runs" / run_id).glob("*.report.json")}


def test_routing_and_gates(spark, tmp_path):
    date, first = "2024-01-01", line(1, "2024-01-01", 1, extra={"unlisted": 1})
    rows = [first, first, "{broken", line(2, date, 1, type="SponsorshipEvent"), line(3, date, 1, repo={"id": 1}), line(4, date, 2)]
    with pytest.raises(GateError, match="quarantine_zero"):
        runs.run_day(spark, tmp_path, date, [source(tmp_path, date, 1, rows)], run_id="r1", hours=[1])
    stages = reports(tmp_path, "r1")
    tables = {n: spark.read.parquet(str(tmp_path / "staging" / "2024-01-01-r1" / n)).count() for n in ("quarantine", "unknown_events", "excluded_duplicates", "dwd_event")}
    assert tables == {"quarantine": 3, "unknown_events": 1, "excluded_duplicates": 1, "dwd_event": 1}
    assert stages["ods"]["status"] == "VALIDATED" and stages["dwd"]["status"] == "FAILED" and Publisher(tmp_path).current(date) is None


def test_conflicting_copies_stop_a_day(spark, tmp_path):
    date = "2024-01-01"
    rows = [line(1, date, 1), line(1, date, 1, payload={"size": 3})]
    with pytest.raises(GateError, match="conflicting"):
        runs.run_day(spark, tmp_path, date, [source(tmp_path, date, 1, rows)], run_id="r1", hours=[1])


def test_partial_days_publish_as_partial(spark, tmp_path):
    date = "2024-01-01"
    hour = [source(tmp_path, date, 1, [line(1, date, 1), line(2, date, 1), line(1, date, 1)])]
    pointer = runs.run_day(spark, tmp_path, date, hour, run_id="r1", hours=[1])
    assert pointer["coverage"] == "PARTIAL" and pointer["tables"]["dwd_event"]["rows"] == 2 and pointer["tables"]["excluded_duplicates"]["rows"] == 1
    assert runs.run_day(spark, tmp_path, date, hour, run_id="r2", hours=[1])["release"] == pointer["release"]  # nothing to do
    with pytest.raises(ReleaseError):
        runs.read_published(spark, tmp_path, date)


@pytest.fixture(scope="module")
def week(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("week")
    for n, date in enumerate(dates_between("2024-01-01", "2024-01-07")):
        name = "before/r" if n < 3 else "after/r"
        files = [source(root, date, h, [line(100 * n + h, date, h, repo={"id": 7 + h % 2, "name": f"{name}{h % 2}"}, actor={"id": 1 + h % 2, "login": "u"})]) for h in (0, 1)]
        files += [source(root, date, h, [line(100 * n + h, date, h, repo={"id": 9, "name": "k/k"}, type="WatchEvent", actor={"login": "none"})]) for h in range(2, 24)]
        runs.run_day(spark, root, date, files, run_id="r1")
    return root


def test_published_days(spark, week):
    types, totals = runs.read_published(spark, week, "2024-01-03")
    assert [tuple(r) for r in types.collect()] == [("PushEvent", 2), ("WatchEvent", 22)] and totals.first().asDict()["event_count"] == 24
    assert not list((week / "leases").glob("*.lease"))


def test_model_of_a_week(spark, week):
    pointer = runs.run_model(spark, week, "2024-01-01", "2024-01-07", run_id="m1")
    rows = {n: t["rows"] for n, t in pointer["tables"].items()}
    assert rows["dim_repository_scd2"] == 5 and rows["dwd_event"] == 168 and rows["dws_contributor_weekly"] == 2 and rows["ads_contributor_retention"] == 1
    cohort = spark.read.parquet(f"{pointer['path']}/ads_contributor_retention").first()
    assert (cohort.cohort_size, cohort.maturity, cohort.retained_count) == (2, "IMMATURE", None)
    assert all(g["passed"] for g in runs.verify_model(spark, week, "2024-01-01", "2024-01-07"))
    assert runs.run_model(spark, week, "2024-01-01", "2024-01-07", run_id="m2")["release"] == pointer["release"]
    event = spark.read.parquet(f"{pointer['path']}/dwd_event").where("event_id = '201'").first().asDict()
    found = runs.raw_line(spark, week, "2024-01-03", event)
    assert found["event_id"] == "201" and found["raw_line_sha256"] == hashlib.sha256(line(201, "2024-01-03", 1, repo={"id": 8, "name": "before/r1"}, actor={"id": 2, "login": "u"}).encode()).hexdigest()
    with pytest.raises(ReleaseError):
        runs.raw_line(spark, week, "2024-01-03", event | {"line_number": 9})
    with pytest.raises(ReleaseError):
        runs.run_model(spark, week, "2024-01-01", "2024-01-06", run_id="m3")


def test_a_model_is_verified_with_its_days(spark, week):
    runs.run_model(spark, week, "2024-01-01", "2024-01-07", run_id="m1")
    found = coordinator.verify(week, spark)
    assert len(found) == 8 and not any(found.values())


def test_simultaneous_names_block_a_model(spark, week, tmp_path, monkeypatch):
    spoil = runs.scd2.observations
    monkeypatch.setattr(runs.scd2, "observations", lambda events: spoil(events).union(spoil(events).limit(1).withColumn("repo_name", runs.F.lit("x/y"))))
    monkeypatch.setattr(runs, "engine_digest", lambda: "other")
    with pytest.raises(ConflictError):
        runs.run_model(spark, week, "2024-01-01", "2024-01-07", run_id="m4")
    assert list((week / "staging").glob("*-conflicts"))
