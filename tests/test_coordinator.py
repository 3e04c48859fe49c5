import gzip
import io
import json
from types import SimpleNamespace

import pytest

from marlstone.plans import coordinator, metrics, runs, stores
from marlstone.release import Publisher, ReleaseError, inventory, run_identity
from marlstone.sources.acquire import input_identity, source_url

DATE = "2024-01-01"


def body(n: int = 3) -> bytes:
    rows = [{"id": str(i), "type": "PushEvent", "actor": {"id": i, "login": "u"}, "repo": {"id": 7, "name": "o/r"}, "public": True, "created_at": f"{DATE}T01:10:00Z", "payload": {"size": 1, "commits": []}} for i in range(n)]
    return gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode(), mtime=0)


def opener(data: bytes, calls: list):
    class Reply(io.BytesIO):
        def __init__(self, url):
            super().__init__(data)
            self.url, self.headers = url, {"Content-Length": str(len(data))}

        def geturl(self):
            return self.url

    def open_(request):
        calls.append(request.get_method())
        return Reply(request.full_url)

    return open_


@pytest.fixture(scope="module")
def hour(spark, tmp_path_factory):
    """A published hour whose run failed once after a stage."""
    root, calls = tmp_path_factory.mktemp("hour"), []
    more = {"run_id": "r1", "budget": 1 << 20, "database": "hour_db", "download_reserve": 0, "opener": opener(body(), calls), "fail_after": "dwd"}
    request = {"process_date": DATE, "process_hour": 1}
    with pytest.raises(ReleaseError, match="injected"):
        coordinator.run_request(spark, root, request, **more)
    assert Publisher(root).current(DATE) is None and not list((root / "leases").glob("*.lease"))
    yield SimpleNamespace(root=root, request=request, more=more, calls=calls, pointer=coordinator.run_request(spark, root, request, **more)[0])
    spark.sql("DROP DATABASE hour_db CASCADE")


def test_an_hour_recovers_and_is_named(spark, hour):
    assert hour.calls == ["HEAD", "GET"] and hour.pointer["coverage"] == "PARTIAL" and hour.pointer["tables"]["dwd_event"]["rows"] == 3
    assert spark.table("hour_db.dwd_event_2024_01_01").count() == 3
    raw = next((hour.root / "raw").rglob("*.json.gz"))
    assert raw.read_bytes() == body() and raw.stat().st_mode & 0o222 == 0
    assert sum(json.loads(x)["bytes"] for x in (hour.root / "ledger.jsonl").read_text().splitlines()) == len(body())
    report = json.loads((hour.root / "runs" / "r1" / f"{DATE}-ods.report.json").read_text())
    assert report["result"]["cost"]["stages"] > 0 and report["result"]["cost"]["output_bytes"] > 0


def test_nothing_is_done_twice_unless_forced(spark, hour):
    again = {**hour.more, "run_id": "r2"}
    spark.sql("DROP TABLE hour_db.dwd_event_2024_01_01")
    assert coordinator.run_request(spark, hour.root, hour.request, **again)[0]["release"] == hour.pointer["release"]
    assert spark.table("hour_db.dwd_event_2024_01_01").count() == 3  # named anew
    forced = coordinator.run_request(spark, hour.root, hour.request, **{**again, "run_id": "r3", "fail_after": None}, force=True)[0]
    assert forced["release"] != hour.pointer["release"] and forced["identity"] == hour.pointer["identity"]
    coordinator.check_names(spark, "hour_db", forced)
    with pytest.raises(ValueError):
        coordinator.check_names(spark, "hour_db", hour.pointer)


def test_verification(spark, hour, tmp_path):
    assert coordinator.verify(hour.root) == {DATE: []} and coordinator.main([str(hour.root)]) == 0 and coordinator.main([str(tmp_path)]) == 1
    now = Publisher(hour.root).current(DATE)
    file = next(f for f in now["inventory"] if f.startswith("dwd_event/") and f.endswith(".parquet"))
    path = hour.root / "releases" / now["release"] / file
    before = path.read_bytes()
    path.chmod(0o644)
    path.write_bytes(before + b"x")
    try:
        assert coordinator.verify(hour.root) == {DATE: [f"file {file}"]} and coordinator.main([str(hour.root)]) == 1
    finally:
        path.write_bytes(before)


def test_a_budget_is_kept(spark, tmp_path):
    calls = []
    with pytest.raises(ReleaseError, match="bytes would be used"):
        coordinator.run_request(spark, tmp_path, {"process_date": DATE, "process_hour": 1}, run_id="r1", budget=10, download_reserve=0, opener=opener(body(), calls))
    assert calls == ["HEAD"]


def test_low_room_stops_a_running_stage(spark, tmp_path):
    file = tmp_path / "a.json.gz"
    file.write_bytes(body())
    manifest = {"path": str(file), "source_url": source_url(DATE, 1), "source_date": DATE, "source_hour": 1, "sha256": "0" * 64, "line_count": 3}
    free = iter([100])  # enough when the stage begins, none later
    with pytest.raises(ReleaseError, match="headroom"):
        runs.run_day(spark, tmp_path, DATE, [manifest], run_id="r1", hours=[1], reserve_bytes=50, usage=lambda _: SimpleNamespace(free=next(free, 0)))
    assert json.loads((tmp_path / "runs" / "r1" / f"{DATE}-ods.report.json").read_text())["status"] == "FAILED"
    assert Publisher(tmp_path).current(DATE) is None and run_identity("c", [input_identity(manifest)])


def test_raw_files_are_never_overwritten(spark, tmp_path):
    import hashlib

    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    digest = {n: hashlib.sha256(n.encode()).hexdigest() for n in "ab"}
    home = f"file:{tmp_path}/raw/x"
    for _ in range(2):
        assert stores.publish_raw(spark, tmp_path / "a", home, digest["a"]) == home
    with pytest.raises(ReleaseError, match="another"):
        stores.publish_raw(spark, tmp_path / "b", home, digest["b"])
    with pytest.raises(ReleaseError, match="changed"):
        stores.publish_raw(spark, tmp_path / "b", f"file:{tmp_path}/raw/y", digest["a"])
    assert [p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith(".")] == ["x"]


def test_checksums_by_tasks_equal_the_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 3 as k").write.partitionBy("k").parquet(path)
    wanted = {f: (a["bytes"], a["sha256"]) for f, a in inventory(path).items() if not f.rsplit("/", 1)[-1].startswith(("_", "."))}
    found = stores.checksums(spark, path)
    assert {r.file: (r.bytes, r.sha256) for r in found.collect()} == wanted
    kept = spark.createDataFrame([(f, *a) for f, a in wanted.items()], "file string, bytes long, sha256 string")
    assert stores.differing(found, kept).isEmpty()
    name = min(wanted)
    assert [r.file for r in stores.differing(found, kept.where(f"file <> '{name}'")).collect()] == [name]
    assert stores.differing(found, kept.withColumn("bytes", kept.bytes + 1)).count() == len(wanted)


def test_cost_of_a_query(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    with metrics.measured(spark) as cost:
        assert spark.read.parquet(str(tmp_path / "t")).groupBy((metrics.F.col("id") % 7).alias("k")).count().count() == 7
    assert cost["input_rows"] == 1000 and cost["input_bytes"] > 0 and cost["shuffle_write_bytes"] > 0 and cost["disk_spill_bytes"] == 0 and cost["tasks"] >= cost["stages"] >= 2
    with metrics.measured(spark) as nothing:
        pass
    assert nothing["stages"] == 0 and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_cost_from_an_event_log(spark, tmp_path):
    def start(stages, group, execution):
        return {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": stages, "Properties": {"spark.jobGroup.id": group, "spark.sql.execution.id": execution}}

    def end(stage, rows, cpu):
        return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Metrics": {"Executor CPU Time": cpu, "Input Metrics": {"Bytes Read": 8 * rows, "Records Read": rows}}}

    events = [start([0, 1], "a", "5"), end(0, 10, 1), end(0, 20, 2), end(1, 0, 3), start([1, 2], "b", "6"), end(2, 5, 4), start([3], None, None), end(3, 1, 1), {"Event": "SparkListenerApplicationEnd"}]
    (tmp_path / "log").write_text("".join(json.dumps(e) + "\n" for e in events) + "{broken\n")
    found = {r.job_group: r.asDict() for r in metrics.of_event_log(spark, str(tmp_path / "log")).collect()}
    assert {g: (r["execution_id"], r["stages"], r["tasks"], r["input_rows"], r["input_bytes"], r["cpu_ns"]) for g, r in found.items()} == {"a": (5, 2, 3, 30, 240, 6), "b": (6, 1, 1, 5, 40, 4), None: (None, 1, 1, 1, 8, 1)}
