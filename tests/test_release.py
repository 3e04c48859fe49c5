import collections
import json
import os

import pytest

from marlstone import release as r


def test_ranges():
    assert r.dates_between("2024-02-27", "2024-03-01") == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]
    for bad in (("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-08"), ("2024-1-1", "2024-01-01")):
        with pytest.raises(ValueError):
            r.dates_between(*bad)


def test_requests():
    assert r.parsed_request({"start_date": "2024-01-01", "end_date": "2024-01-02"}) == [("2024-01-01", None), ("2024-01-02", None)]
    assert r.parsed_request({"process_date": "2024-01-01", "process_hour": 5}) == [("2024-01-01", 5)]
    for bad in ({}, {"start_date": "2024-01-01"}, {"process_date": "2024-01-01", "process_hour": True}, {"process_date": "2024-01-01", "process_hour": "5"}, {"start_date": "2024-01-01", "end_date": "2024-01-01", "process_hour": 1}):
        with pytest.raises(ValueError):
            r.parsed_request(bad)


def test_documents_are_replaced_whole(tmp_path):
    path = tmp_path / "a" / "x.json"
    r.write_json(path, {"v": 1})
    with pytest.raises(TypeError):
        r.write_json(path, {("bad", "key"): 1})
    assert r.read_json(path) == {"v": 1}


def test_ledger_never_overdraws(tmp_path):
    ledger = tmp_path / "ledger"
    assert r.reserve(ledger, 60, "a", 100) == 60
    with pytest.raises(r.ReleaseError):
        r.reserve(ledger, 50, "b", 100)
    assert r.reserve(ledger, 40, "c", 100) == 100 and len(ledger.read_text().splitlines()) == 2


def test_leases(tmp_path):
    lease = r.Lease(tmp_path, "2024-01-01")
    lease.take("one")
    lease.take("one")
    for action in (lease.take, lease.give_back):
        with pytest.raises(r.ReleaseError):
            action("two")
    lease.give_back("one")
    lease.take("two")
    with pytest.raises(ValueError):
        r.Lease(tmp_path, "../x")


def test_stages_run_once_and_again_after_failure(tmp_path):
    run, calls = r.Run(tmp_path, "run1"), []

    def work():
        calls.append(1)
        run.fail_once("gate")
        return {"rows": 3}

    assert run.prepare("2024-01-01") == run.prepare("2024-01-01")
    with pytest.raises(r.ReleaseError):
        run.stage("2024-01-01", "ods", work)
    for _ in range(2):
        assert run.stage("2024-01-01", "ods", work)["result"] == {"rows": 3}
    assert len(calls) == 2
    free = collections.namedtuple("free", "free")
    with pytest.raises(r.ReleaseError, match="headroom"):
        run.stage("2024-01-01", "dwd", work, reserve_bytes=10, usage=lambda _: free(5))
    stopped = []
    with pytest.raises(r.ReleaseError), r.Watchdog(tmp_path, 10, lambda: stopped.append(1), every=0.01, usage=lambda _: free(5)):
        pass
    assert stopped == [1]


def staged(tmp_path, name, text="x"):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "t.parquet").write_text(text)
    return folder


def publish(publisher, tmp_path, date, identity="i", **more):
    return publisher.publish(date, staged(tmp_path, f"s-{date}"), release=f"r-{date}", identity=identity, facts={"date": date, "coverage": "COMPLETE"}, recheck=lambda: more.get("now", identity))


def test_publication_is_the_pointer(tmp_path):
    publisher = r.Publisher(tmp_path)
    with pytest.raises(r.ReleaseError, match="changed"):
        publish(publisher, tmp_path, "2024-01-01", now="j")
    assert publisher.current("2024-01-01") is None
    os.rename(tmp_path / "s-2024-01-01", tmp_path / "old")
    pointer = publish(publisher, tmp_path, "2024-01-01")
    assert publisher.published("2024-01-01") == json.loads(json.dumps(pointer)) and publisher.is_noop("2024-01-01", "i") and not publisher.is_noop("2024-01-01", "j")
    file = tmp_path / "releases" / "r-2024-01-01" / "t.parquet"
    assert file.stat().st_mode & 0o777 == 0o444
    file.chmod(0o644)
    file.write_text("changed")
    assert not publisher.is_noop("2024-01-01", "i")
    with pytest.raises(r.ReleaseError, match="exists"):
        publish(publisher, tmp_path, "2024-01-01")


def test_a_model_needs_seven_unchanged_days(tmp_path):
    publisher = r.Publisher(tmp_path)
    for d in r.dates_between("2024-01-01", "2024-01-07")[:6]:
        publish(publisher, tmp_path, d)
    for end in ("2024-01-06", "2024-01-07"):
        with pytest.raises(r.ReleaseError):
            r.complete_week(publisher, "2024-01-01", end)
    publish(publisher, tmp_path, "2024-01-07")
    assert len(r.complete_week(publisher, "2024-01-01", "2024-01-07")) == 7


def test_unsafe_files(tmp_path):
    (tmp_path / "ok").write_text("fine")
    (tmp_path / "big").write_text("x" * 100)
    (tmp_path / "key").write_text("-----BEGIN " + "PRIVATE KEY-----")
    (tmp_path / "link").symlink_to(tmp_path / "ok")
    assert r.unsafe_files(tmp_path, ["ok", "big", "key", "link"], most_bytes=50) == [("big", "size"), ("key", "secret"), ("link", "link")]
    digest = r.code_digest([tmp_path / "ok", tmp_path / "big"], tmp_path)
    assert digest == r.code_digest([tmp_path / "big", tmp_path / "ok"], tmp_path) and r.run_identity(digest, ["b", "a"]) == r.run_identity(digest, ["a", "b"])
