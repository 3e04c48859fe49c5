import gzip
import io
import json

import pytest

from marlstone.operators.ingest import ingest, mixed_partitions
from marlstone.sources import acquire as a
from marlstone.sources.lines import MANIFEST, read_lines, with_manifest


def packed(*lines: bytes) -> bytes:
    return gzip.compress(b"".join(line + b"\n" for line in lines))


class Reply:
    def __init__(self, body: bytes, url: str, length: int | None = None):
        self.body, self.url, self.headers = io.BytesIO(body), url, {"Content-Length": str(len(body) if length is None else length)}

    def read(self, n: int) -> bytes:
        return self.body.read(n)

    def geturl(self) -> str:
        return self.url

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def opener(body: bytes, *, length: int | None = None, url: str | None = None, calls: list | None = None):
    def open_(request):
        if calls is not None:
            calls.append(request.get_method())
        return Reply(body, url or request.full_url, length)

    return open_


def manifest(hour: int, **more) -> dict:
    return {"source_date": "2024-01-01", "source_hour": hour, "source_url": a.source_url("2024-01-01", hour), "sha256": "a" * 64} | more


@pytest.mark.parametrize(("date", "hour"), [("2024-1-01", 0), ("2024-13-01", 0), ("2024-01-01", 24), ("2024-01-01", True), ("2024-01-01", "1"), (None, 1), ("2024-01-01", -1)])
def test_addresses_reject_bad_dates_and_hours(date, hour):
    with pytest.raises(ValueError):
        a.source_url(date, hour)


def test_hours_are_not_padded_in_addresses():
    assert a.source_url("2024-01-01", 3).endswith("/2024-01-01-3.json.gz")


def test_coverage():
    assert a.require_hours(map(manifest, range(24)), "2024-01-01") == "COMPLETE"
    assert a.require_hours([manifest(4)], "2024-01-01", [4]) == "PARTIAL"
    for bad in ([manifest(h) for h in range(23)], [manifest(0), *map(manifest, range(24))], [manifest(0, sha256="x"), *map(manifest, range(1, 24))], [manifest(0, source_url="elsewhere"), *map(manifest, range(1, 24))]):
        with pytest.raises(a.SourceError):
            a.require_hours(bad, "2024-01-01")
    with pytest.raises(ValueError):
        a.require_hours([], "2024-01-01", [])


def test_gzip_limits(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(packed(b'{"a":1}', b"not json"))
    assert a.inspect_gzip(path)["line_count"] == 2
    for limits, reason in (({"compressed_limit": 5}, "compressed_size"), ({"expanded_limit": 10}, "expanded_size"), ({"line_limit": 4}, "line_size")):
        with pytest.raises(a.SourceError, match=reason):
            a.inspect_gzip(path, **limits)
    whole = packed(b"x" * 100)
    for body, reason in ((b"", "compressed_size"), (whole[:-4], "not_gzip"), (whole[:-6] + b"zzzzzz", "not_gzip"), (gzip.compress(b""), "no_lines")):
        path.write_bytes(body)
        with pytest.raises(a.SourceError, match=reason):
            a.inspect_gzip(path)


def test_acquire_once_and_again(tmp_path):
    calls: list[str] = []
    first = a.acquire(tmp_path, "2024-01-01", 0, opener=opener(packed(b"{}"), calls=calls), reserve=0)
    assert a.acquire(tmp_path, "2024-01-01", 0, opener=opener(b"other", calls=calls)) == first and calls == ["HEAD", "GET"]
    assert a.validated_day(tmp_path, "2024-01-01", [0]) == [first]
    next((tmp_path / "objects").glob("*/source.json.gz")).write_bytes(packed(b"changed"))
    with pytest.raises(a.SourceError, match="object_changed"):
        a.acquire(tmp_path, "2024-01-01", 0)


@pytest.mark.parametrize(("more", "reason"), [({"length": 5}, "more_than"), ({"length": 5000}, "less_than"), ({"length": 0}, "announced"), ({"url": "https://x/"}, "redirected")])
def test_acquire_refuses(tmp_path, more, reason):
    with pytest.raises(a.SourceError, match=reason):
        a.acquire(tmp_path, "2024-01-01", 0, opener=opener(packed(b"{}"), **more), reserve=0)
    assert not list((tmp_path / "objects").glob("*")) and not list((tmp_path / "partial").glob("*"))
    assert a.acquire(tmp_path, "2024-01-01", 0, opener=opener(packed(b"{}")), reserve=0)["line_count"] == 1


def test_two_versions_are_an_error(tmp_path):
    for name in ("x", "y"):
        (tmp_path / "objects" / name).mkdir(parents=True)
        (tmp_path / "objects" / name / "manifest.json").write_text(json.dumps(manifest(1)))
    with pytest.raises(a.SourceError, match="ambiguous"):
        a.find_object(tmp_path, "2024-01-01", 1)


GOOD = {"id": "1", "type": "PushEvent", "actor": {"id": 5, "login": "u"}, "repo": {"id": 7, "name": "o/r"}, "public": True, "created_at": "2024-01-01T01:02:03Z", "payload": {"size": 1}}


def changed(**more) -> str:
    return json.dumps({k: v for k, v in (GOOD | more).items() if v is not ...})


REASONS = [
    ("{broken", "invalid_json_or_event_id"), ("[]", "invalid_json_or_event_id"), ('"s"', "invalid_json_or_event_id"), ("null", "invalid_json_or_event_id"), ("", "invalid_json_or_event_id"),
    (changed(id="x1"), "invalid_json_or_event_id"), (changed(id=123), None), (changed(type=...), "missing_event_type"), (changed(type=""), "missing_event_type"),
    (changed(repo={"id": "abc", "name": "o/r"}), "invalid_json_or_event_id"), (changed(actor={"id": "q"}), "invalid_json_or_event_id"), (changed(repo={"id": 0, "name": "o/r"}), "invalid_repository"), (changed(repo={"id": 7}), "invalid_repository"),
    (changed(repo={"id": 7, "name": "a"}), "invalid_repository"), (changed(repo={"id": 7, "name": "a/b/c"}), "invalid_repository"), (changed(repo=...), "invalid_repository"), (changed(created_at="nope"), "invalid_event_time"),
    (changed(created_at=...), "invalid_event_time"), (changed(public="true"), "invalid_json_or_event_id"), (changed(public=False), "not_public"), (changed(public=...), "not_public"), (changed(created_at="2024-01-01T02:00:00Z"), "source_hour_mismatch"),
    (changed(created_at="2024-01-01T03:30:00+02:00"), None), (changed(), None), (changed() + " trailing", None), (changed(type=..., repo=...), "missing_event_type"),
]


def test_first_reason_that_applies(spark):
    rows = [(i, text, "2024-01-01", 1, "f", "s") for i, (text, _) in enumerate(REASONS)]
    lines = spark.createDataFrame(rows, "line_number long, raw_json string, source_date string, source_hour int, source_file string, source_sha256 string")
    valid, quarantine = ingest(lines, "run")
    found = {r.line_number: r.reason for r in quarantine.collect()} | {r.line_number: None for r in valid.collect()}
    assert found == {i: reason for i, (_, reason) in enumerate(REASONS)}


def test_lines_of_gzip_files(spark, tmp_path):
    rows = []
    for hour, body in ((0, b"a\n\nb\r\nc\x01\rd\n"), (1, b"".join(b"%d\n" % i for i in range(5000)))):
        path = tmp_path / f"{hour}.json.gz"
        path.write_bytes(gzip.compress(body))
        rows.append((f"file://{path}", "2024-01-01", hour, "s"))
    lines = with_manifest(read_lines(spark, [r[0] for r in rows]), spark.createDataFrame(rows, MANIFEST))
    found = {(r.source_hour, r.line_number): r.raw_json for r in lines.collect()}
    assert [found[0, i] for i in range(1, 5)] == ["a", "", "b", "c\x01\rd"] and len(found) == 5004
    assert all(found[1, i + 1] == str(i) for i in range(5000))
    assert mixed_partitions(lines.repartition(1)).count() == 1
