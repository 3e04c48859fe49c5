"""Hourly source files: addresses, bounded download and validation, coverage; plain Python with an opener that tests replace."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
import os
import re
import shutil
import urllib.request
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

#: Where hourly files are; {date} and {hour} (not padded) are filled in.
ARCHIVE_URL = "https://data.gharchive.org/{date}-{hour}.json.gz"
IDENTITY = ("source_url", "source_date", "source_hour", "sha256")
DAY = range(24)


class SourceError(ValueError):
    """A file or manifest that must not be used; its text is a short reason."""


def is_hour(hour: object) -> bool:
    return type(hour) is int and hour in DAY


def parsed_date(date: object) -> dt.date:
    if not isinstance(date, str) or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", date):
        raise ValueError("a date is YYYY-MM-DD")
    return dt.date.fromisoformat(date)


def source_url(date: str, hour: int) -> str:
    parsed_date(date)
    if not is_hour(hour):
        raise ValueError("an hour is an integer from 0 to 23")
    return ARCHIVE_URL.format(date=date, hour=hour)


def input_identity(manifest: dict) -> str:
    """What a file is, whenever it was fetched: the digest of its address, date, hour and checksum."""
    return hashlib.sha256(json.dumps([manifest[k] for k in IDENTITY], separators=(",", ":")).encode()).hexdigest()


def require_hours(manifests: Iterable[dict], date: str, hours: Iterable[int] = DAY) -> str:
    """COMPLETE for exactly one good manifest of each of a day's hours, PARTIAL for exactly those of fewer hours; else an error."""
    wanted, seen = set(hours), set()
    if not wanted or not all(map(is_hour, wanted)):
        raise ValueError("bad hours")
    for m in manifests:
        hour = m["source_hour"]
        if m["source_date"] != date or not is_hour(hour) or m["source_url"] != source_url(date, hour):
            raise SourceError("source_mismatch")
        if not re.fullmatch("[0-9a-f]{64}", m["sha256"]):
            raise SourceError("bad_checksum")
        if hour in seen:
            raise SourceError("repeated_hour")
        seen.add(hour)
    if seen != wanted:
        raise SourceError(f"hours_differ: missing {sorted(wanted - seen)}, unexpected {sorted(seen - wanted)}")
    return "COMPLETE" if wanted == set(DAY) else "PARTIAL"


def inspect_gzip(path: str | Path, *, compressed_limit: int = 256 << 20, expanded_limit: int = 4 << 30, line_limit: int = 8 << 20) -> dict:
    """Sizes, lines and checksum of a whole gzip file within its limits; lines need not be JSON."""
    path = Path(path)
    compressed = path.stat().st_size
    if not 0 < compressed <= compressed_limit:
        raise SourceError("compressed_size")
    with path.open("rb") as f:
        checksum = hashlib.file_digest(f, "sha256").hexdigest()
    expanded = count = 0
    try:
        with gzip.open(path) as f:
            while line := f.readline(line_limit + 1):
                count, expanded = count + 1, expanded + len(line)
                if len(line) > line_limit:
                    raise SourceError("line_size")
                if expanded > expanded_limit:
                    raise SourceError("expanded_size")
    except (OSError, EOFError) as broken:
        raise SourceError("not_gzip") from broken
    if not count:
        raise SourceError("no_lines")
    return {"compressed_bytes": compressed, "uncompressed_bytes": expanded, "line_count": count, "sha256": checksum}


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def _open(request: urllib.request.Request):
    return urllib.request.build_opener(_NoRedirect).open(request, timeout=60)


def find_object(root: str | Path, date: str, hour: int) -> tuple[Path, dict] | None:
    """The one accepted version of an hour; several are an error that someone must resolve."""
    source_url(date, hour)
    found = [(p, m) for p in sorted(Path(root, "objects").glob("*/manifest.json")) if ((m := json.loads(p.read_text()))["source_date"], m["source_hour"]) == (date, hour)]
    if len(found) > 1:
        raise SourceError("ambiguous_versions")
    return found[0] if found else None


def check_object(path: Path, manifest: dict, **limits) -> None:
    """Raises unless the object beside a manifest still is what it says, under its own identity."""
    stats = inspect_gzip(path.parent / "source.json.gz", **limits)
    if any(manifest[k] != v for k, v in stats.items()) or input_identity(manifest) != path.parent.name:
        raise SourceError("object_changed")


def acquire(root: str | Path, date: str, hour: int, *, compressed_limit: int = 256 << 20, expanded_limit: int = 4 << 30, reserve: int = 1 << 30, run_id: str = "", opener: Callable = _open, allow: Callable[[int], object] | None = None) -> dict:
    """Fetches an hour once into objects/<identity>/ and returns its manifest; a good copy that is there is used as it is.

    The announced size is within the limit and is what arrives; redirects are refused; room is left on the disk; the object appears by a rename when it is complete and checked.
    allow() is told the bytes before they are asked for, and may raise.
    """
    url, root = source_url(date, hour), Path(root)
    if existing := find_object(root, date, hour):
        check_object(*existing, compressed_limit=compressed_limit, expanded_limit=expanded_limit)
        return existing[1]
    with opener(urllib.request.Request(url, method="HEAD")) as reply:
        if reply.geturl() != url:
            raise SourceError("redirected")
        announced = int(reply.headers.get("Content-Length") or -1)
    if not 0 < announced <= compressed_limit:
        raise SourceError("announced_size")
    root.mkdir(parents=True, exist_ok=True)
    if shutil.disk_usage(root).free < announced + reserve:
        raise SourceError("no_room")
    if allow:
        allow(announced)
    part = root / "partial" / uuid.uuid4().hex
    part.mkdir(parents=True)
    try:
        arrived = 0
        with opener(urllib.request.Request(url)) as reply, (part / "source.json.gz").open("xb") as out:
            if reply.geturl() != url:
                raise SourceError("redirected")
            while block := reply.read(1 << 20):
                arrived += len(block)
                if arrived > announced:
                    raise SourceError("more_than_announced")
                out.write(block)
            out.flush()
            os.fsync(out.fileno())
        if arrived != announced:
            raise SourceError("less_than_announced")
        manifest = {"source_url": url, "source_date": date, "source_hour": hour, **inspect_gzip(part / "source.json.gz", compressed_limit=compressed_limit, expanded_limit=expanded_limit)}
        manifest |= {"acquired_at": dt.datetime.now(dt.UTC).isoformat(), "run_id": run_id, "schema_version": 1, "input_identity": input_identity(manifest)}
        (part / "manifest.json").write_text(json.dumps(manifest, indent=1))
        home = root / "objects" / manifest["input_identity"]
        home.parent.mkdir(exist_ok=True)
        os.replace(part, home)
        return manifest
    finally:
        shutil.rmtree(part, ignore_errors=True)


def validated_day(root: str | Path, date: str, hours: Iterable[int] = DAY) -> list[dict]:
    """Manifests of a day's hours, in order, each object checked again."""
    found = [x for h in sorted(hours) if (x := find_object(root, date, h))]
    require_hours([m for _, m in found], date, hours)
    for path, manifest in found:
        check_object(path, manifest)
    return [m for _, m in found]
