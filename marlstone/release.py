"""Control of runs and releases on files: plans, leases, budgets, stages and the pointer that publishes. Plain Python; nothing here touches data."""

from __future__ import annotations

import datetime as dt
import fcntl
import hashlib
import json
import os
import re
import shutil
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from marlstone.sources.acquire import is_hour, parsed_date

MOST_DATES = 7
_NAME = re.compile("[A-Za-z0-9_.-]+")


class ReleaseError(RuntimeError):
    """A run that must stop; nothing has been published."""


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def write_json(path: str | Path, value: object) -> None:
    """All or nothing: readers see the old document or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.parent / f".{path.name}.{uuid.uuid4().hex}"
    with part.open("x") as out:
        json.dump(value, out, indent=1, sort_keys=True, default=str)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)


def dates_between(start: str, end: str) -> list[str]:
    first, last = parsed_date(start), parsed_date(end)
    if not 0 <= (last - first).days < MOST_DATES:
        raise ValueError(f"a range has 1 to {MOST_DATES} dates in order")
    return [str(first + dt.timedelta(days=i)) for i in range((last - first).days + 1)]


def parsed_request(request: dict) -> list[tuple[str, int | None]]:
    """(date, hour or none) of each part: either start_date and end_date, or process_date and process_hour."""
    by_range, by_hour = {"start_date", "end_date"}, {"process_date", "process_hour"}
    keys = set(request)
    if keys == by_range:
        return [(d, None) for d in dates_between(request["start_date"], request["end_date"])]
    if keys == by_hour:
        parsed_date(request["process_date"])
        if not is_hour(request["process_hour"]):
            raise ValueError("process_hour is an integer from 0 to 23")
        return [(request["process_date"], request["process_hour"])]
    raise ValueError("give a range of dates, or one date and hour")


def code_digest(files: Iterable[str | Path], root: str | Path) -> str:
    """What the code is: names and contents of its files, in order."""
    digest = hashlib.sha256()
    for path in sorted(Path(f) for f in files):
        for part in (str(path.relative_to(root)).encode(), path.read_bytes()):
            digest.update(len(part).to_bytes(8, "big") + part)
    return digest.hexdigest()


def run_identity(code: str, inputs: Iterable[str]) -> str:
    return hashlib.sha256(json.dumps([code, sorted(inputs)]).encode()).hexdigest()


def inventory(path: str | Path) -> dict[str, dict]:
    """Size and checksum of each file below a folder."""
    found = {}
    for file in sorted(p for p in Path(path).rglob("*") if p.is_file()):
        with file.open("rb") as f:
            found[str(file.relative_to(path))] = {"bytes": file.stat().st_size, "sha256": hashlib.file_digest(f, "sha256").hexdigest()}
    return found


@contextmanager
def locked(path: str | Path) -> Iterator:
    """The file, open for appending and reading, while no other process has it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a+") as file:
        fcntl.flock(file, fcntl.LOCK_EX)
        file.seek(0)
        yield file


def reserve(ledger: str | Path, size: int, label: str, limit: int) -> int:
    """Appends a reservation of bytes and returns the sum, or raises and leaves the ledger as it is."""
    with locked(ledger) as file:
        used = size + sum(json.loads(line)["bytes"] for line in file if line.strip())
        if size < 0 or used > limit:
            raise ReleaseError(f"{label}: {used} of {limit} bytes would be used")
        file.write(json.dumps({"label": label, "bytes": size, "at": dt.datetime.now(dt.UTC).isoformat()}) + "\n")
        file.flush()
        os.fsync(file.fileno())
    return used


class Lease:
    """One owner at a time for a key. The owner may take it again; only the owner gives it back."""

    def __init__(self, root: str | Path, key: str):
        if not _NAME.fullmatch(key):
            raise ValueError("bad lease key")
        self.path = Path(root) / f"{key}.lease"

    def take(self, owner: str) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(f".{self.path.name}.{uuid.uuid4().hex}")
        part.write_text(owner)
        try:
            os.link(part, self.path)  # fails if it exists, so two can't both succeed
        except FileExistsError:
            if self.path.read_text() != owner:
                raise ReleaseError(f"{self.path.stem} is leased") from None
        finally:
            part.unlink()

    def give_back(self, owner: str) -> None:
        if self.path.exists():
            if self.path.read_text() != owner:
                raise ReleaseError(f"{self.path.stem} is leased by another")
            self.path.unlink()


class Watchdog:
    """Calls `stop` once if free space falls under a reserve while a stage runs."""

    def __init__(self, folder: str | Path, reserve_bytes: int, stop: Callable[[], None], every: float = 15.0, usage=shutil.disk_usage):
        self.tripped, self._done = False, threading.Event()

        def watch() -> None:
            while not self._done.is_set():
                if usage(folder).free < reserve_bytes:
                    self.tripped = True
                    stop()
                    return
                self._done.wait(every)

        self._thread = threading.Thread(target=watch, daemon=True)

    def __enter__(self) -> Watchdog:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()
        if self.tripped:
            raise ReleaseError("no storage headroom")


class Run:
    """A run's context and its stages' reports; a stage that is VALIDATED isn't run again."""

    def __init__(self, root: str | Path, run_id: str):
        if not _NAME.fullmatch(run_id):
            raise ValueError("bad run id")
        self.root, self.run_id = Path(root), run_id
        self.folder = self.root / "runs" / run_id

    def prepare(self, date: str) -> dict:
        """The date's context, the same however often it is asked for."""
        parsed_date(date)
        path = self.folder / f"{date}.json"
        if not path.exists():
            write_json(path, {"run_id": self.run_id, "date": date, "release": f"{date}-{self.run_id}", "staging": str(self.root / "staging" / f"{date}-{self.run_id}")})
        return read_json(path)

    def stage(self, date: str, name: str, work: Callable[[], dict], *, reserve_bytes: int = 0, usage=shutil.disk_usage) -> dict:
        """The report of work(), kept with its status; FAILED ones are tried again."""
        path = self.folder / f"{date}-{name}.report.json"
        if path.exists() and (done := read_json(path))["status"] == "VALIDATED":
            return done
        if usage(self.root if self.root.exists() else "/").free < reserve_bytes:
            raise ReleaseError("no storage headroom")
        report = {"stage": name, "started_at": dt.datetime.now(dt.UTC).isoformat()}
        try:
            report |= {"result": work(), "status": "VALIDATED"}
        except Exception as error:
            report |= {"status": "FAILED", "error": str(error)}
            raise
        finally:
            report["ended_at"] = dt.datetime.now(dt.UTC).isoformat()
            write_json(path, report)
        return report

    def fail_once(self, name: str) -> None:
        """Raises the first time only, to try recovery."""
        mark = self.folder / f"{name}.injected"
        self.folder.mkdir(parents=True, exist_ok=True)
        try:
            mark.touch(exist_ok=False)
        except FileExistsError:
            return
        raise ReleaseError(f"injected: {name}")


class Publisher:
    """Releases below root: a staged folder becomes an immutable one, then the pointer of its name is replaced; that is the only commit."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def pointer_path(self, name: str) -> Path:
        if not _NAME.fullmatch(name):
            raise ValueError("bad publication name")
        return self.root / "published" / f"{name}.json"

    def current(self, name: str) -> dict | None:
        path = self.pointer_path(name)
        return read_json(path) if path.exists() else None

    def is_noop(self, name: str, identity: str) -> bool:
        """Whether this very input and code is published and all its files are as they were."""
        now = self.current(name)
        return bool(now) and now["identity"] == identity and inventory(now["path"]) == now["inventory"]

    def publish(self, name: str, staged: str | Path, *, release: str, identity: str, facts: dict, recheck: Callable[[], str]) -> dict:
        """Moves a staged release to its place and points at it. recheck() gives the identity again at the last moment; if inputs or code changed, nothing is published."""
        if not _NAME.fullmatch(release):
            raise ValueError("bad release name")
        if recheck() != identity:
            raise ReleaseError("inputs changed during the run")
        home = self.root / "releases" / release
        if home.exists():
            raise ReleaseError("this release exists")
        files = inventory(staged)
        if not files:
            raise ReleaseError("nothing to publish")
        home.parent.mkdir(parents=True, exist_ok=True)
        os.rename(staged, home)
        for file in files:
            (home / file).chmod(0o444)
        pointer = {**facts, "release": release, "identity": identity, "path": str(home), "inventory": files}
        write_json(self.pointer_path(name), pointer)
        return pointer

    def published(self, name: str) -> dict:
        """The pointer of a complete publication whose folder is below this root."""
        now = self.current(name)
        if now is None or now.get("coverage") != "COMPLETE":
            raise ReleaseError(f"{name} has no complete publication")
        if not Path(now["path"]).resolve().is_relative_to(self.root.resolve()):
            raise ReleaseError("the pointer leaves its root")
        return now


def complete_week(publisher: Publisher, start: str, end: str) -> list[dict]:
    """Pointers of exactly seven complete dates, files unchanged; what a model over a week is made from."""
    dates = dates_between(start, end)
    if len(dates) != MOST_DATES:
        raise ReleaseError("a model needs seven dates")
    found = [publisher.published(d) for d in dates]
    for pointer in found:
        if inventory(pointer["path"]) != pointer["inventory"]:
            raise ReleaseError(f"{pointer['release']} changed after publication")
    return found


# How secrets begin, in text that must not hold any.
SECRETS = re.compile("|".join(("-----BEGIN [A-Z ]*PRIVATE KEY-----", "gh[pousr]_[A-Za-z0-9]{30,}", "AKIA[0-9A-Z]{16}", "xox[abprs]-[A-Za-z0-9-]{10,}")))


def unsafe_files(root: str | Path, files: Iterable[str], *, most_bytes: int = 5 << 20) -> list[tuple[str, str]]:
    """(file, why) of candidates for publication that are links, lie outside, are too large or hold a secret."""
    root, found = Path(root).resolve(), []
    for name in files:
        path = root / name
        if path.is_symlink():
            found.append((name, "link"))
        elif not path.resolve().is_relative_to(root):
            found.append((name, "outside"))
        elif path.stat().st_size > most_bytes:
            found.append((name, "size"))
        elif SECRETS.search(path.read_text(errors="replace")):
            found.append((name, "secret"))
    return found


