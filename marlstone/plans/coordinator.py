"""From a request to publications: hours are fetched within a budget, kept for good, built, published and named in a catalog."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from marlstone.plans import stores
from marlstone.plans.catalog import check_table, register, relocate
from marlstone.plans.runs import run_day, verify_model
from marlstone.release import Publisher, ReleaseError, inventory, parsed_request, read_json, reserve
from marlstone.sources import acquire as source
from marlstone.sources.acquire import DAY


def table_name(database: str, pointer: dict, table: str) -> str:
    return f"{database}.{table}_{pointer['date'].replace('-', '_')}"


def name_tables(spark: SparkSession, database: str, pointer: dict) -> None:
    """Tables of a published day in a catalog: new ones are registered, others pointed at this release."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table, about in pointer["tables"].items():
        name, path = table_name(database, pointer, table), f"file:{pointer['path']}/{table}"
        if spark.catalog.tableExists(name):
            relocate(spark, name, path)
        else:
            register(spark, name, path, about["schema"], about["partitions"])


def check_names(spark: SparkSession, database: str, pointer: dict) -> None:
    """Raises unless the catalog has all tables of a published day, at its release, with its columns."""
    for table, about in pointer["tables"].items():
        name = table_name(database, pointer, table)
        if not spark.catalog.tableExists(name):
            raise ReleaseError(f"{name} isn't in the catalog")
        check_table(spark, name, f"file:{pointer['path']}/{table}", about["schema"])


def run_request(
    spark: SparkSession, root: str | Path, request: dict, *, run_id: str, budget: int, database: str | None = None, opener: Callable | None = None, download_reserve: int = 1 << 30, **control
) -> list[dict]:
    """Publications of a request: a range of dates, or one date and hour. control goes to run_day (reserve_bytes, fail_after, force).

    Bytes to download are entered in a ledger before they move and may not pass the budget, over all runs below root. Each hour's object goes to raw/ once, read-only. With a database the published tables are named in the catalog;
    where nothing is left to do, they are checked to be there, and named anew if they aren't.
    """
    root, published = Path(root), []
    for date, hour in parsed_request(request):
        hours = list(DAY) if hour is None else [hour]
        for h in hours:
            label = f"{run_id} {date} {h}"
            more = {"opener": opener} if opener else {}
            source.acquire(root, date, h, run_id=run_id, reserve=download_reserve, allow=lambda size, label=label: reserve(root / "ledger.jsonl", size, label, budget), **more)
        manifests = []
        for m in source.validated_day(root, date, hours):
            local = root / "objects" / source.input_identity(m) / "source.json.gz"
            home = root / "raw" / date / f"{m['source_hour']:02}" / f"{m['sha256']}.json.gz"
            stores.publish_raw(spark, local, f"file:{home.resolve()}", m["sha256"])
            manifests.append(m | {"path": str(home)})
        pointer = run_day(spark, root, date, manifests, run_id=run_id, hours=hours, **control)
        if database:
            try:
                check_names(spark, database, pointer)
            except (ReleaseError, ValueError):
                name_tables(spark, database, pointer)
                check_names(spark, database, pointer)
        published.append(pointer)
    return published


def verify(root: str | Path, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """What is wrong with each publication below root, by its name: files that changed or are missing, and reports of stages that didn't pass. With a session, models are checked against their days too."""
    publisher, found = Publisher(root), {}
    for path in sorted(Path(root, "published").glob("*.json")):
        name, pointer, wrong = path.stem, read_json(path), []
        now, then = inventory(pointer["path"]), pointer["inventory"]
        wrong += [f"file {f}" for f in sorted(set(now) | set(then)) if now.get(f) != then.get(f)]
        key, run_id = (pointer["date"], pointer["release"].removeprefix(f"{pointer['date']}-")) if "date" in pointer else (pointer["start"], pointer["release"].removeprefix(f"{name}-"))
        reports = sorted(Path(root, "runs", run_id).glob(f"{key}-*.report.json"))
        if not reports:
            wrong.append("no reports")
        for report in map(read_json, reports):
            gates = report.get("result", {}).get("gates", [])
            if report["status"] != "VALIDATED" or not all(g["passed"] for g in gates):
                wrong.append(f"stage {report['stage']}")
        if spark and "start" in pointer and not wrong:
            try:
                verify_model(spark, publisher.root, pointer["start"], pointer["end"])
            except (ReleaseError, ValueError) as error:
                wrong.append(str(error))
        found[name] = wrong
    return found


def main(arguments: list[str]) -> int:
    """python -m marlstone.plans.coordinator ROOT [full]: verifies all publications below a root; full starts Spark for the models."""
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate() if "full" in arguments[1:] else None
    found = verify(arguments[0], spark)
    for name, wrong in found.items():
        print(name, "; ".join(wrong) or "ok")
    return int(not found or any(found.values()))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
