"""Raw lines to typed rows, or to quarantine with the first reason that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fields import hour_key

#: What of a line's object is read; the rest, payloads too, stays text.
BODY = "id string, type string, actor struct<id: bigint, login: string>, repo struct<id: bigint, name: string>, public boolean, created_at string, _corrupt_record string"
LINEAGE = ("line_number", "raw_json", "source_date", "source_hour", "source_file", "source_sha256")
#: Columns of typed rows, by where the body has them.
FIELDS = {"event_id": "id", "event_type": "type", "repo_id": "repo.id", "repo_name": "repo.name", "actor_id": "actor.id", "actor_login": "actor.login", "public": "public"}


def scope_key() -> Column:
    """The hour that a line's file stands for, as hour_key writes an event's."""
    return F.format_string("%s-%02d", "source_date", "source_hour")


def rejection(body: str = "body") -> Column:
    """Why a line's body is rejected, null if it isn't. Each rule says what an accepted body has; the first that it lacks counts, also where a value is missing."""
    at = lambda field: F.col(f"{body}.{field}")
    time = F.try_to_timestamp(at("created_at"))
    needs = {
        "invalid_json_or_event_id": at("_corrupt_record").isNull() & at("id").rlike("^[0-9]+$"),
        "missing_event_type": at("type") != "",
        "invalid_repository": (at("repo.id") > 0) & at("repo.name").rlike("^[^/]+/[^/]+$"),
        "invalid_event_time": time.isNotNull(),
        "not_public": at("public"),
        "source_hour_mismatch": hour_key(time) == scope_key(),
    }
    return F.coalesce(*(F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in needs.items()))


def classified(lines: DataFrame, run_id: str) -> DataFrame:
    """All lines with their fields and the reason for which they are rejected, null for valid ones. A line that isn't an object has no fields."""
    read = lines.select(*LINEAGE, F.from_json("raw_json", BODY, {"mode": "PERMISSIVE"}).alias("body")).withColumn("reason", rejection())
    typed = read.withColumns({name: F.col(f"body.{place}") for name, place in FIELDS.items()})
    more = {"event_time": F.try_to_timestamp("body.created_at"), "payload_json": F.get_json_object("raw_json", "$.payload"), "run_id": F.lit(run_id), "ingested_at": F.current_timestamp()}
    return typed.withColumns(more).select(*LINEAGE, *FIELDS, "event_time", "payload_json", "reason", "run_id", "ingested_at")


def ingest(lines: DataFrame, run_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine). Both read the lines; persist `classified` once if both are written."""
    rows = classified(lines, run_id)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def mixed_partitions(lines: DataFrame) -> DataFrame:
    """(input_partition, hours) of input partitions with lines of more than one hour; a reader of whole files has none."""
    held = lines.select(F.spark_partition_id().alias("input_partition"), scope_key().alias("scope")).distinct()
    return held.groupBy("input_partition").agg(F.count("*").alias("hours")).where("hours > 1")
