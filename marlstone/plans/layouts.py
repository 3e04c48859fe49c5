"""Layouts of a day, and joins by a chosen strategy, for measuring one against the other."""

from __future__ import annotations

import hashlib
import json
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.reconcile import multiset_diff
from marlstone.plans.catalog import ROW_GROUP, explained
from marlstone.plans.metrics import measured

#: Two variants, a and b, after one warm-up of each.
ORDER = "abbaab"
JOIN_NODES = {"merge": "SortMergeJoin", "broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin"}
# Dimension rows, and bytes of them as JSON, that may be sent to every executor.
SMALL_ROWS, SMALL_BYTES = 50_000, 8 << 20


def write_layout(day: DataFrame, path: str, *, hourly: bool, files: int = 4, hour: str = "source_hour") -> DataFrame:
    """A day's rows by hour, one folder each, or in a few files; written once and read back."""
    frame = day.repartition(24, hour) if hourly else day.repartition(files)
    writer = frame.write.mode("errorifexists").option("compression", "snappy").option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(hour) if hourly else writer).parquet(path)
    return day.sparkSession.read.parquet(path).select(*day.columns)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return multiset_diff(a, b).isEmpty()


def is_small(dimension: DataFrame) -> bool:
    """Whether a dimension may be broadcast, by one row of sums over at most one row beyond the limit. Ask it of a written table: the plan runs once for it."""
    rows, size = dimension.limit(SMALL_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return 0 < rows <= SMALL_ROWS and size <= SMALL_BYTES


def joined(facts: DataFrame, dimension: DataFrame, strategy: str, key: str = "repo_sk") -> DataFrame:
    """Owners' events by a join that is planned as merge, broadcast or shuffle_hash. Only small dimensions may be broadcast; for others that is an error, as another join would run under its name."""
    if strategy == "broadcast" and not is_small(dimension):
        raise ValueError("the dimension is too large to be broadcast")
    d = dimension.select(key, "owner_name").hint(strategy)
    return facts.join(d, key).groupBy("owner_name").agg(F.count("*").alias("events"), F.sum(F.col("repo_id").cast("decimal(38,0)")).alias("repo_sum"))


def digest(rows: list) -> str:
    """Of rows in any order."""
    lines = sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def measure(make: Callable[[], DataFrame]) -> dict:
    df, start = make(), time.perf_counter()
    with measured(df.sparkSession) as cost:
        rows = df.collect()
        seconds = time.perf_counter() - start
    return {"seconds": seconds, "cost": cost, "rows": len(rows), "sha256": digest(rows), "plan": explained(df)}


def compare(a: Callable[[], DataFrame], b: Callable[[], DataFrame], *, equal: bool = True, nodes: tuple[str, str] | None = None) -> dict:
    """Median seconds of two queries, tried in turns after a warm-up. Each must repeat its result; both results agree if equal, and plans hold their nodes, or it is an error."""
    trials: dict[str, list[dict]] = {"a": [measure(a)], "b": [measure(b)]}
    for which in ORDER:
        trials[which].append(measure(a if which == "a" else b))
    for which, node in zip("ab", nodes or (), strict=False):
        if node not in trials[which][0]["plan"]:
            raise ValueError(f"{node} is not in the plan of {which}")
    digests = {w: {t["sha256"] for t in ts} for w, ts in trials.items()}
    if any(len(d) > 1 for d in digests.values()) or equal and digests["a"] != digests["b"]:
        raise ValueError("results differ")
    return {w: statistics.median(t["seconds"] for t in ts[1:]) for w, ts in trials.items()}
