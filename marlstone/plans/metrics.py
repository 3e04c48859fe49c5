"""What a query cost: sums over the tasks of its stages, from the running application or from an event log."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name here, method of the status store, field of a task's metrics in event logs.
COUNTED = (
    ("input_rows", "inputRecords", "Input Metrics.Records Read"),
    ("input_bytes", "inputBytes", "Input Metrics.Bytes Read"),
    ("output_bytes", "outputBytes", "Output Metrics.Bytes Written"),
    ("shuffle_write_bytes", "shuffleWriteBytes", "Shuffle Write Metrics.Shuffle Bytes Written"),
    ("disk_spill_bytes", "diskBytesSpilled", "Disk Bytes Spilled"),
    ("memory_spill_bytes", "memoryBytesSpilled", "Memory Bytes Spilled"),
    ("cpu_ns", "executorCpuTime", "Executor CPU Time"),
)
EVENT = """Event string, `Stage IDs` array<int>, `Stage ID` int, Properties struct<`spark.jobGroup.id`: string, `spark.sql.execution.id`: string>,
 `Task Metrics` struct<`Executor CPU Time`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>,
 `Output Metrics`: struct<`Bytes Written`: bigint>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>"""


@contextmanager
def job_group(spark: SparkSession, group: str) -> Iterator[str]:
    """Jobs that this thread starts meanwhile are known, and can be cancelled, by the group's name."""
    context, keys = spark.sparkContext, ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [context.getLocalProperty(k) for k in keys]
    context.setJobGroup(group, group, True)
    try:
        yield group
    finally:
        for k, v in zip(keys, before, strict=True):
            context.setLocalProperty(k, v)


def of_group(spark: SparkSession, group: str) -> dict[str, int]:
    """Sums over the stages that a group's jobs ran; those that were skipped or that the application has forgotten count nothing, `stages` says how many counted."""
    scala = spark.sparkContext._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    tracker, store = spark.sparkContext.statusTracker(), scala.statusStore()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    sums = dict.fromkeys(("stages", "tasks", *(name for name, _, _ in COUNTED)), 0)
    for stage in {s for job in jobs if job for s in job.stageIds}:
        try:
            about = store.lastStageAttempt(stage)
        except Py4JJavaError:  # no longer kept
            continue
        if about.status().toString() != "COMPLETE":
            continue
        sums["stages"] += 1
        sums["tasks"] += about.numCompleteTasks()
        for name, method, _ in COUNTED:
            sums[name] += getattr(about, method)()
    return sums


@contextmanager
def measured(spark: SparkSession) -> Iterator[dict[str, int]]:
    """A dict that has the sums when the block has ended."""
    found: dict[str, int] = {}
    with job_group(spark, f"measured-{uuid.uuid4().hex}") as group:
        yield found
    found |= of_group(spark, group)


def of_event_log(spark: SparkSession, path: str) -> DataFrame:
    """(job_group, execution_id, stages, tasks and the sums) of an application's uncompressed event log, which may be a folder of rolled files.

    A stage belongs to the first job that lists it, so later jobs that reuse its output don't count it again. Lines that aren't JSON give no event.
    """
    events = spark.read.text(path).select(F.from_json("value", EVENT).alias("e")).select("e.*")
    jobs = events.where("Event = 'SparkListenerJobStart'").select(F.explode("Stage IDs").alias("stage"), F.col("Properties").getField("spark.jobGroup.id").alias("job_group"), F.col("Properties").getField("spark.sql.execution.id").cast("bigint").alias("execution_id"))
    owners = jobs.groupBy("stage").agg(F.min_by(F.struct("job_group", "execution_id"), F.coalesce("execution_id", F.lit(-1))).alias("o"))

    def field(path: str):
        column = F.col("Task Metrics")
        for name in path.split("."):
            column = column.getField(name)
        return column

    tasks = events.where("Event = 'SparkListenerTaskEnd'").groupBy(F.col("Stage ID").alias("stage")).agg(F.count("*").alias("tasks"), *(F.sum(F.coalesce(field(path), F.lit(0))).alias(name) for name, _, path in COUNTED))
    sums = [F.count("*").alias("stages"), *(F.sum(name).alias(name) for name in ("tasks", *(n for n, _, _ in COUNTED)))]
    return tasks.join(owners, "stage").groupBy("o.job_group", "o.execution_id").agg(*sums)
