"""An extra beside the batch engine: the same ingest over lines that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.ingest import classified

LINES = "line_number long, raw_json string, source_date string, source_hour int, source_file string, source_sha256 string"


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered lines from Parquet files that are put into a folder."""
    return spark.readStream.schema(LINES).parquet(folder)


def ingest_stream(lines: DataFrame, valid_path: str, quarantine_path: str, checkpoint: str, *, run_id: str = "") -> StreamingQuery:
    """Takes what is there and ends. A batch that is tried again writes the same folder again, so it counts once."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for path, keep in ((valid_path, "reason is null"), (quarantine_path, "reason is not null")):
            rows.where(keep).write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.unpersist()

    return classified(lines, run_id).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
