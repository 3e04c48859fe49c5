import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dedup, rollups, scd2
from marlstone.plans import adapter, catalog, layouts
from marlstone.plans.queries import ORACLE_SQL, QUERIES
from marlstone.sources.tables import read_table, union_tables
from marlstone.streaming.lines import LINES, ingest_stream, stream_lines

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{FOLDER}/{name}'")
    return connection


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    df, result = QUERIES[name](spark, FOLDER), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(map(str, result.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == expected and expected


@needs_tables
def test_queries_without_sql(spark):
    names = sorted(set(QUERIES) - set(ORACLE_SQL))
    assert names == ["hash_sample", "partition_homogeneity"]
    versions = QUERIES["scd2_dimension"](spark, FOLDER).count()
    assert 0 < QUERIES["hash_sample"](spark, FOLDER).count() < versions
    assert QUERIES["partition_homogeneity"](spark, FOLDER).count() == 1


def plan(df) -> str:
    return catalog.explained(df)


@needs_tables
def test_plans(spark):
    events = adapter.events(spark, FOLDER)
    daily = plan(rollups.type_totals(events))
    assert "ReadSchema: struct<event_id" not in daily and "value" not in daily.split("ReadSchema:")[1].split("\n")[0]
    assert "SortAggregate" not in plan(dedup.deduplicate(adapter.with_copies(events)).unique)
    assert plan(scd2.scd2(scd2.observations(events))).count("Window") > 0
    for strategy, node in layouts.JOIN_NODES.items():
        df = layouts.joined(scd2.as_of(events, scd2.scd2(scd2.observations(events))), scd2.scd2(scd2.observations(events)), strategy)
        assert node in plan(df)


@needs_tables
def test_layouts_agree(spark, tmp_path):
    day = adapter.events(spark, FOLDER).where("event_date = DATE '2024-01-01'").select("event_id", "event_type", "repo_id", "actor_id", "source_hour")
    hourly, compact = (layouts.write_layout(day, str(tmp_path / n), hourly=n == "hourly") for n in ("hourly", "compact"))
    assert layouts.same_rows(hourly, compact) and layouts.same_rows(hourly, day) and not layouts.same_rows(hourly.limit(3), day)
    seconds = layouts.compare(lambda: rollups.type_totals(hourly), lambda: rollups.type_totals(compact))
    assert set(seconds) == {"a", "b"}
    with pytest.raises(ValueError, match="differ"):
        layouts.compare(lambda: hourly.limit(1), lambda: compact.groupBy("source_hour").count())
    with pytest.raises(ValueError, match="not in the plan"):
        layouts.compare(lambda: spark.range(1).toDF("x"), lambda: spark.range(1).toDF("x"), nodes=("SortMergeJoin", "Range"))
    assert "PartitionFilters: [isnotnull(source_hour" in plan(hourly.where("source_hour = 12"))
    assert not layouts.is_small(spark.range(0)) and layouts.is_small(spark.range(10)) and not layouts.is_small(spark.range(layouts.SMALL_ROWS + 1))


def test_tables_are_written_once_and_named(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, event_date string")
    path = f"file:{tmp_path}/t"
    written = catalog.write_table(rows, path, partition_by=catalog.partition_columns("dwd_event", rows), row_group=catalog.ROW_GROUP)
    assert written["rows"] == 2 and written["partitions"] == ["event_date"] and "Physical Plan" in written["plan"]
    with pytest.raises(Exception, match="already exists"):
        catalog.write_table(rows, path)
    spark.sql("DROP TABLE IF EXISTS t_one")
    catalog.register(spark, "t_one", path, written["schema"], written["partitions"])
    catalog.check_table(spark, "t_one", path, written["schema"])
    os.rename(f"{tmp_path}/t", f"{tmp_path}/moved")
    catalog.relocate(spark, "t_one", f"file:{tmp_path}/moved")
    catalog.check_table(spark, "t_one", f"file:{tmp_path}/moved", written["schema"])
    assert spark.table("t_one").count() == 2
    for bad in ((path, written["schema"]), (f"file:{tmp_path}/moved", rows.select("x").schema.jsonValue())):
        with pytest.raises(ValueError):
            catalog.check_table(spark, "t_one", *bad)
    spark.sql("DROP TABLE t_one")
    assert catalog.partition_columns("quarantine", rows) == ["source_date", "source_hour"] and catalog.partition_columns("dim_x", rows) == []


def test_unions_match_by_name(spark):
    assert [tuple(r) for r in union_tables([spark.sql("SELECT 1 a, 2 b"), spark.sql("SELECT 4 b, 3 a")]).orderBy("a").collect()] == [(1, 2), (3, 4)]


@needs_tables
def test_times_are_zoned(spark):
    assert dict(read_table(spark, FOLDER, "events").dtypes)["ts"] == "timestamp"


@needs_tables
def test_stream_equals_batch(spark, tmp_path):
    lines = adapter.raw_lines(spark, FOLDER).select(*(c.split()[0] for c in LINES.split(", ")))
    lines.withColumn("source_hour", F.col("source_hour").cast("int")).repartition(3).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("valid", "quarantine", "checkpoint")]
    for _ in range(2):  # a second run finds nothing new
        ingest_stream(stream_lines(spark, str(tmp_path / "in")), *paths).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == QUERIES["ingest_valid"](spark, FOLDER).count()
    assert spark.read.parquet(paths[1]).groupBy("reason").count().count() == 6


@needs_tables
def test_bench_prints_one_line():
    env = os.environ | {"BENCH_SF_DIR": FOLDER, "BENCH_CPUS": "2", "PYTHONPATH": os.getcwd()}
    code = "import bench; bench.HEADLINE = ('type_totals_all',); import __spark_entry__ as e; q = e.queries()['type_totals_all']; e.queries = lambda: {'type_totals_all': q}; bench.main()"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300, check=True).stdout
    assert json.loads(out.strip().splitlines()[-1])["unit"] == "sec"
