"""Per-recording files: what writing and reading them costs, and that all of them come back."""

import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spoorline.plans import catalogue, recording_queries
from spoorline.sources import tables

SF = "/root/testdata/sf0.001"


def points(spark, recordings, frames):
    rows = spark.range(recordings * frames).select((F.col("id") % recordings).alias("video_id"), (F.col("id") / recordings).cast("int").alias("video_frame"))
    odd = F.element_at(F.array(*map(F.lit, ("lab, 0", "lab %20b", "MABe22_a"))), (F.col("video_id") % 3 + 1).cast("int"))
    return rows.select(odd.alias("lab_id"), "*", F.lit(1).alias("mouse_id"), F.when(F.col("video_frame") % 2 == 0, "nose").alias("bodypart"), (F.col("video_frame") / 3).alias("x"), F.when(F.col("video_frame") % 5 > 0, 1.5).alias("y"))


def most_tasks(spark, job):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds]
    return out, max(s.numTasks for s in stages if s)


def test_a_task_writes_and_lists_many_recordings(spark):
    rows = points(spark, 120, 30)
    root = recording_queries.per_recording(rows, tables.TRACKING)
    at = Path(root.removeprefix("file:"))
    # A file a recording and nothing else: no checksums, whose permissions Hadoop sets by a process each, and nothing staged.
    assert sorted(str(p.relative_to(at)) for p in at.rglob("*") if p.is_file()) == sorted(f"{('lab, 0', 'lab %20b', 'MABe22_a')[v % 3]}/{v}.parquet" for v in range(120))
    assert not (at.parent / "dealt").exists()
    wanted = rows.select("lab_id", "video_id").where("video_id <> 7").union(spark.createDataFrame([("lab, 0", 10**6), ("gone", 1), (None, 3)], "lab_id string, video_id long"))
    known = spark.conf.get(tables._LISTING)
    got, tasks = most_tasks(spark, lambda: tables.read_tracking(spark, root, wanted))
    assert tasks <= 4 * spark.sparkContext.defaultParallelism < 119 and spark.conf.get(tables._LISTING) == known
    assert len(got.inputFiles()) == 119
    want = rows.where("video_id <> 7").select(*got.columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_keys_are_cut_from_paths_without_a_pattern(spark):
    root = recording_queries.per_recording(points(spark, 3, 2), tables.TRACKING)
    assert "regexp" not in tables.read_tracking(spark, root)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("batch", [7, 10_000])
def test_recordings_longer_than_a_batch_are_whole(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, batch)
    try:
        rows = points(spark, 5, 101)
        got = tables.read_tracking(spark, recording_queries.per_recording(rows, tables.TRACKING))
    finally:
        spark.conf.unset(name)
    want = rows.select(*got.columns)
    assert got.count() == 505 and want.exceptAll(got).isEmpty()


def test_no_rows_no_files(spark):
    root = recording_queries.per_recording(points(spark, 3, 2).where("video_id > 9"), tables.TRACKING)
    assert tables.read_tracking(spark, root).isEmpty() and tables.read_tracking(spark, root, points(spark, 3, 2)).isEmpty()


@pytest.mark.parametrize("name", ["tracking_scan", "annotation_scan"])
def test_scans_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("events", "customer"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got
