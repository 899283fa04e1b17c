"""Input tables with explicit schemas, and the sinks of results."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

METADATA = """lab_id string, video_id long, behaviors_labeled string, body_parts_tracked string, frames_per_second double,
    pix_per_cm_approx double, video_width double, video_height double, arena_width_cm double, arena_height_cm double,
    arena_shape string, arena_type string, tracking_method string,
    mouse1_strain string, mouse2_strain string, mouse3_strain string, mouse4_strain string"""
TRACKING = "video_frame int, mouse_id int, bodypart string, x double, y double"
ANNOTATION = "agent_id int, target_id int, action string, start_frame int, stop_frame int"
INTERVALS = "video_id long, agent_id string, target_id string, action string, start_frame int, stop_frame int"
#: Fixed value: recordings of labs whose name begins so have no labels.
UNLABELLED = "MABe22"
#: Fixed value: the row that stands for a result without rows.
PLACEHOLDER = (438887472, "mouse1", "self", "rear", 278, 500)
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def without_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose ``column`` does not begin with ``prefix``."""
    return df.where(~F.col(column).startswith(prefix))


def count_known(columns: list[str]) -> Column:
    """How many of the columns are not NULL."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def read_metadata(spark: SparkSession, path: str, skip_prefix: str | None = UNLABELLED) -> DataFrame:
    """One row per recording, with n_mice; recordings of an unlabelled lab are left out."""
    meta = spark.read.schema(METADATA).option("header", True).option("escape", '"').csv(path)
    if skip_prefix:
        meta = without_prefix(meta, "lab_id", skip_prefix)
    return meta.withColumn("n_mice", count_known([f"mouse{i}_strain" for i in range(1, 5)]))


def _names(reader: DataFrameReader, spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(lab, file name) of the files ``root/<lab>/<video>.parquet``; they come as one text, not a call each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    there = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", _all_files(reader, root)._jdf.inputFiles())
    paths, parts = (urlsplit(p).path.split("/") for p in there.split("\n")), files.makeQualified(at).depth() + 3
    return [(unquote(p[-2]), unquote(p[-1])) for p in paths if len(p) == parts]


def _all_files(reader: DataFrameReader, root: str) -> DataFrame:
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)


def _scan(reader: DataFrameReader, spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan over the files. Spark lists each path in a task of its own, up to 10,000; here a task lists many."""
    known = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(known), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return reader.parquet(*paths)
    finally:
        spark.conf.set(_LISTING, known)


def _per_video(spark: SparkSession, root: str, schema: str, wanted: DataFrame | None) -> DataFrame:
    """Files ``root/<lab>/<video>.parquet`` in one scan; the keys come from their paths.

    ``wanted`` (lab_id, video_id): only these recordings' files are listed to the scan, none that is not there. The names
    of the files that are there pass the driver, as the listing of all files does anyway; what is wanted does not.
    """
    path = F.col("_metadata.file_path")
    if wanted is None:
        table = _all_files(spark.read.schema(schema), root)
    else:
        names, found = _names(spark.read.schema(schema), spark, root), []
        if names:
            there = spark.createDataFrame(pa.table({"lab_id": [n[0] for n in names], "file": [n[1] for n in names]}))
            asked = wanted.select("lab_id", F.concat(F.col("video_id").cast("string"), F.lit(".parquet")).alias("file"))
            found = sorted(f"{root}/{r.lab_id}/{r.file}" for r in asked.join(there, ["lab_id", "file"]).distinct().collect())
        table = _scan(spark.read.schema(schema), spark, found) if found else spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    # Cut by its slashes: a pattern would be tried at every place of the path, for every row.
    lab, file = F.substring_index(F.substring_index(path, "/", -2), "/", 1), F.substring_index(path, "/", -1)
    columns = [c.split()[0] for c in schema.split(", ")]
    return table.select(F.url_decode(lab).alias("lab_id"), F.substring(file, F.lit(1), F.length(file) - len(".parquet")).cast("long").alias("video_id"), *columns)


def read_tracking(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Long points of all recordings, or of the ``wanted`` ones; NaN is read as missing."""
    return _per_video(spark, root, TRACKING, wanted).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x", "y")})


def read_annotations(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Closed intervals; a recording without a file has no rows, so it drops out of inner joins."""
    return _per_video(spark, root, ANNOTATION, wanted)


def write_intervals(intervals: DataFrame, path: str) -> None:
    """CSV with a consecutive row_id over (video_id, agent_id, target_id, start_frame).

    The rows are range-partitioned and numbered within partitions; the partitions' counts (one row each) give
    the offsets, so no task sees all rows. An empty result is written as the placeholder row.
    """
    spark = intervals.sparkSession
    if intervals.isEmpty():
        intervals = spark.createDataFrame([PLACEHOLDER], INTERVALS)
    order = ["video_id", "agent_id", "target_id", "start_frame", "stop_frame", "action"]
    staged = f"{path}_staged"
    intervals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    counts = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    rows = rows.join(F.broadcast(spark.createDataFrame(offsets, "_p int, _at long")), "_p")
    rows.select((F.col("_at") + F.col("_k")).alias("row_id"), *intervals.columns).write.mode("overwrite").option("header", True).csv(path)
    staged_path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    staged_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged_path, True)


def single_models(actions: DataFrame, registry: DataFrame, by: tuple[str, ...] = ("section", "action")) -> DataFrame:
    """Rows of ``actions`` with exactly one stored model in ``registry`` (``by``, path)."""
    one = registry.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return actions.join(one, list(by), "left_semi")


def model_registry(spark: SparkSession, root: str) -> DataFrame:
    """(section, kind, action, path) of the models under ``root``/<section>/<kind>/<action>; one row per model folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{root}/*/*/*")
    found = [s.getPath().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)]
    rows = [(*(lambda p: (p[-3], p[-2], unquote(p[-1])))(path.split("/")), path) for path in found]
    return spark.createDataFrame(rows, "section string, kind string, action string, path string")


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """(kind, section, action, threshold)."""
    thresholds.select("kind", "section", "action", F.col("threshold").cast("double")).write.mode("overwrite").parquet(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, section string, action string, threshold double").parquet(path)
