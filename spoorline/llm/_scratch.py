"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local session gets one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spoorline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Written tables of one operator call. Results read them when they are computed, so the folder goes with the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/spoorline-{uuid.uuid4().hex}", 0
        path, fs = self._file_system(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _file_system(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """As ``write``, in buckets by ``key``: what is grouped by it later is not shuffled again.

        Only tables have buckets, so the session's current database holds an external one for a moment; the frame
        that is returned knows files and buckets without it.
        """
        name = f"spoorline_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", f"{self.root}/{name}").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, fs = self._file_system(table.scratch_path)
            fs.delete(path, True)


def components(scratch: Scratch, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in links (u, v): the smallest id that links reach.

    Alternating large-star and small-star rounds; each halves path lengths, so a few rounds end it. ``rounds`` is a
    guard: a path of 2^60 links would be needed to reach it, and then it raises.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(low, "u")
        if large:
            out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            break
        new = scratch.write(star(star(now, True), False))
        scratch.drop(now)
        now, seen = new, mark(new)
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
