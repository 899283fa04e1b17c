"""Tables written between steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spoorline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


class Stages:
    """Written tables of one job: they cut lineage, survive lost executors, and go when dropped or with the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n, self.written = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", 0, []
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def keep(self, rdd: RDD, write: bool = False) -> RDD:
        """Persisted when it is first used; with ``write`` its partitions also go to the shared folder, which cuts lineage."""
        if write:
            if not self.spark.sparkContext.getCheckpointDir():
                self.spark.sparkContext.setCheckpointDir(shared_folder(self.spark))
            rdd.checkpoint()
        return rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def let_go(self, rdd: RDD) -> None:
        """Of a kept one. What it wrote serves those made from it until the next written one is let go, or the job is closed."""
        rdd.unpersist()
        if rdd.getCheckpointFile():
            path, fs = self._at(rdd.getCheckpointFile())
            fs.deleteOnExit(path)
            self.written.append(path)
            if len(self.written) > 1:
                fs.delete(self.written.pop(0), True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, fs = self._at(table.stage_path)
            fs.delete(path, True)

    def close(self) -> None:
        path, fs = self._at(self.root)
        for own in (path, *self.written):
            fs.delete(own, True)
        self.written = []
