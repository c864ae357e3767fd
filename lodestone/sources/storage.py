"""Scratch tables that every executor can read, and their removal.

A lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back. The
files are in the folder that the cluster shares, so that they outlive any executor. Only a
local session without the setting gets a temporary folder; a cluster without it is an error.
What a job did not drop itself goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; made only in local sessions that have none."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


class Scratch:
    """Scratch tables of one job; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._saved: dict[str, DataFrame] = {}

    def folder(self) -> str:
        """The folder of the job, made if need be; it goes when the application ends."""
        place, files = _place(self.spark, self.base)
        if files.mkdirs(place):
            files.deleteOnExit(place)
        return self.base

    def save(self, frame: DataFrame) -> DataFrame:
        """Writes the rows and returns them as a plain scan."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        self.folder()
        frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        self._saved[path] = saved
        saved._scratch_path = path
        return saved

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._saved.pop(frame._scratch_path, None)
            remove(self.spark, frame._scratch_path)

    def keep_only(self, *frames: DataFrame) -> None:
        """Drops every table but these."""
        kept = {frame._scratch_path for frame in frames}
        self.drop(*[frame for path, frame in self._saved.items() if path not in kept])


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that owns its path."""
    place, files = _place(spark, path)
    files.delete(place, True)
