"""A checkpointed consumer of change events that keeps a projection in generations.

Change events are Parquet files in a folder. Each micro-batch is collapsed to one row for each
asset and merged into the current generation; an event older than what the projection holds of
its asset changes nothing, and removed assets stay as marks so that this holds for them too.
The result is written to a folder of its own, never over another, and its manifest is written
last: a generation without one does not exist for readers, so that a writer may be lost between
any two steps. The current generation is the one of the highest batch; a batch that was already
merged is skipped, so that replay changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sequence long, asset long, camera string, removed boolean"
PROJECTION = "asset long, camera string, arrival long, sequence long, removed boolean"
_NAME = re.compile(r"generation-(\d{8})-[0-9a-f]{32}")


def collapse(events: DataFrame) -> DataFrame:
    """The last event of each asset."""
    return events.groupBy("asset").agg(F.max(F.struct("sequence", "camera", "removed")).alias("e")).select("asset", "e.sequence", "e.camera", "e.removed")


def merge(held: DataFrame, changes: DataFrame) -> DataFrame:
    """The projection, marks of removed assets included, after the changes; an asset that is
    there keeps the arrival of its first sight."""
    last = collapse(changes).select("asset", F.struct("sequence", "camera", F.coalesce("removed", F.lit(False)).alias("removed")).alias("new"))
    both = held.join(last, "asset", "full_outer")
    newer = F.col("new").isNotNull() & (F.col("sequence").isNull() | (F.col("new.sequence") > F.col("sequence")))
    pick = lambda name: F.when(newer, F.col(f"new.{name}")).otherwise(F.col(name)).alias(name)
    arrival = F.when(newer & (F.col("arrival").isNull() | F.col("removed")), F.col("new.sequence")).otherwise(F.col("arrival"))
    return both.select("asset", pick("camera"), arrival.alias("arrival"), pick("sequence"), pick("removed"))


class Generations:
    """Immutable generations below a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[str]:
        place = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _complete(self) -> list[tuple[int, str]]:
        """(batch, name) of the generations that have a manifest."""
        named = [(int(m[1]), name) for name in self._folders() if (m := _NAME.fullmatch(name))]
        return sorted((batch, name) for batch, name in named if self._fs.exists(self._path(f"{self.root}/{name}/manifest.json")))

    def pointer(self) -> dict:
        """The current generation; of two of one batch, written by a lost and a new driver, the first by name."""
        found = self._complete()
        if not found:
            return {"generation": None, "batch": -1}
        batch = found[-1][0]
        return {"generation": next(name for own, name in found if own == batch), "batch": batch}

    def resolve(self, name: str) -> str:
        """The folder of a generation; anything else than the name of one is refused."""
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no generation")
        return f"{self.root}/{name}"

    def manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.resolve(name)}/manifest.json", wholetext=True).first()[0])

    def held(self) -> DataFrame:
        """The projection with its marks."""
        name = self.pointer()["generation"]
        if name is None:
            return self.spark.createDataFrame([], PROJECTION)
        return self.spark.read.schema(PROJECTION).parquet(f"{self.resolve(name)}/rows")

    def current(self) -> DataFrame:
        return self.held().filter("NOT removed").drop("removed")

    def write(self, frame: DataFrame, batch: int) -> str:
        """Writes the rows of a generation; readers don't see it yet."""
        name = f"generation-{batch:08d}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.resolve(name)}/rows")
        return name

    def complete(self, name: str, batch: int) -> None:
        """Writes the manifest, which makes a generation exist; one that is there is not replaced."""
        rows = self.spark.read.schema(PROJECTION).parquet(f"{self.resolve(name)}/rows").count()
        stream = self._fs.create(self._path(f"{self.resolve(name)}/manifest.json"), False)
        stream.write(bytearray(json.dumps({"batch": batch, "rows": rows}).encode()))
        stream.close()

    def publish(self, frame: DataFrame, batch: int) -> None:
        self.complete(self.write(frame, batch), batch)

    def apply(self, changes: DataFrame, batch: int) -> None:
        if batch > self.pointer()["batch"]:
            self.publish(merge(self.held(), changes), batch)

    def cleanup(self, keep: int = 3, pinned: Iterable[str] = ()) -> list[str]:
        """Removes generations but for the newest ``keep`` and the pinned ones, and what lost
        writers left before the current one; returns the names."""
        complete = self._complete()
        kept = {name for _, name in complete[-keep:]} | set(pinned) | {self.pointer()["generation"]}
        done = {name for _, name in complete}
        now = self.pointer()["batch"]
        gone = [name for name in self._folders() if (m := _NAME.fullmatch(name)) and name not in kept and (name in done or int(m[1]) < now)]
        for name in gone:
            self._fs.delete(self._path(self.resolve(name)), True)
        return gone


def consume(spark: SparkSession, events: str, root: str, checkpoint: str, files_per_batch: int = 8):
    """Merges all events that are there, batch by batch, and stops."""
    target = Generations(spark, root)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(events)
    query = stream.writeStream.foreachBatch(lambda frame, batch: target.apply(frame, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return target
