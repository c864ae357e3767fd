"""Snapshots of tables with receipts, restores, migrations, conditional writes, history checks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ledgers import digest


class Store:
    """Versions of one table below a folder: data first, the receipt that makes a version exist last."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def receipts(self) -> list[dict]:
        place = self._path(f"{self.root}/receipts")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []
        return [json.loads(self.spark.read.text(f"{place.toString()}/{n}", wholetext=True).first()[0]) for n in names]

    def current(self) -> DataFrame:
        return self.read(self.receipts()[-1])

    def read(self, receipt: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{receipt['folder']}")

    def write(self, table: DataFrame, keys: Sequence[str], **facts) -> dict:
        """A new version with its rows, digest and ``facts`` (identity, revision, schema ...)."""
        number = len(self.receipts())
        folder = f"version-{number:08d}"
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)  # a lost writer's, without receipt
        table.write.parquet(f"{self.root}/{folder}")
        receipt = {"folder": folder, **facts, **summary(self.spark.read.parquet(f"{self.root}/{folder}"), keys)}
        write_json(self.spark, f"{self.root}/receipts/{number:08d}.json", receipt)
        return receipt

    def snapshot(self, table: DataFrame, keys: Sequence[str], identity: str, revision: int, token: str) -> dict:
        """The version of (identity, revision, token): the one that is there, else a new one."""
        facts = {"identity": identity, "revision": revision, "token": token}
        same = [r for r in self.receipts() if {k: r.get(k) for k in facts} == facts]
        return same[-1] if same else self.write(table, keys, **facts)

    def upsert(self, rows: DataFrame, key: str, keys: Sequence[str]) -> dict:
        """Rows in place of those with their key. Where nothing differs no version is written, so
        that readers who compare tokens see no change."""
        held, names = self.current(), [c for c in rows.columns if c != key]
        old = held.select(key, F.struct(*names).alias("__old"))
        changed = rows.join(old, key, "left").filter(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(*names))).drop("__old")
        if not changed.limit(1).count():
            return self.receipts()[-1]
        last = self.receipts()[-1]
        merged = held.join(changed.select(key), key, "left_anti").unionByName(changed)
        return self.write(merged, keys, **{k: v for k, v in last.items() if k not in ("folder", "rows", "digest")})

    def migrate(self, steps: dict[int, Callable[[DataFrame], DataFrame]], target: int, keys: Sequence[str]) -> dict:
        """Takes the table from its schema number to ``target``, one step after the other, and writes
        one version; a step that fails leaves the version that is there."""
        last = self.receipts()[-1]
        schema, table = last.get("schema", 0), self.current()
        if schema > target:
            raise ValueError(f"schema {schema} is newer than {target}")
        if schema == target:
            return last
        for number in range(schema, target):
            table = steps[number](table)
        return self.write(table, keys, **{**{k: v for k, v in last.items() if k not in ("folder", "rows", "digest")}, "schema": target})


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small file, written whole; one that is there is not replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    stream.close()


def summary(table: DataFrame, keys: Sequence[str]) -> dict:
    found = digest(table, *keys).first()
    return {"rows": found["rows"], "digest": f"{found['part0']}-{found['part1']}"}


def restore(spark: SparkSession, store: Store, receipt: dict, destination: str, keys: Sequence[str]) -> dict:
    """Copies a version into a new folder and compares it with its receipt; a folder that is there is refused."""
    destination = destination.rstrip("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(destination)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(destination)
    store.read(receipt).write.parquet(f"{destination}/rows")
    copy = summary(spark.read.parquet(f"{destination}/rows"), keys)
    if copy != {k: receipt[k] for k in copy}:
        raise ValueError(f"what was restored differs from {receipt['folder']}")
    out = {"source": f"{store.root}/{receipt['folder']}", **copy}
    write_json(spark, f"{destination}/restore.json", out)
    return out


def check_history(checkpoint: dict | None, state: dict, log: DataFrame) -> None:
    """Refuses to go on from a checkpoint (identity, epoch, sequence, anchor) of another catalogue or
    of a history that was restored or cut: the log's (sequence, token) row at its sequence must be its own."""
    if checkpoint is None:
        return
    if (checkpoint["identity"], checkpoint["epoch"]) != (state["identity"], state["epoch"]):
        raise ValueError("the checkpoint is another catalogue's; rebuild in a new folder")
    if checkpoint["sequence"]:
        row = log.filter(F.col("sequence") == checkpoint["sequence"]).select("token").first()
        if row is None or row[0] != checkpoint["anchor"]:
            raise ValueError("the history was restored or cut; rebuild the projection")


#: What a delta over a base may hold before the base must be rebuilt.
OVERLAY_ASSETS, OVERLAY_ROWS = 4096, 32_768


def check_overlay(delta: DataFrame) -> None:
    """Refuses a delta (asset, one row a vector) that is beyond its limits."""
    size = delta.agg(F.countDistinct("asset").alias("assets"), F.count(F.lit(1)).alias("rows")).first()
    if size["assets"] > OVERLAY_ASSETS or size["rows"] > OVERLAY_ROWS:
        raise RuntimeError("the delta needs compaction")
