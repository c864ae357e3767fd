"""The registered queries: a Spark plan for each, and SQL that gives the same rows.

Stand-ins for a media catalogue on the driver's tables: orders are files, events are frames and
change events, conversations are transcripts, embeddings are frame vectors (five to a file).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}
_MODULES = ("browse", "search", "vectors", "people", "work", "ledgers", "values", "rules")


class Tables:
    """The driver's tables and the stand-ins, as plans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS asset",
            "concat('/library/', o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '.JPG' ELSE '.mp4' END) AS path",
            "o_orderpriority AS camera",
            "o_orderstatus AS kind",
            "CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE date_format(o_orderdate, 'yyyyMMddHHmmss') END AS captured",
            "CASE o_custkey % 3 WHEN 0 THEN 'square' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS shape",
            "o_orderkey AS arrival",
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.events.selectExpr("user_id AS asset", "event_id AS frame", "event_type AS stage", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D AS secs")

    @cached_property
    def speech(self) -> DataFrame:
        return self.conversations.selectExpr("conv_id AS asset", "turn AS ordinal", "role AS chunk", "text", "conv_id * 1000 + turn AS id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.expr("vec_id div 5").alias("asset"), F.expr("vec_id % 5").alias("ordinal"), F.col("embedding").cast("array<double>").alias("vector"), "label")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        """A small table of constants, with a fixed number of rows."""
        return self.spark.createDataFrame(list(rows), schema)


SQL = {
    "files": """files AS (SELECT o_orderkey AS asset, '/library/' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.JPG' ELSE '.mp4' END AS path,
        o_orderpriority AS camera, o_orderstatus AS kind, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d%H%M%S') END AS captured,
        CASE o_custkey % 3 WHEN 0 THEN 'square' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS shape, o_orderkey AS arrival FROM orders)""",
    "frames": "frames AS (SELECT user_id AS asset, event_id AS frame, event_type AS stage, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS secs FROM events)",
    "speech": "speech AS (SELECT conv_id AS asset, turn AS ordinal, role AS chunk, text, conv_id * 1000 + turn AS id FROM conversations)",
    "vectors": "vectors AS (SELECT vec_id, vec_id // 5 AS asset, vec_id % 5 AS ordinal, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)",
}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of ``Tables``; ``{files}`` and the like stand for common table expressions."""

    def wrap(function: Callable) -> Callable:
        text = sql
        if text is not None:
            for key, body in SQL.items():
                text = text.replace("{" + key + "}", body)
        REGISTRY[name] = (function, text)
        return function

    return wrap


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"lodestone.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=function: f(Tables(spark, sf_dir))) for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
