"""Top rows, one best row for each file, fusion of ranked lists, and base-plus-delta search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import Scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def against(vector: Column, query: Sequence[float]) -> Column:
    """The inner product with one constant vector."""
    return dot(vector, F.array(*[F.lit(float(x)) for x in query]))


def normalised(vector: Column) -> Column:
    """Unit length; null for zero or non-finite vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(vector, lambda x: x / norm))


def best_per_asset(hits: DataFrame, score: str = "score", tie: str = "ordinal") -> DataFrame:
    """The best-scoring row of each asset, the smallest ``tie`` on equal scores: one aggregate."""
    rest = [c for c in hits.columns if c not in ("asset", score, tie)]
    top = F.max(F.struct(F.col(score), (-F.col(tie)).alias("__tie"), *rest)).alias("__top")
    return hits.groupBy("asset").agg(top).select("asset", F.col(f"__top.{score}").alias(score), (-F.col("__top.__tie")).alias(tie), *[F.col(f"__top.{c}").alias(c) for c in rest])


def top_assets(vectors: DataFrame, query: Sequence[float], limit: int = 60) -> DataFrame:
    """The ``limit`` files whose best frame scores highest: exact, one aggregate and a top-k."""
    scored = vectors.select("asset", "ordinal", against(F.col("vector"), query).alias("score")).filter(~F.isnan("score"))
    return best_per_asset(scored).orderBy(F.desc("score"), "asset").limit(limit)


def overlay(base: DataFrame, delta: DataFrame, touched: DataFrame) -> DataFrame:
    """Base rows of untouched assets and all rows of the delta."""
    return base.join(touched.select("asset").distinct(), "asset", "left_anti").unionByName(delta)


def fuse(lists: Sequence[DataFrame], k: int = 60, limit: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (asset, rank): asset, score, lists."""
    together = None
    for number, ranked in enumerate(lists):
        part = ranked.select("asset", (F.lit(1.0) / (k + F.col("rank"))).alias("part"), F.lit(1 << number).alias("bit"))
        together = part if together is None else together.unionByName(part)
    return together.groupBy("asset").agg(F.sum("part").alias("score"), F.bit_or("bit").alias("lists")).orderBy(F.desc(F.round("score", 12)), "asset").limit(limit)


def ranked(hits: DataFrame, *order: Column | str, limit: int = 60) -> DataFrame:
    """The first ``limit`` rows with their rank; the window sees those rows only."""
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """All rows with their place from 1 in one global order, which should leave no ties.

    The rows are range-partitioned, sorted and written once; a partition's places begin after
    the rows of the partitions before it, so that only one count a partition reaches the driver.
    """
    spark = rows.sparkSession
    at = F.col("__at")
    # the upper bits number the sorted partition, the lower 33 its rows
    held = Scratch(spark, "placed").save(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    counts = held.groupBy(F.shiftright(at, 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["count"]
    before = F.broadcast(spark.createDataFrame(starts, "__part long, __before long"))
    return held.join(before, F.shiftright(at, 33) == F.col("__part")).withColumn("place", F.col("__before") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def first_per(rows: DataFrame, key: str | Sequence[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
