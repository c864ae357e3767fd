"""Keyset pages, facets and their upkeep, totals routed to the smallest table that can answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scope import Scope


def _order(newest: bool) -> list[Column]:
    captured = F.col("captured")
    return [(captured == "").asc(), captured.desc() if newest else captured.asc(), F.col("asset").asc()]


def page(files: DataFrame, scope: Scope = Scope(), after: tuple[str, int] | None = None, limit: int = 100, newest: bool = True) -> DataFrame:
    """The next ``limit`` rows after the cursor (captured, asset); unknown dates come last either way."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    found = scope.apply(files)
    if after is not None:
        captured, asset = after
        c = F.col("captured")
        same = (c == captured) & (F.col("asset") > asset)
        if captured == "":
            found = found.filter(same)
        else:
            beyond = (c < captured) if newest else (c > captured)
            found = found.filter((c == "") | same | (beyond & (c != "")))
    return found.orderBy(*_order(newest)).limit(limit)


def facets(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))


def day_facets(files: DataFrame) -> DataFrame:
    return facets(files.withColumn("day", F.substring("captured", 1, 8)), "camera", "shape", "kind", "day")


def merge_facets(counts: DataFrame, before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Counts after rows changed from ``before`` to ``after``; keys that reach zero go."""
    signed = counts.select(*keys, "files").unionByName(before.select(*keys, F.lit(-1).cast("long").alias("files"))).unionByName(after.select(*keys, F.lit(1).cast("long").alias("files")))
    return signed.groupBy(*keys).agg(F.sum("files").alias("files")).filter("files > 0")


def total(files: DataFrame, day_counts: DataFrame, scope: Scope) -> DataFrame:
    """The number of files in scope, from day facets where these suffice, less late arrivals."""
    plain = Scope(scope.camera, scope.shape, scope.kind, scope.start, scope.through)
    if scope.assets is not None or not plain.covers_whole_days():
        return scope.apply(files).agg(F.count(F.lit(1)).alias("total"))
    days = day_counts.withColumn("captured", F.when(F.col("day") == "", "").otherwise(F.concat("day", F.lit("000000"))))
    base = days.filter(plain.predicate()).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n"))
    if scope.arrival_through is None:
        return base.select(F.col("n").alias("total"))
    late = files.filter(plain.predicate() & (F.col("arrival") > scope.arrival_through)).agg(F.count(F.lit(1)).alias("late"))
    return base.join(late).select((F.col("n") - F.col("late")).alias("total"))  # one row each


def visible(items: DataFrame, deleted: DataFrame, scope: Scope = Scope(), annotations: DataFrame | None = None, favorites: bool = False, labels: Sequence[str] = (), people: DataFrame | None = None) -> DataFrame:
    """The items of a scope that are not deleted, show the people asked for (asset), and carry any of the
    labels as a tag or place, or are favourites, where that is asked. ``annotations``: asset,
    favorite, place, tags; an item without a row has none."""
    out = scope.apply(items).join(deleted.select("asset"), "asset", "left_anti")
    if people is not None:
        out = out.join(people.select("asset"), "asset", "left_semi")
    if annotations is not None and (favorites or labels):
        wanted = F.coalesce("favorite", F.lit(False)) if favorites else F.lit(True)
        if labels:
            carried = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.coalesce("place", F.lit(""))))
            wanted = wanted & F.arrays_overlap(carried, F.array(*map(F.lit, labels)))
        out = out.join(annotations.filter(wanted).select("asset"), "asset", "left_semi")
    return out
