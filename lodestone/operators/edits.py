"""Edits of people and labels, registration of imports, mirrors of a catalogue: table in, table out.

People: (person, name). Labels: (face_key, person, verdict), one row for each face and person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create(people: DataFrame, person: int, name: str) -> DataFrame:
    return people.unionByName(people.sparkSession.createDataFrame([(person, name)], people.select("person", "name").schema))


def rename(people: DataFrame, person: int, name: str) -> DataFrame:
    return people.withColumn("name", F.when(F.col("person") == person, F.lit(name)).otherwise(F.col("name")))


def _put(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` in place of the labels of the same face and person."""
    return labels.join(rows.select("face_key", "person"), ["face_key", "person"], "left_anti").unionByName(rows)


def _verdicts(labels: DataFrame, faces: DataFrame, person: int, verdict: str) -> DataFrame:
    kind = labels.schema["person"].dataType
    return faces.select("face_key").distinct().select("face_key", F.lit(person).cast(kind).alias("person"), F.lit(verdict).alias("verdict"))


def confirm(labels: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    """The faces show this person: other confirmations of them go, rejections of others stay."""
    chosen = faces.select("face_key").distinct().withColumn("__chosen", F.lit(True))
    others = labels.join(chosen, "face_key", "left").filter(F.col("__chosen").isNull() | (F.col("verdict") != "confirmed")).drop("__chosen")
    return _put(others, _verdicts(labels, faces, person, "confirmed"))


def reject(labels: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    return _put(labels, _verdicts(labels, faces, person, "rejected"))


def merge(people: DataFrame, labels: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Labels of ``source`` become labels of ``target``, in place of those it had of the same faces."""
    moved = labels.filter(F.col("person") == source).withColumn("person", F.lit(target).cast(labels.schema["person"].dataType))
    return people.filter(F.col("person") != source), _put(labels.filter(F.col("person") != source), moved)


def delete(people: DataFrame, labels: DataFrame, person: int) -> tuple[DataFrame, DataFrame]:
    return people.filter(F.col("person") != person), labels.filter(F.col("person") != person)


def sync_actions(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asset, action) of a mirror of ``catalog``: added, removed, origin, requeued (another file or
    pipeline), moved or same. A change of origin alone is taken first, the rest by a later pass.

    Both tables: asset, path, signature, pipeline, origin.
    """
    names = ("path", "signature", "pipeline", "origin")
    old = jobs.select("asset", F.struct(*names).alias("o"))
    new = catalog.select("asset", F.struct(*names).alias("n"))
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differs("origin"), "origin")
    action = action.when(differs("signature") | differs("pipeline"), "requeued").when(differs("path"), "moved").otherwise("same")
    return old.join(new, "asset", "full_outer").select("asset", action.alias("action"))


def register(imports: DataFrame, media: DataFrame, jobs: DataFrame) -> DataFrame:
    """What verified imports do to the catalogue: (path, digest, action, queues, requeues).

    ``imports``: path, digest, signature; ``media``: path, digest, present (whether its file is
    there); ``jobs``: digest, signature. One item stands for one content: a known content at
    another path that is still present is a copy; one whose file is gone moves; an unknown one is
    new. ``queues``: it gets an index job; ``requeues``: its job's file has another signature.
    Of equal contents within the imports the first path stands for the content.
    """
    one = imports.groupBy("digest").agg(F.min("path").alias("first"))
    known = media.groupBy("digest").agg(F.max(F.struct("present", "path")).alias("m"))
    held = jobs.select("digest", F.col("signature").alias("held"))
    both = imports.join(one, "digest").join(known, "digest", "left").join(held, "digest", "left")
    elsewhere = F.col("m").isNotNull() & (F.col("m.path") != F.col("path"))
    first = F.col("path") == F.col("first")
    action = F.when(F.col("m.path") == F.col("path"), "known").when(elsewhere & F.col("m.present") | ~first, "copy").when(elsewhere, "moved").otherwise("new")
    out = both.select("path", "digest", action.alias("action"), "signature", "held")
    return out.select("path", "digest", "action", ((F.col("action") == "new") & F.col("held").isNull()).alias("queues"), ((F.col("action") != "copy") & F.coalesce(F.col("held") != F.col("signature"), F.lit(False))).alias("requeues"))
