"""Who is who: personal labels on current faces, suggestions, moments, tracks, groups of the rest.

Tables: faces (face, asset, at, x1, y1, x2, y2, norm, track, representative, reliable, vector),
media (asset, kind, captured in seconds), people (person), labels (label, asset, at, x1, y1, x2,
y2, person, verdict); a label's number orders the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import media as attributes
from lodestone.operators import people as faces_of
from lodestone.operators.ranking import dot
from lodestone.sources.storage import Scratch

# Thresholds on similarities, seconds and overlaps.
AUTOMATIC = 0.65
MOMENT = 0.5
MOMENT_SECONDS = 60
LABEL_SECONDS = 0.25
LABEL_OVERLAP = 0.5
LEAST_NORM = 17.0

_CORNERS = ("x1", "y1", "x2", "y2")
#: Stands for a missing time where rows without one may meet.
_NO_SLOT = -(1 << 60)


def _slots(at: Column, width: float, wide: bool = False) -> Column:
    """The time slot of a row, or with ``wide`` its neighbours too, so that near rows meet in one."""
    slot = F.floor(at / width)
    some = F.array(*[slot + d for d in ((-1, 0, 1) if wide else (0,))])
    return F.explode(F.when(at.isNull(), F.array(F.lit(_NO_SLOT))).otherwise(some))


def seeds(faces: DataFrame) -> DataFrame:
    """The faces that groups and suggestions start from."""
    return faces.filter(F.col("representative") & F.col("reliable") & (F.col("norm") >= LEAST_NORM))


def match_labels(labels: DataFrame, faces: DataFrame, seconds: float = LABEL_SECONDS, least: float = LABEL_OVERLAP) -> DataFrame:
    """``labels`` with the face each is about: of the faces of its asset within ``seconds`` (or
    without a time, if it has none) the one that overlaps most, the larger id on ties."""
    mine = labels.select("label", "asset", F.col("at").alias("l_at"), *[F.col(c).alias(f"l_{c}") for c in _CORNERS], _slots(F.col("at"), seconds, True).alias("slot"))
    others = faces.select("face", "asset", F.col("at").alias("f_at"), *[F.col(c).alias(f"f_{c}") for c in _CORNERS], _slots(F.col("at"), seconds).alias("slot"))
    near = F.col("l_at").isNull() & F.col("f_at").isNull() | (F.abs(F.col("l_at") - F.col("f_at")) <= seconds)
    pairs = mine.join(others, ["asset", "slot"]).filter(near).withColumn("overlap", attributes.iou("l_", "f_")).filter(F.col("overlap") >= least)
    best = pairs.groupBy("label").agg(F.max(F.struct("overlap", "face")).alias("best")).select("label", F.col("best.face").alias("face"))
    return labels.join(best, "label")


@dataclass
class Verdicts:
    confirmed: DataFrame  # face, person
    rejected: DataFrame  # face, person


def resolve(labels: DataFrame, people: DataFrame, faces: DataFrame) -> Verdicts:
    """Labels of known people on current faces; a face's last confirmation holds."""
    found = match_labels(labels.join(people.select("person"), "person", "left_semi"), faces)
    last = found.filter("verdict = 'confirmed'").groupBy("face").agg(F.max(F.struct("label", "person")).alias("last"))
    return Verdicts(last.select("face", F.col("last.person").alias("person")), found.filter("verdict = 'rejected'").select("face", "person").distinct())


def same_moment(suggested: DataFrame, confirmed: DataFrame, faces: DataFrame, media: DataFrame) -> DataFrame:
    """The faces among ``suggested`` (face, person, sim) whose weak suggestion the same moment backs.

    Anchors are the person's confirmed faces in the same video, or in another photo taken within
    a minute; a second face of one photo is somebody else. Automatic matches are no anchors.
    """
    place = faces.select("face", "asset", "vector").join(media.select("asset", "kind", "captured"), "asset", "left")
    weak = suggested.filter(F.col("sim") < AUTOMATIC).join(place, "face")
    anchors = confirmed.join(place, "face").select("person", *[F.col(c).alias(f"a_{c}") for c in ("asset", "kind", "captured", "vector")])
    video = weak.filter("kind = 'video'").join(anchors.withColumn("asset", F.col("a_asset")), ["person", "asset"])
    photo = lambda frame, kind, at, wide: frame.filter((F.col(kind) == "image") & F.col(at).isNotNull()).withColumn("slot", _slots(F.col(at), MOMENT_SECONDS, wide))
    photos = photo(weak, "kind", "captured", False).join(photo(anchors, "a_kind", "a_captured", True), ["person", "slot"])
    photos = photos.filter((F.col("asset") != F.col("a_asset")) & (F.abs(F.col("captured") - F.col("a_captured")) <= MOMENT_SECONDS))
    alike = dot(F.col("vector").cast("array<double>"), F.col("a_vector").cast("array<double>")) >= MOMENT
    return video.filter(alike).select("face").unionByName(photos.filter(alike).select("face")).distinct()


def settle_tracks(assigned: DataFrame, faces: DataFrame, rejected: DataFrame) -> DataFrame:
    """``assigned`` (face, person, source, sim) after tracks: a track follows its first confirmed
    face, else its most similar one; faces without a person take it, and weak suggestions of it
    too, once a confirmation or an automatic match settles the track. Rejections stand."""
    all_ = faces.select("face", "asset", F.coalesce("track", F.lit(-1)).alias("track")).join(assigned, "face", "left")
    confirmed = F.when(F.col("source") == "confirmed", F.struct("face", "person"))
    strongest = F.when(F.col("person").isNotNull(), F.struct(F.coalesce("sim", F.lit(0.0)).alias("s"), (-F.col("face")).alias("f"), F.col("person").alias("person")))
    sure = (F.col("source") == "moment") | ((F.col("source") == "suggested") & (F.coalesce("sim", F.lit(0.0)) >= AUTOMATIC))
    votes = all_.groupBy("asset", "track").agg(F.min(confirmed).alias("c"), F.max(strongest).alias("s"), F.collect_set(F.when(sure, F.col("person"))).alias("sure"))
    votes = votes.select("asset", "track", F.coalesce("c.person", "s.person").alias("voted"), (F.col("c").isNotNull() | F.array_contains("sure", F.coalesce("c.person", "s.person"))).alias("settled")).filter("voted IS NOT NULL")
    both = all_.join(votes, ["asset", "track"], "left").join(rejected.select("face", F.col("person").alias("voted"), F.lit(True).alias("no")), ["face", "voted"], "left")
    weak = F.col("settled") & (F.col("source") == "suggested") & (F.col("person") == F.col("voted")) & (F.coalesce("sim", F.lit(0.0)) < AUTOMATIC)
    takes = F.col("voted").isNotNull() & F.col("no").isNull() & (F.col("person").isNull() | F.coalesce(weak, F.lit(False)))
    out = both.select("face", F.when(takes, F.col("voted")).otherwise(F.col("person")).alias("person"), F.when(takes, F.lit("track")).otherwise(F.col("source")).alias("source"), F.when(~takes, F.col("sim")).alias("sim"))
    return out.filter("person IS NOT NULL")


@dataclass
class Identities:
    assignments: DataFrame  # face, person, source, sim
    groups: DataFrame  # face, grp, typical


def recompute(faces: DataFrame, media: DataFrame, people: DataFrame, labels: DataFrame) -> Identities:
    """All assignments and the groups of unassigned seeds, from the tables as they are."""
    scratch = Scratch(faces.sparkSession, "identities")
    verdicts = resolve(labels, people, faces)
    confirmed, rejected = scratch.save(verdicts.confirmed), scratch.save(verdicts.rejected)
    candidates = seeds(faces).join(confirmed, "face", "left_anti")
    examples = faces.join(confirmed, "face").select("person", "vector")
    suggested = scratch.save(faces_of.suggest(candidates.select("face", "vector"), examples, rejected=rejected))
    moments = same_moment(suggested, confirmed, faces, media).withColumn("moment", F.lit(True))
    matched = suggested.join(moments, "face", "left").select("face", "person", F.when(F.col("moment"), "moment").otherwise("suggested").alias("source"), "sim")
    assigned = confirmed.select("face", "person", F.lit("confirmed").alias("source"), F.lit(None).cast("double").alias("sim")).unionByName(matched)
    assigned = scratch.save(settle_tracks(assigned, faces, rejected))
    rest = scratch.save(seeds(faces).join(assigned.select("face"), "face", "left_anti").select("face", "asset", "track", F.col("vector").cast("array<double>").alias("vector")))
    before = F.lag("face").over(Window.partitionBy("asset", "track").orderBy("face"))
    must = rest.select(before.alias("a"), F.col("face").alias("b")).filter("a IS NOT NULL")
    vectors = rest.select(F.col("face").alias("vec_id"), "vector")
    groups = scratch.save(faces_of.merged(vectors, faces_of.grouped(vectors, must)))
    first = groups.groupBy("grp").agg(F.min("vec_id").alias("first"))
    groups = groups.join(first, "grp").select("vec_id", F.col("first").alias("grp"))
    typical = faces_of.typicality(vectors.join(groups, "vec_id"), "grp", "vec_id").withColumnRenamed("typical", "t")
    out = scratch.save(groups.join(typical, "vec_id").select(F.col("vec_id").alias("face"), "grp", F.col("t").alias("typical")))
    scratch.keep_only(assigned, out)
    return Identities(assigned, out)
