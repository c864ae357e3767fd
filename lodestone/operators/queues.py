"""Work queues and change logs as table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts after which an error is final.
MOST_ATTEMPTS = 3


def pending() -> Column:
    return F.col("state").isin("queued", "running") | ((F.col("state") == "error") & (F.col("attempts") < MOST_ATTEMPTS))


def stage(done: Column) -> Column:
    return F.when(done == 0, "thumbnail").when(done == 1, "coarse").when(done == 2, "dense").otherwise("done")


def compacted(log: DataFrame, sequence: str, checkpoint: int) -> DataFrame:
    """The log without what lies before the checkpoint; the row at the checkpoint is its anchor."""
    return log.filter(F.col(sequence) >= checkpoint)


def sessions(readings: DataFrame, key: str, at: str, gap_seconds: float) -> DataFrame:
    """(key, start, end, readings): runs whose neighbours are at most ``gap_seconds`` apart."""
    w = Window.partitionBy(key).orderBy(at)
    seconds = lambda c: F.unix_micros(c) / 1e6
    begins = F.coalesce((seconds(F.col(at)) - seconds(F.lag(at).over(w)) > gap_seconds).cast("int"), F.lit(1))
    numbered = readings.withColumn("__begins", begins).withColumn("__session", F.sum("__begins").over(w))
    return numbered.groupBy(key, "__session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("readings")).drop("__session")


def advanced(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs (asset, state, attempts) after a round of outcomes (asset, ok), of which lost workers
    bring none: running jobs complete, or fail and count an attempt; those without an outcome are
    queued again, as are errors with attempts left; other states stay."""
    both = jobs.join(outcomes, "asset", "left")
    ran, failed = F.col("state") == "running", F.col("ok").isNotNull() & ~F.col("ok")
    attempts = F.col("attempts") + F.when(ran & failed, 1).otherwise(0)
    state = F.when(ran & F.col("ok"), "complete").when(ran & failed, F.when(attempts < MOST_ATTEMPTS, "queued").otherwise("error")).when(ran, "queued")
    state = state.when((F.col("state") == "error") & (F.col("attempts") < MOST_ATTEMPTS), "queued").otherwise(F.col("state"))
    return both.select("asset", state.alias("state"), attempts.cast("int").alias("attempts"))


#: Hours after which every asset is examined, whatever the history says.
FULL_PASS_HOURS = 6


def assets_to_examine(assets: DataFrame, history: DataFrame, token: int | None, hours_since_full: float | None, same_range: bool = True) -> DataFrame:
    """The assets of an import pass: those changed after ``token``, or all of them if there is no
    token, the range changed, the last full pass is too old, or the history before the token is gone.

    ``history``: sequence, asset, kind (inserted, updated or removed). Only its least sequence
    reaches the driver.
    """
    usable = token is not None and same_range and hours_since_full is not None and hours_since_full < FULL_PASS_HOURS
    oldest = history.agg(F.min("sequence")).first()[0] if usable else None
    if not usable or oldest is None or oldest > token + 1:
        return assets.select("asset").distinct()
    return history.filter((F.col("sequence") > token) & F.col("kind").isin("inserted", "updated")).select("asset").distinct()


# When a base is rebuilt.
PENDING_ASSETS, OVERLAY_ROWS, COMPACTION_HOURS = 512, 16_384, 12


def compaction_due(changes: DataFrame, bases: DataFrame) -> DataFrame:
    """``bases`` (base, checkpoint, hours; a null checkpoint is none yet) with due: never built, many
    assets or rows pending, or half a day old with anything pending. ``changes``: sequence, asset.

    Pending counts are taken by range of checkpoints, one pass over the changes; ``bases`` is a
    small table of states, one for each base.
    """
    marks = bases.select("base", "checkpoint").filter("checkpoint IS NOT NULL")
    pending = changes.join(F.broadcast(marks), F.col("sequence") > F.col("checkpoint")).groupBy("base").agg(F.countDistinct("asset").alias("assets"), F.count(F.lit(1)).alias("rows"))
    due = F.col("checkpoint").isNull() | (F.col("assets") >= PENDING_ASSETS) | (F.col("rows") >= OVERLAY_ROWS) | ((F.col("hours") >= COMPACTION_HOURS) & (F.col("rows") > 0))
    return bases.join(pending, "base", "left").select("base", F.coalesce(due, F.lit(False)).alias("due"))


def units_in_force(seeds: DataFrame, incremental: DataFrame) -> DataFrame:
    """Seeded and incremental units (asset, stage, ordinal, payload); the incremental one wins."""
    both = seeds.withColumn("side", F.lit(0)).unionByName(incremental.withColumn("side", F.lit(1)))
    best = both.groupBy("asset", "stage", "ordinal").agg(F.max(F.struct("side", "payload")).alias("u"))
    return best.select("asset", "stage", "ordinal", F.col("u.payload").alias("payload"))


def attempts_since(log: DataFrame, key: str, sequence: str, failed: Column, ended: Column) -> DataFrame:
    """(key, attempts): the failures of each key after its last end of connection. Two aggregates,
    both combined before the shuffle."""
    last = log.filter(ended).groupBy(key).agg(F.max(sequence).alias("__last"))
    after = log.join(last, key, "left").filter(F.col("__last").isNull() | (F.col(sequence) > F.col("__last")))
    counts = after.groupBy(key).agg(F.count(F.when(failed, 1)).alias("attempts"))
    return log.select(key).distinct().join(counts, key, "left").fillna(0, ["attempts"])


def lanes_with_work(work: DataFrame, seen: DataFrame) -> DataFrame:
    """(lane, token): lanes with ready rows whose token, their largest sequence, is not the one seen
    before. ``work``: lane, sequence, ready; ``seen``: lane, token."""
    now = work.groupBy("lane").agg(F.max("sequence").alias("token"), F.some("ready").alias("ready"))
    return now.join(seen.withColumnRenamed("token", "before"), "lane", "left").filter(F.col("ready") & ~F.col("token").eqNullSafe(F.col("before"))).select("lane", "token")


# Stages of previews, and the frames of a batch of the last one.
STAGES, DENSE_BATCH, COARSE_FRAMES = ("thumbnail", "coarse", "dense"), 16, 12


def preview_order(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The next preview jobs: priority first, then early stages, then those served longest ago, then the
    newest captures. Columns: asset, priority, stage, last_served, captured, state, attempts."""
    return jobs.filter(pending()).orderBy(F.desc("priority"), "stage", "last_served", F.desc("captured"), "asset").limit(limit)


def preview_requests(jobs: DataFrame) -> DataFrame:
    """``jobs`` (asset, stage, frames, done: the ordinals that there are) with the ordinals to make: the
    first frame, then evenly spaced ones, then sixteen missing ones at a time; and the next stage."""
    from lodestone.functions.media import coarse_ordinals

    missing = F.filter(F.sequence(F.lit(0), F.col("frames") - 1), lambda i: ~F.array_contains("done", i))
    wanted = F.when(F.col("stage") == 0, F.array(F.lit(0))).when(F.col("stage") == 1, coarse_ordinals(F.col("frames"), COARSE_FRAMES)).otherwise(F.slice(missing, 1, DENSE_BATCH))
    after = F.when(F.col("stage") < 2, F.col("stage") + 1).when(F.size(missing) <= DENSE_BATCH, 3).otherwise(2)
    return jobs.withColumn("wanted", wanted).withColumn("next_stage", after.cast("int"))
