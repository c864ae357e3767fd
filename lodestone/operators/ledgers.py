"""Edits with undo, ledgers, differences, digests, retention: pure functions on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_people(labels: DataFrame, into: int, others: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Labels with ``others`` given to ``into``, and the rows that this changed as they were."""
    moved = F.col("person").isin(list(others))
    return labels.withColumn("person", F.when(moved, F.lit(into)).otherwise(F.col("person"))), labels.filter(moved)


def undo(labels: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """The scope of ``before`` as it was; everything else as it is."""
    return labels.join(before.select(key), key, "left_anti").unionByName(before)


def differences(old: DataFrame, new: DataFrame, key: str, watched: Sequence[str]) -> DataFrame:
    """added, removed, changed or same for every key of either table: one full outer join."""
    a = old.select(key, F.struct(*watched).alias("__a"))
    b = new.select(key, F.struct(*watched).alias("__b"))
    action = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def forget(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: table.join(gone.select(key), key, "left_anti") for name, table in tables.items()}


def digest(table: DataFrame, *keys: str) -> DataFrame:
    """Rows and an order-free digest: row hashes are summed, so that no row list is gathered."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)"))
    return table.agg(F.count(F.lit(1)).alias("rows"), *[part(1 + 8 * k).cast("string").alias(f"part{k}") for k in range(2)])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing and extra rows between two tables, counted with repeats."""
    names = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*names).withColumn("__n", F.lit(-1))).groupBy(*names).agg(F.sum("__n").alias("__n"))
    return both.agg(F.coalesce(F.sum(F.when(F.col("__n") > 0, F.col("__n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("__n") < 0, -F.col("__n"))), F.lit(0)).alias("extra"))


def retained(snapshots: DataFrame, now: str, newest: int = 3, hours: int = 24, days: int = 30, months: int = 12, identity: str | None = None, current: str | int | None = None) -> DataFrame:
    """Snapshots (file, created) to keep: the newest ones, and the newest of each hour, day and
    month bucket (UTC) inside its window; snapshots from the future stay. With ``identity`` only
    snapshots with that value in their ``identity`` column may go, and ``current`` never goes."""
    at, until = F.col("created"), F.lit(now).cast("timestamp")
    everything = snapshots
    if identity is not None:
        snapshots = snapshots.filter(F.col("identity") == identity)
    past = snapshots.filter(at <= until)
    order = [F.desc("created"), F.asc("file")]
    last = past.orderBy(*order).limit(newest).select("file")

    # one aggregate with map-side combining: a month's snapshots are never gathered in one task
    first = F.min(F.struct((-F.unix_micros(at.cast("timestamp"))).alias("age"), "file")).alias("first")

    def tier(unit: str, since) -> DataFrame:
        return past.filter(at >= since).groupBy(F.date_trunc(unit, at).alias("bucket")).agg(first).select("first.file")

    tiers = [tier("hour", until - F.make_interval(hours=F.lit(hours))), tier("day", until - F.make_interval(days=F.lit(days))), tier("month", until - F.make_interval(months=F.lit(months)))]
    out = snapshots.filter(at > until).select("file").unionByName(last)
    for part in tiers:
        out = out.unionByName(part)
    if identity is not None:
        out = out.unionByName(everything.filter(~F.col("identity").eqNullSafe(F.lit(identity))).select("file"))
    if current is not None:
        out = out.unionByName(everything.filter(F.col("file") == current).select("file"))
    return out.distinct()


def new_history(history: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``values`` (key, value) to append to ``history`` (key, value, sequence): those whose
    value differs from the key's last one."""
    last = history.groupBy("key").agg(F.max(F.struct("sequence", "value")).alias("last"))
    return values.join(last, "key", "left").filter(F.col("last").isNull() | ~F.col("last.value").eqNullSafe(F.col("value"))).select("key", "value")


def receipt_states(receipts: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(receipt, state): recorded if the ledger (receipt) has it, complete if it has files and all of
    its files (receipt, verified) are verified, else waiting."""
    counts = files.groupBy("receipt").agg(F.every(F.coalesce("verified", F.lit(False))).alias("all"))
    known = ledger.select("receipt", F.lit(True).alias("known")).distinct()
    both = receipts.select("receipt").join(counts, "receipt", "left").join(known, "receipt", "left")
    return both.select("receipt", F.when(F.col("known"), "recorded").when(F.col("all"), "complete").otherwise("waiting").alias("state"))


def generation_fates(generations: DataFrame, packs: DataFrame, references: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(asset, directory, fate) of superseded generations: current if a pack still uses the folder,
    referenced if any frame of the asset (from media, summaries, frames or units) lies in it, review
    if its files (directory, name, digest) are not exactly those of its manifest, else remove."""
    used = packs.select("directory", F.lit(True).alias("used")).distinct()
    held = references.select("asset", F.regexp_extract("frame", r"^(.*)/[^/]*$", 1).alias("directory"), F.lit(True).alias("held")).distinct()
    signed = files.select("directory", "name", "digest", F.lit(1).alias("n")).unionByName(manifests.select("directory", "name", "digest", F.lit(-1).alias("n")))
    odd = signed.groupBy("directory", "name", "digest").agg(F.sum("n").alias("n")).filter("n <> 0").select("directory", F.lit(True).alias("odd")).distinct()
    both = generations.select("asset", "directory").join(used, "directory", "left").join(held, ["asset", "directory"], "left").join(odd, "directory", "left")
    return both.select("asset", "directory", F.when(F.col("used"), "current").when(F.col("held"), "referenced").when(F.col("odd"), "review").otherwise("remove").alias("fate"))
