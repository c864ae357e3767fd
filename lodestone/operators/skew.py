"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task.
ABOVE = 512
#: Keys that are spread; a key beyond these holds less than one in so many of all rows.
MOST = 10_000


def hot_keys(counts: DataFrame, key: str, count: str, above: int = ABOVE, most: int = MOST) -> DataFrame:
    """(key, __parts) of the at most ``most`` keys with more than ``above`` rows, by a table of
    counts; a key gets a part for every ``above`` of its rows."""
    large = counts.filter(F.col(count) > above).orderBy(F.desc(count), key).limit(most)
    return large.select(key, F.ceil(F.col(count) / above).cast("long").alias("__parts"))


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` (few rows for each key): rows of a hot key are dealt to its
    parts by a hash of ``by``, and its rows of ``one`` are repeated once for each part.

    All repeats together are at most one for each ``ABOVE`` rows of ``many``. ``hot`` is a
    written table of ``hot_keys``, which bounds what is broadcast.
    """
    if not hot.limit(1).count():
        return many.join(one, key, how)
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts)).drop("__parts")
    copies = one.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"], how).drop("__part")
