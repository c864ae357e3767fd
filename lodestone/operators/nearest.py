"""Nearest-in-time joins without comparing all pairs of a key: one shuffle by key, and with time
buckets three more of which two carry one row for each bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_id: str, bucket: float | None = None) -> DataFrame:
    """``left`` with the id and time of the row of ``right`` with the same key and nearest time.

    Both sides are sorted together once for each key: the last right row at or before and the
    first one after are found by running windows, and the nearer is taken, the earlier on ties.
    Rows of ``left`` without any right row, or with a null time, keep nulls. With ``bucket``
    (seconds) a key is cut into time buckets, so that a hot key is spread; neighbours beyond
    a bucket come from a small table of each bucket's first and last row.
    """
    l = left.withColumn("__at", F.col(left_at).cast("double"))
    r = right.select(F.col(key), F.col(right_at).cast("double").alias("__at"), F.col(right_id).alias("__id")).filter(F.col("__at").isNotNull())
    r = r.withColumn("__r", F.struct("__at", "__id"))
    both = l.withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    part, order = [key], ["__at", "__side", F.col("__r.__id")]
    if bucket is not None:
        both = both.withColumn("__bucket", F.floor(F.col("__at") / bucket))
        ends = r.groupBy(key, F.floor(F.col("__at") / bucket).alias("__bucket")).agg(F.min("__r").alias("__first"), F.max("__r").alias("__last"))
        slots = both.select(key, "__bucket").distinct().join(ends, [key, "__bucket"], "left")
        across = Window.partitionBy(key).orderBy("__bucket")
        slots = slots.withColumn("__carry", F.last("__last", True).over(across.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__next", F.first("__first", True).over(across.rowsBetween(1, Window.unboundedFollowing)))
        both = both.join(slots.select(key, "__bucket", "__carry", "__next"), [key, "__bucket"], "left")
        part = [key, "__bucket"]
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.last("__r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if bucket is not None:
        before, after = F.coalesce(before, F.col("__carry")), F.coalesce(after, F.col("__next"))
    found = both.withColumn("__before", before).withColumn("__after", after).filter("__side = 1")
    closer = F.when(F.col("__before").isNull(), F.col("__after")).when(F.col("__after").isNull() | (F.col("__at") - F.col("__before.__at") <= F.col("__after.__at") - F.col("__at")), F.col("__before")).otherwise(F.col("__after"))
    closer = F.when(F.col("__at").isNotNull(), closer)
    return found.withColumn("__pick", closer).select(*left.columns, F.col("__pick.__id").alias("nearest_id"), F.col("__pick.__at").alias("nearest_at"))
