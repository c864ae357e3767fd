"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import hot_keys, spread_join
from lodestone.sources.storage import Scratch


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (src, dst).

    Each round hooks every node to its smallest neighbour, if that is smaller (a map-side
    combined aggregate), follows the hooks once more, and contracts the edges to the hooked
    nodes. Nodes that stay are smaller than all their neighbours, so that at most half of the
    nodes with edges are left and the rounds come to an end; edges inside a contracted node
    vanish. Rows of a hub are spread over several tasks. Every round's edges and hooks are
    written to the shared scratch folder, and dropped when they are no longer read. Nodes
    without edges have no row. Self-loops and repeated edges do no harm; null ends are dropped.
    """
    scratch = Scratch(spark, "components")
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    alone = scratch.save(ends.filter("src = dst").select(F.col("src").alias("node")).distinct())
    left = scratch.save(ends.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    hooks: list[DataFrame] = []
    while left.limit(1).count():
        degrees = left.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count()
        hubs = scratch.save(hot_keys(degrees, "node", "count"))
        # the smaller end of an edge needs no row of its own unless it is some edge's larger end
        down = scratch.save(left.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("low")))
        further = down.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        hooks.append(scratch.save(spread_join(down, further, "low", "node", hubs.withColumnRenamed("node", "low"), "left").select("node", F.coalesce("lower", "low").alias("to"))))
        contracted = left
        for end, other in (("src", "dst"), ("dst", "src")):
            moved = hooks[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
            contracted = spread_join(contracted, moved, end, other, hubs.withColumnRenamed("node", end), "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        new = scratch.save(contracted.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        scratch.drop(left, down, hubs)
        left = new
    if not hooks:
        return alone.select("node", F.col("node").alias("component"))
    # a node that is hooked in one round may be a node of later rounds through what it was hooked to
    labels = hooks[0].select("node", F.col("to").alias("component"))
    for later in hooks[1:]:
        large = scratch.save(hot_keys(labels.groupBy("component").count(), "component", "count"))
        followed = spread_join(labels, later.select(F.col("node").alias("component"), "to"), "component", "node", large, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.save(followed.unionByName(later.select("node", F.col("to").alias("component")).join(labels.select("node"), "node", "left_anti")))
    roots = labels.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    singles = alone.join(labels.select("node").unionByName(roots.select("node")), "node", "left_anti").withColumn("component", F.col("node"))
    out = scratch.save(labels.unionByName(roots).unionByName(singles))
    scratch.keep_only(out)
    return out
