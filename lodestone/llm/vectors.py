"""Exact top-k search by KD-trees over shards.

Vectors are quantised to floor(256 * x) and compared by integer inner product. A shard (rows of
one hash bucket, bounded in number) is a KD-tree: nodes split at the median of their widest
dimension, and every node, inner ones too, has the tight bounding box and the smallest id of its
points. The largest inner product that a box allows with a query is the sum of the larger of
q * low and q * high over the dimensions. Each query goes through the tree best bound first: it
takes the open node with the largest bound, opens its children or, at a leaf, takes the products;
it is done when no open node can beat its kth score (or tie with it by a smaller id). All
queries of a block move in step, so that those at one node share its arithmetic.

Queries are held against shards block by block; no table passes through the driver. First each
query goes through a pilot, a sample of at most ``pilot`` rows and a sixteenth of the table; its
kth score there is a true lower bound and goes with the query to every shard, where it closes
most boxes before any product if vectors are clustered. Products are exact: with float64, sums of
integers below 2**53 have no rounding.

Nulls and edge cases: a vector that is null, empty, or holds a null or a non-finite component
takes no part as query or candidate, and neither do rows with a null id; vectors of other
lengths than the query's are no candidates for it; rows that share an id count as the query's own
for a query of that id, and each is a candidate of other queries; a query id that occurs more
than once is asked with each of its vectors and keeps the best scores of all. Ids below zero are
ids like others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import Scratch

SCALE = 256.0
_LAST = np.iinfo(np.int64).max


class Tree:
    """A KD-tree in arrays: ``order`` lists the points so that each node has one range of them."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        self.points, self.ids = points, ids
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        boxes = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            number = len(self.spans)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = number
                self.children[parent] = tuple(pair)
            at = self.order[start:end]
            own = points[at]
            low, high = own.min(0), own.max(0)
            boxes.append((low, high, ids[at].min()))
            self.spans.append((start, end))
            axis = int(np.argmax(high - low))
            if end - start <= leaf:
                self.children.append(None)
                continue
            middle = (end - start) // 2
            # equal points can't be told apart by place: their halves go by id
            key = own[:, axis] if high[axis] > low[axis] else ids[at]
            self.order[start:end] = at[np.argpartition(key, middle)]
            self.children.append((-1, -1))
            todo += [(start + middle, end, number, 1), (start, start + middle, number, 0)]
        self.low, self.high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])
        self.first = np.array([b[2] for b in boxes], np.int64)

    def bounds(self, queries: np.ndarray, nodes: list[int]) -> np.ndarray:
        """(queries, nodes): the largest inner product that each node's box allows."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T


class Best:
    """The k best (score, id) of each query; ties go to the smaller id. ``floor`` and
    ``floor_id`` are a kth best known from elsewhere."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> None:
        self.ids, self.k, self.floor, self.floor_id = ids, k, floor, floor_id
        self.scores = np.full((len(ids), k), -np.inf)
        self.names = np.full((len(ids), k), _LAST)

    def open(self, at: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a box with that bound and smallest id can still hold one of the k best."""
        score, name = self.scores[at, -1], self.names[at, -1]
        known = (self.floor[at] > score) | ((self.floor[at] == score) & (self.floor_id[at] < name))
        score, name = np.where(known, self.floor[at], score), np.where(known, self.floor_id[at], name)
        return (bounds > score) | ((bounds == score) & (first <= name))

    def add(self, at: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """New candidates ``names`` with (len(at), len(names)) scores; a query's own id is left out."""
        scores = np.where(names[None, :] == self.ids[at][:, None], -np.inf, scores)
        all_scores = np.concatenate([self.scores[at], scores], 1)
        all_names = np.concatenate([self.names[at], np.broadcast_to(names, scores.shape)], 1)
        order = np.lexsort((all_names, -all_scores), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(all_scores, order, 1)
        self.names[at] = np.take_along_axis(all_names, order, 1)


def search_shard(best: Best, queries: np.ndarray, tree: Tree) -> int:
    """Adds a shard's points to the best; returns the number of products that it took."""
    waiting = np.full((len(queries), len(tree.spans)), -np.inf)  # bounds of the open nodes
    waiting[:, 0] = tree.bounds(queries, [0])[:, 0]
    active, work = np.arange(len(queries)), 0
    while len(active):
        node = waiting[active].argmax(1)
        bound = waiting[active, node]
        # a node that is not worth opening ends a query, unless another has the same bound and a smaller id
        some = np.isfinite(bound)
        useful = some & best.open(active, bound, tree.first[node])
        tied = some & ~useful & best.open(active, bound, np.full(len(active), np.iinfo(np.int64).min))
        waiting[active[tied], node[tied]] = -np.inf
        chosen, at = node[useful], active[useful]
        waiting[at, chosen] = -np.inf
        for own in np.unique(chosen):
            asking = at[chosen == own]
            if tree.children[own] is None:
                members = tree.order[slice(*tree.spans[own])]
                work += len(asking) * len(members)
                best.add(asking, queries[asking] @ tree.points[members].T, tree.ids[members])
            else:
                children = list(tree.children[own])
                waiting[asking[:, None], np.array(children)[None, :]] = tree.bounds(queries[asking], children)
        active = active[useful | tied]
    return work


def _matrices(table: pa.Table, vector: str, *others: str) -> dict[int, tuple[np.ndarray, ...]]:
    """The other columns and the quantised vectors of the rows, by length of vector."""
    values = table.column(vector).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()[:-1]
    out = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[int(size)] = (*(table.column(c).to_numpy()[rows] for c in others), np.floor(SCALE * flat[starts[rows][:, None] + np.arange(size)]))
    return out


def search(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, k: int = 5, leaf: int = 128, shard: int = 32_768, block: int = 2048, pilot: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best among all other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    usable = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = scratch.save(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(usable))
    asked = scratch.save(rows.filter(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), "vector"))
    n = rows.count()
    blocks = max(1, -(-asked.count() // block))
    shards = max(1, -(-n // shard), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
    names = ["row", "query_id", "vec_id", "score"]

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and queries.num_rows:
            held = _matrices(points, "vector", "vec_id")
            for size, (row, own_id, floor, floor_id, matrix) in _matrices(queries, "vector", "row", "query_id", "floor", "floor_id").items():
                if size in held:
                    ids, own = held[size]
                    best = Best(own_id, k, floor, floor_id)
                    search_shard(best, matrix, Tree(own, ids, leaf))
                    at, column = np.nonzero(np.isfinite(best.scores))
                    out.append((row[at], own_id[at], best.names[at, column], best.scores[at, column].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    def held(points: DataFrame, shards: int, queries: DataFrame) -> DataFrame:
        """Every block of queries against every shard of the points, two at a time in a task."""
        bucket = lambda column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        a = points.withColumn("shard", bucket("vec_id", shards)).withColumn("block", each(blocks))
        b = queries.withColumn("block", bucket("row", blocks)).withColumn("shard", each(shards))
        return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(run, ", ".join(f"{c} long" for c in names))

    lowest, last = F.lit(float("-inf")), F.lit(int(_LAST)).cast("long")
    queries = asked.select("*", lowest.alias("floor"), last.alias("floor_id"))
    if (sample := min(pilot, n // 16)) > k:
        # kth bests among a bounded sample are true lower bounds; of equal scores the largest id is the worst
        first = held(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), 1, queries)
        kth = first.groupBy("row").agg(F.min(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        kth = scratch.save(kth.select("row", F.col("low.score").cast("double").alias("floor"), (-F.col("low.v")).alias("floor_id")))
        queries = asked.join(kth, "row", "left").select("row", "query_id", "vector", F.coalesce("floor", lowest).alias("floor"), F.coalesce("floor_id", last).alias("floor_id"))
    found = scratch.save(held(rows, shards, queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scratch.save(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.keep_only(out)
    return out


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
