"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct runs of five words. Documents with equal sets form a class,
whose smallest id stands for it. The set's sketch has ``bands * rows`` coordinates: in round i
every element is hashed to a bin and a value that is larger than any of the rounds before; after
as many rounds as there are coordinates, each further round fills the bin of its own number, so
that every coordinate is filled after at most twice that many rounds, and equal coordinates
estimate the Jaccard similarity without bias and with the concentration of independent samples.
Classes that share a whole band are candidates: at a similarity of 0.85, 25 bands of 5 miss a
pair with probability 4e-7.

Candidates are linked if the exact similarity of their full sets reaches the threshold, without
listing the pairs of a band's bucket:

1. In each bucket every class is verified against the bucket's smallest one only (its centre).
2. Where a bucket's other classes are in one component by then, all of its links are known to
   that component's labels. The rest form groups (components of what buckets they share).
3. The classes of a group that are outside its largest component are verified against all of
   the group that are near enough in size, block by block: a block holds a bounded number of
   documents and of shingles of one range of sizes, and meets blocks of the same and the next
   range only, since sets whose sizes differ more can't be similar enough. A task takes two
   blocks and returns at most as many links as join separate components.

Components are labelled by their smallest document. Texts are shuffled only as sets of
candidates; a Bloom filter of fixed largest size keeps all other documents out of the shuffle.
Where a text, a bucket or a centre has many rows, these are dealt to several tasks. Tables
written on the way are dropped as soon as nothing reads them.

Nulls and edge cases: a text that is null or has no words has an empty set and is linked with
nothing; with fewer than five words the whole sequence is the one element. A null id is linked
with nothing and is kept. Rows that share an id are one node: their texts' links join, and each
row is returned with its own set size. Equal rows change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.common import LOWER, slices, texts
from lodestone.llm.hashing import mix, shingle_keys, word_keys
from lodestone.operators.components import connected_components
from lodestone.operators.skew import hot_keys, spread_join
from lodestone.sources.storage import Scratch

_ROUND = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


def sketch(keys: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit keys.

    Rounds are taken several at a time; values of later rounds are larger and so never replace
    those of earlier ones, which makes the result independent of that.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < 2 * size:
        step = max(1, min(2 * size - at, int(2.2 * size * np.log(size + 1)) // len(keys) + 1)) if at < size else 2 * size - at
        step = min(step, size - at) if at < size else step
        step = min(step, max(1, (1 << 20) // len(keys)))
        number = np.arange(at, at + step, dtype=np.uint64)[:, None]
        h = mix(keys[None, :] ^ mix(number * _ROUND + np.uint64(1)))
        value = (number << np.uint64(48)) | (h & _LOW)
        bins = (h >> np.uint64(48)) % np.uint64(size) if at < size else np.broadcast_to(number - np.uint64(size), h.shape)
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        at += step
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of coordinates."""
    parts = coordinates.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ROUND)
    for k in range(parts.shape[1]):
        key = mix(key * _ROUND + parts[:, k])
    return key


def shingles(text: bytes, width: int) -> np.ndarray:
    return shingle_keys(word_keys(text.translate(LOWER)), width)


def _sets(batch: pa.RecordBatch, width: int):
    for text in texts(batch):
        keys = shingles(text, width)
        yield keys, xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None


def _linked(frame: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, set_a, set_b), those whose exact similarity reaches ``percent``."""

    def run(batches):
        for batch in slices(batches):
            mask = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[place] == small).sum())
                mask.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(mask, pa.bool_()))

    return frame.select("a", "b", "set_a", "set_b").mapInArrow(run, "src long, dst long")


def joining_links(labels: list[int], left: list[np.ndarray], right: list[np.ndarray], percent: int, same: bool, columns: int = 8192) -> list[tuple[int, int]]:
    """Index pairs (left, right) of verified links that join different labels.

    ``labels`` are those of left and then of right. Shared shingles are counted exactly, as
    products of 0/1 matrices over the shingles that occur more than once, some at a time.
    """
    sets = left if same else left + right
    number, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(which, minlength=len(number)) > 1
    place = np.cumsum(common) - 1
    use = common[which]
    order = np.argsort(place[which[use]], kind="stable")
    column, row = place[which[use]][order], owner[use][order]
    n = len(left)
    shared = np.zeros((n, n if same else len(right)))
    for start in range(0, int(common.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        shared += block[:n] @ (block if same else block[n:]).T
    sizes = np.array([len(s) for s in sets], float)
    union = sizes[:n, None] + (sizes[None, :] if same else sizes[None, n:]) - shared
    hit = 100 * shared >= percent * union
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1) if same else hit), strict=True):
        x, y = root(labels[i]), root(labels[j if same else n + j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def components(docs: DataFrame, *, width: int = 5, percent: int = 85, bands: int = 25, rows: int = 5, block_docs: int = 256, block_shingles: int = 1_500_000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row, as a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def describe(batches):
        for batch in slices(batches):
            found = [(len(k), f, band_keys(sketch(k, bands * rows), bands).view(np.int64) if f else np.empty(0, np.int64)) for k, f in _sets(batch, width)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands"])

    described = scratch.save(source.mapInArrow(describe, "doc_id long, n_shingles long, print binary, bands array<long>"))
    usable = described.filter(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    classes = scratch.save(usable.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("copies")))
    common = scratch.save(hot_keys(classes, "print", "copies"))
    by_print = scratch.save(spread_join(usable.select("doc_id", "print"), classes.select("print", "rep"), "print", "doc_id", common).select("doc_id", "rep").distinct())

    # buckets with more than one class, and each bucket's smallest class as its centre
    placed = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "n")
    buckets = scratch.save(placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "n")).alias("centre")).filter("members > 1").select("key", "members", F.col("centre.id").alias("centre"), F.col("centre.n").alias("centre_n")))
    full = scratch.save(hot_keys(buckets, "key", "members"))
    members = scratch.save(spread_join(placed, buckets.drop("members"), "key", "id", full).filter("id <> centre").select("key", "id", "n", "centre", "centre_n"))
    wanted = scratch.save(members.select("id").unionByName(members.select(F.col("centre").alias("id"))).distinct())
    candidates = classes.select("print", "rep").join(wanted, F.col("rep") == F.col("id"), "left_semi")
    near = spark.sparkContext.broadcast(bloom.build(wanted, "id"))

    def resolve(batches):
        for batch in slices(batches):
            batch = batch.filter(near.value.mask(batch.column(0)))
            found = list(_sets(batch, width))
            yield pa.record_batch([batch.column(0), pa.array([f for _, f in found], pa.binary()), pa.array([k.tobytes() for k, _ in found], pa.binary())], names=["doc_id", "print", "set"])

    sets = source.mapInArrow(resolve, "doc_id long, print binary, set binary").withColumnRenamed("print", "own")
    sets = sets.join(candidates, (F.col("doc_id") == F.col("rep")) & (F.col("own") == F.col("print")))
    # rows that share an id and a text bring the same set
    sets = scratch.save(sets.groupBy("rep").agg(F.any_value("set").alias("set")))
    scratch.drop(classes, wanted, buckets, common)

    # 1: every member against its bucket's centre
    pairs = scratch.save(members.filter(100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    centres = scratch.save(hot_keys(pairs.groupBy("a").count(), "a", "count"))
    both = spread_join(pairs, sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a", "b", centres).join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    links = scratch.save(_linked(both, percent).distinct())
    scratch.drop(pairs, centres)
    # rows that share an id join the classes of their texts
    repeated = by_print.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    repeated = by_print.join(repeated, "doc_id").filter("rep <> low").select(F.col("low").alias("src"), F.col("rep").alias("dst"))
    links = links.unionByName(scratch.save(repeated))
    labels = connected_components(spark, links)

    # 2: buckets whose members, the centre aside, are still in several components
    labelled = scratch.save(members.select("key", "id", "n").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first")).filter("low < high").select("key", "first")
    rest = scratch.save(spread_join(labelled, open_keys, "key", "id", full).select("first", "id", "n", "component"))
    scratch.drop(members, labelled, full)
    if rest.limit(1).count():
        found = _within_groups(spark, scratch, rest, sets, percent, block_docs, block_shingles)
        labels = connected_components(spark, links.unionByName(found))

    # a class's label is that of the smallest document that it reaches
    own_class = scratch.save(hot_keys(by_print.groupBy("rep").count(), "rep", "count"))
    final = spread_join(by_print, labels.withColumnRenamed("node", "rep"), "rep", "doc_id", own_class, "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = described.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    out = scratch.save(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.keep_only(out)
    return out


def _upto(n: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of 0 to n - 1; an empty array for 0."""
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), make)


def _within_groups(spark: SparkSession, scratch: Scratch, rest: DataFrame, sets: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Verified links (src, dst) that join components within groups of still open buckets.

    Documents are binned by the logarithm of their size, so that those similar enough are in
    one bin or in neighbouring ones. The largest component's documents (main) are only held
    against the others.
    """
    group = connected_components(spark, rest.select(F.col("first").alias("src"), F.col("id").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    step = 1.000001 * math.log(100 / percent)  # wider by more than a rounding error
    nodes = scratch.save(rest.select("id", "n", "component").distinct().join(group, "id").withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / step).cast("int")))
    parts = scratch.save(nodes.groupBy("grp", "component", "bin").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")))
    largest = parts.groupBy("grp", "component").agg(F.sum("docs").alias("docs")).groupBy("grp").agg(F.max(F.struct("docs", F.col("component").alias("most"))).alias("top")).select("grp", F.col("top.most").alias("most"))
    largest = scratch.save(largest)
    main = F.col("component") == F.col("most")
    blocks = lambda which: F.greatest(F.ceil(F.sum(F.when(which, F.col("docs")).otherwise(0)) / block_docs), F.ceil(F.sum(F.when(which, F.col("shingles")).otherwise(0)) / block_shingles)).cast("int")
    sizes = scratch.save(parts.join(largest, "grp").groupBy("grp", "bin").agg(blocks(main).alias("m"), blocks(~main).alias("r")))
    # each bin's own number of blocks and those of the bins below and above
    sides = sizes.select("grp", F.explode(F.array(*[F.struct((F.col("bin") - d).alias("bin"), F.lit(d).alias("d"), F.col("m").alias("m"), F.col("r").alias("r")) for d in (-1, 0, 1)])).alias("s")).select("grp", "s.*")
    of = lambda c, d: F.coalesce(F.max(F.when(F.col("d") == d, F.col(c))), F.lit(0))
    around = sides.groupBy("grp", "bin").agg(*[of(c, d).alias(f"{c}{d + 1}") for c in "mr" for d in (-1, 0, 1)])
    placed = nodes.join(largest, "grp").join(around, ["grp", "bin"]).withColumn("main", main)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("m1")).otherwise(F.col("r1")).cast("long")).cast("int"))
    own, at = F.col("own"), F.col("bin")
    task = lambda bin_a, a, with_main, bin_b, b, side: F.struct(bin_a.cast("int").alias("bin_a"), a.cast("int").alias("a"), F.lit(with_main).alias("with_main"), bin_b.cast("int").alias("bin_b"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    rest_near = lambda d: _upto(F.col(f"r{d + 1}"), lambda i: task(at + d, i, True, at, own, F.lit(1)))
    main_near = lambda d: _upto(F.col(f"m{d + 1}"), lambda j: task(at, own, True, at + d, j, F.lit(0)))
    of_main = F.concat(*map(rest_near, (-1, 0, 1)))
    of_rest = F.concat(
        _upto(F.col("r1"), lambda j: task(at, F.least(own, j), False, at, F.greatest(own, j), F.when(own <= j, 0).otherwise(1))),
        _upto(F.col("r2"), lambda j: task(at, own, False, at + 1, j, F.lit(0))),
        _upto(F.col("r0"), lambda i: task(at - 1, i, False, at, own, F.lit(1))),
        *map(main_near, (-1, 0, 1)),
    )
    dealt = placed.select("id", "component", "grp", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest)).alias("t")).select("id", "component", "grp", "t.*")
    ready = dealt.join(sets.withColumnRenamed("rep", "id"), "id")

    def verify(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("side", "id", "component", "set")), strict=True))
        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        first = {c: table.column(c)[0].as_py() for c in ("with_main", "bin_a", "a", "bin_b", "b")}
        same = not first["with_main"] and (first["bin_a"], first["a"]) == (first["bin_b"], first["b"])
        found = []
        if left and (same or right):
            keys = lambda side: [np.frombuffer(r[3], np.uint64) for r in side]
            found = joining_links([r[2] for r in left] + [r[2] for r in right], keys(left), keys(right), percent, same)
        other = left if same else right
        return pa.table([pa.array([left[i][1] for i, _ in found], pa.int64()), pa.array([other[j][1] for _, j in found], pa.int64())], names=["src", "dst"])

    return scratch.save(ready.groupBy("grp", "bin_a", "a", "with_main", "bin_b", "b").applyInArrow(verify, "src long, dst long"))


def keep(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group: the smallest id, with all columns; null ids are kept.

    Rows that repeat an id stay or go together. Only rows whose id may have to go take part in
    the exact join; the others pass from the scan alone.
    """
    own = "__near_copies_id"
    while own in docs.columns or f"{own}_gone" in docs.columns:
        own += "_"
    gone_id = f"{own}_gone"
    found = components(docs, **settings)
    gone = Scratch(docs.sparkSession, "near-copies-gone").save(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    named = docs.withColumn(own, F.col("doc_id").cast("long"))
    filter_ = bloom.build(gone, gone_id)
    maybe = bloom.matching(named, own, filter_).join(gone, F.col(own) == F.col(gone_id), "left_anti")
    return bloom.matching(named, own, filter_, inside=False).unionByName(maybe).drop(own)


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN words IS NULL OR len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), c AS (
  SELECT shingles, min(doc_id) AS rep, len(shingles) AS n FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0) GROUP BY shingles
), m AS (
  SELECT s.doc_id, c.rep FROM s JOIN c ON list_sort(s.shingles) = c.shingles
), e AS (
  SELECT rep, n, unnest(shingles) AS shingle FROM c
), p AS (
  SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(x, y) AS (
  SELECT rep, rep FROM c UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), l AS (
  SELECT x AS rep, min(y) AS component FROM r GROUP BY x
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, COALESCE(l.component, s.doc_id) AS component_id, COALESCE(l.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON s.doc_id = m.doc_id LEFT JOIN l ON m.rep = l.rep
"""
