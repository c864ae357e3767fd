"""Vector search per file, overlays, fusion, and similarity graphs on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import people, ranking
from lodestone.operators.components import connected_components
from lodestone.operators.scope import Scope
from lodestone.plans.registry import query

#: A constant query vector: component i is ((7 i) mod 11 - 5) / 20.
QUERY = [((7 * i) % 11 - 5) / 20 for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: vector[i] * ((7 * (i - 1)) % 11 - 5) / 20.0))"
_BEST = f"{{vectors}}, s AS (SELECT asset, ordinal, {_DOT} AS score FROM vectors), b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, ordinal) AS k FROM s)"


@query("vector_topk_exact", f"WITH {{vectors}} SELECT vec_id, round({_DOT}, 6) AS score FROM vectors ORDER BY {_DOT} DESC, vec_id LIMIT 20")
def _(t):
    scored = t.vectors.select("vec_id", ranking.against(F.col("vector"), QUERY).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).withColumn("score", F.round("score", 6))


@query("vector_topk_per_asset", f"WITH {_BEST} SELECT asset, ordinal, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY b.score DESC, asset LIMIT 60")
def _(t):
    return ranking.top_assets(t.vectors, QUERY).select("asset", "ordinal", F.round("score", 6).alias("score"))


@query("vector_scoped", f"WITH {_BEST}, {{files}} SELECT asset, round(score, 6) AS score FROM b WHERE k = 1 AND asset IN (SELECT asset FROM files WHERE kind = 'O') ORDER BY b.score DESC, asset LIMIT 10")
def _(t):
    inside = t.vectors.join(Scope(kind="O").apply(t.files).select("asset"), "asset", "left_semi")
    return ranking.top_assets(inside, QUERY, 10).select("asset", F.round("score", 6).alias("score"))


@query("small_scope_exact", f"WITH {_BEST} SELECT asset, round(score, 6) AS score FROM b WHERE k = 1 AND asset < 8")
def _(t):
    return ranking.top_assets(t.vectors.filter("asset < 8"), QUERY).select("asset", F.round("score", 6).alias("score"))


@query("vector_scope", "WITH {vectors}, {files} SELECT count(*) AS rows_in_scope FROM vectors WHERE asset IN (SELECT asset FROM files WHERE camera = '4-NOT SPECIFIED')")
def _(t):
    return t.vectors.join(Scope(camera="4-NOT SPECIFIED").apply(t.files).select("asset"), "asset", "left_semi").agg(F.count(F.lit(1)).alias("rows_in_scope"))


_OVER = f"{{vectors}}, o AS (SELECT asset, ordinal, vector FROM vectors WHERE asset % 7 <> 0 UNION ALL SELECT asset, ordinal, list_transform(vector, lambda x: -x) FROM vectors WHERE asset % 7 = 0 AND asset % 2 = 0), s AS (SELECT asset, ordinal, {_DOT} AS score FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, ordinal) AS k FROM s)"


def _overlaid(t):
    touched = t.vectors.filter("asset % 7 = 0").select("asset")
    delta = t.vectors.filter("asset % 14 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    return ranking.overlay(t.vectors, delta, touched)


@query("vector_overlay", f"WITH {_OVER} SELECT asset, ordinal, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY b.score DESC, asset LIMIT 60")
def _(t):
    return ranking.top_assets(_overlaid(t), QUERY).select("asset", "ordinal", F.round("score", 6).alias("score"))


@query("overlay_scope", f"WITH {_OVER}, {{files}} SELECT asset, round(score, 6) AS score FROM b WHERE k = 1 AND asset IN (SELECT asset FROM files WHERE shape = 'square') ORDER BY b.score DESC, asset LIMIT 20")
def _(t):
    inside = _overlaid(t).join(Scope(shape="square").apply(t.files).select("asset"), "asset", "left_semi")
    return ranking.top_assets(inside, QUERY, 20).select("asset", F.round("score", 6).alias("score"))


@query(
    "hybrid_rrf",
    f"""WITH {_BEST}, v AS (SELECT asset, row_number() OVER (ORDER BY score DESC, asset) AS rank FROM (SELECT * FROM b WHERE k = 1 ORDER BY score DESC, asset LIMIT 60)),
    h AS (SELECT conv_id AS asset, min(length(text)) AS n FROM conversations WHERE text LIKE '%the%' GROUP BY 1), l AS (SELECT asset, row_number() OVER (ORDER BY n, asset) AS rank FROM (SELECT * FROM h ORDER BY n, asset LIMIT 60)),
    u AS (SELECT asset, 1.0 / CAST(60 + rank AS DOUBLE) AS part, 1 AS bit FROM v UNION ALL SELECT asset, 1.0 / CAST(60 + rank AS DOUBLE), 2 FROM l)
    SELECT asset, round(sum(part), 6) AS score, CAST(sum(bit) AS INTEGER) AS lists FROM u GROUP BY asset ORDER BY round(sum(part), 12) DESC, asset LIMIT 60""",
)
def _(t):
    seen = ranking.ranked(ranking.top_assets(t.vectors, QUERY), F.desc("score"), "asset")
    spoken = t.conversations.filter(F.col("text").contains("the")).groupBy(F.col("conv_id").alias("asset")).agg(F.min(F.length("text")).alias("n"))
    return ranking.fuse([seen, ranking.ranked(spoken, "n", "asset")]).withColumn("score", F.round("score", 6))


@query("hits_to_media", f"WITH {_BEST}, {{files}}, h AS (SELECT asset, row_number() OVER (ORDER BY score DESC, asset) AS rank FROM b WHERE k = 1 ORDER BY rank LIMIT 60) SELECT h.rank, f.path FROM h JOIN files f ON h.asset = f.asset")
def _(t):
    hits = ranking.ranked(ranking.top_assets(t.vectors, QUERY), F.desc("score"), "asset")
    return t.files.join(F.broadcast(hits.select("asset", F.col("rank").cast("long").alias("rank"))), "asset").select("rank", "path")  # 60 hits at most


@query("hits_refresh_frame", f"WITH {_BEST}, {{frames}}, e AS (SELECT asset, min(frame) AS frame FROM frames GROUP BY asset) SELECT b.asset, COALESCE(e.frame, -1) AS frame FROM b LEFT JOIN e ON b.asset = e.asset WHERE k = 1 ORDER BY b.score DESC, b.asset LIMIT 60")
def _(t):
    hits = ranking.top_assets(t.vectors, QUERY)
    fresh = t.frames.join(F.broadcast(hits.select("asset")), "asset", "left_semi").groupBy("asset").agg(F.min("frame").alias("frame"))
    return hits.join(fresh, "asset", "left").select("asset", F.coalesce("frame", F.lit(-1)).alias("frame"))


@query("vectors_to_files", "WITH {vectors}, {files} SELECT v.vec_id, f.path FROM vectors v JOIN files f ON v.asset = f.asset")
def _(t):
    return t.vectors.select("vec_id", "asset").join(t.files.select("asset", "path"), "asset").select("vec_id", "path")


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS squared, len(embedding) AS n FROM embeddings")
def _(t):
    unit = ranking.normalised(F.transform("vector", lambda x: x * 3))
    return t.vectors.select("vec_id", F.round(ranking.dot(unit, unit), 4).alias("squared"), F.size("vector").cast("long").alias("n"))


@query("dot_pairs", "WITH {vectors} SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.vector[i] * b.vector[i])), 6) AS score FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def _(t):
    after = t.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    return t.vectors.select("vec_id", "vector").join(after, "vec_id").select("vec_id", F.round(ranking.dot(F.col("vector"), F.col("other")), 6).alias("score"))


_PAIRS = """{vectors}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(range(1, 65), lambda i: a.vector[i] * b.vector[i])) AS sim FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS n FROM s WHERE sim >= 0.35) WHERE n <= 10), m AS (SELECT a.src, a.dst, a.sim FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst)"""


@query("knn_pairs", f"WITH {_PAIRS} SELECT src, dst, round(sim, 6) AS sim FROM k")
def _(t):
    return people.nearest_neighbours(t.vectors, threshold=0.35).withColumn("sim", F.round("sim", 6))


@query("mutual_knn", f"WITH {_PAIRS} SELECT src, dst, round(sim, 6) AS sim FROM m")
def _(t):
    return people.mutual(people.nearest_neighbours(t.vectors, threshold=0.35)).withColumn("sim", F.round("sim", 6))


@query("components", f"WITH RECURSIVE {_PAIRS}, e AS (SELECT src AS x, dst AS y FROM m UNION ALL SELECT dst, src FROM m), r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x")
def _(t):
    return connected_components(t.spark, people.mutual(people.nearest_neighbours(t.vectors, threshold=0.35)))


@query("centroid_typicality", """WITH {vectors}, c AS (SELECT label, i, avg(vector[i]) AS m FROM vectors, range(1, 65) AS r(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY label)
SELECT v.vec_id, round(sum(v.vector[c.i] * c.m) / any_value(n.size), 6) AS typical FROM vectors v JOIN c ON v.label = c.label JOIN n ON n.label = v.label GROUP BY v.vec_id""")
def _(t):
    return people.typicality(t.vectors, "label", "vec_id").withColumn("typical", F.round("typical", 6))
