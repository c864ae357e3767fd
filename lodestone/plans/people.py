"""Identities: divisions, counts, labels, suggestions, moments, votes, edits with undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import people
from lodestone.operators.ranking import dot, first_per, normalised, placed
from lodestone.plans.registry import query


@query("people_division", "SELECT l_orderkey AS asset FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2")
def _(t):
    wanted = [1, 2]
    return t.lineitem.filter(F.col("l_suppkey").isin(wanted)).groupBy(F.col("l_orderkey").alias("asset")).agg(F.countDistinct("l_suppkey").alias("n")).filter(F.col("n") == len(wanted)).select("asset")


@query("people_counts", "SELECT l_suppkey AS person, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_returnflag = 'R') AS suggested, count(DISTINCT l_orderkey) AS media FROM lineitem GROUP BY l_suppkey")
def _(t):
    flag = lambda v: F.count(F.when(F.col("l_returnflag") == v, 1))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("person")).agg(flag("A").alias("confirmed"), flag("R").alias("suggested"), F.countDistinct("l_orderkey").alias("media"))


_GROUPS = "g AS (SELECT l_partkey % 97 AS grp, count(*) AS size, count(DISTINCT l_orderkey) AS media, count(*) FILTER (l_returnflag = 'N') AS own FROM lineitem GROUP BY 1)"


def _groups(t):
    return t.lineitem.groupBy((F.col("l_partkey") % 97).alias("grp")).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("l_orderkey").alias("media"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("own"))


@query("group_review", f"WITH {_GROUPS} SELECT g.grp, size, media, p_name AS cover FROM g LEFT JOIN part ON p_partkey = g.grp WHERE media >= 2 AND own * 4 >= size")
def _(t):
    cover = t.part.select(F.col("p_partkey").alias("grp"), F.col("p_name").alias("cover"))
    return _groups(t).filter("media >= 2 AND own * 4 >= size").join(cover, "grp", "left").select("grp", "size", "media", "cover")


@query("group_order", f"WITH {_GROUPS} SELECT grp, media, size FROM g ORDER BY media DESC, size DESC, grp LIMIT 30")
def _(t):
    return _groups(t).orderBy(F.desc("media"), F.desc("size"), "grp").limit(30).select("grp", "media", "size")


@query("people_order_all", "SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS place FROM customer")
def _(t):
    return placed(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), F.lower("name"), "id")


@query("name_match", "SELECT c_custkey AS id FROM customer WHERE lower(c_name) LIKE '%0012%'")
def _(t):
    return t.customer.filter(F.lower("c_name").contains("0012")).select(F.col("c_custkey").alias("id"))


@query("group_counts_distinct", "SELECT count(DISTINCT l_suppkey) AS people, count(DISTINCT l_partkey) AS groups FROM lineitem")
def _(t):
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("people"), F.countDistinct("l_partkey").alias("groups"))


_BOXES = "b AS (SELECT vec_id AS face, vec_id % 50 AS asset, least(embedding[1], embedding[2]) AS x1, greatest(embedding[1], embedding[2]) AS x2, least(embedding[3], embedding[4]) AS y1, greatest(embedding[3], embedding[4]) AS y2 FROM embeddings)"


def _boxes(t):
    v = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("face"), (F.col("vec_id") % 50).alias("asset"), F.least(v[0], v[1]).cast("double").alias("x1"), F.greatest(v[0], v[1]).cast("double").alias("x2"), F.least(v[2], v[3]).cast("double").alias("y1"), F.greatest(v[2], v[3]).cast("double").alias("y2"), F.round(v[4].cast("double"), 6).alias("score"))


_IOU = """{boxes}, d AS (SELECT face, asset, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, CAST(y1 AS DOUBLE) AS y1, CAST(y2 AS DOUBLE) AS y2 FROM b),
j AS (SELECT l.face AS label, f.face, greatest(0, least(l.x2, f.x2) - greatest(l.x1, f.x1)) * greatest(0, least(l.y2, f.y2) - greatest(l.y1, f.y1)) AS i, (l.x2 - l.x1) * (l.y2 - l.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) AS s FROM d l JOIN d f ON l.asset = f.asset AND l.face <> f.face),
o AS (SELECT label, face, CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END AS overlap FROM j)""".replace("{boxes}", _BOXES)


@query("iou_label_match", f"WITH {_IOU} SELECT label, face, round(overlap, 4) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY overlap DESC, face) AS k FROM o WHERE overlap >= 0.3) WHERE k = 1")
def _(t):
    boxes = _boxes(t).drop("score")
    labels, faces = (boxes.select("asset", *[F.col(c).alias(p + c) for c in ("face", "x1", "x2", "y1", "y2")]) for p in ("l_", "f_"))
    pairs = people.overlapping(labels, faces, "asset", 0.3).filter("l_face <> f_face")
    return first_per(pairs, "l_face", F.desc("overlap"), "f_face").select(F.col("l_face").alias("label"), F.col("f_face").alias("face"), F.round("overlap", 4).alias("overlap"))


@query("label_resolution", "SELECT l_suppkey AS person, CASE WHEN l_returnflag = 'A' THEN 'is' ELSE 'not' END AS verdict, count(*) AS labels FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_returnflag IN ('A', 'R') GROUP BY ALL")
def _(t):
    known = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    verdict = F.when(F.col("l_returnflag") == "A", "is").otherwise("not")
    return t.lineitem.filter("l_returnflag IN ('A', 'R')").join(known, "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("person"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("labels"))


@query("suggest_person", """WITH {vectors}, s AS (SELECT f.vec_id AS face, e.label AS person, max(list_sum(list_transform(range(1, 65), lambda i: f.vector[i] * e.vector[i]))) AS sim FROM vectors f JOIN vectors e ON f.vec_id >= 100 AND e.vec_id < 100 GROUP BY f.vec_id, e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY sim DESC, person) AS n, lead(sim) OVER (PARTITION BY face ORDER BY sim DESC, person) AS next FROM s) SELECT face, person, round(sim, 6) AS sim FROM r WHERE n = 1 AND sim >= 0.25 AND (next IS NULL OR sim - next >= 0.05)""")
def _(t):
    examples = t.vectors.filter("vec_id < 100").select(F.col("label").alias("person"), "vector")
    found = people.suggest(t.vectors.filter("vec_id >= 100").select(F.col("vec_id").alias("face"), "vector"), examples, 0.25, 0.05)
    return found.select("face", "person", F.round("sim", 6).alias("sim"))


@query("suggest_person_all", """WITH {vectors}, s AS (SELECT f.vec_id AS face, e.label AS person, max(list_sum(list_transform(range(1, 65), lambda i: f.vector[65 - i] * e.vector[i]))) AS sim FROM vectors f CROSS JOIN vectors e GROUP BY f.vec_id, e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY sim DESC, person) AS n, lead(sim) OVER (PARTITION BY face ORDER BY sim DESC, person) AS next FROM s) SELECT face, person, round(sim, 6) AS sim FROM r WHERE n = 1 AND sim >= 0.25 AND (next IS NULL OR sim - next >= 0.05)""")
def _(t):
    # every vector is an example of its class; the faces are all vectors read backwards
    examples = t.vectors.select(F.col("label").alias("person"), "vector")
    found = people.suggest(t.vectors.select(F.col("vec_id").alias("face"), F.reverse("vector").alias("vector")), examples, 0.25, 0.05)
    return found.select("face", "person", F.round("sim", 6).alias("sim"))


@query("same_moment", "WITH {vectors} SELECT a.vec_id AS face, max(round(list_sum(list_transform(range(1, 65), lambda i: a.vector[i] * b.vector[i])), 6)) AS sim FROM vectors a JOIN vectors b ON a.label = b.label AND abs(a.vec_id - b.vec_id) <= 20 AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def _(t):
    # the time condition is cut into buckets as wide as it reaches, so that a person's rows spread
    width = 20
    left = t.vectors.select("label", F.col("vec_id").alias("face"), "vector", F.floor(F.col("vec_id") / width).alias("slot"))
    right = t.vectors.select("label", F.col("vec_id").alias("other"), F.col("vector").alias("v"), F.explode(F.array(*[F.floor(F.col("vec_id") / width) + d for d in (-1, 0, 1)])).alias("slot"))
    pairs = left.join(right, ["label", "slot"]).filter((F.abs(F.col("face") - F.col("other")) <= width) & (F.col("face") != F.col("other")))
    return pairs.groupBy("face").agg(F.max(F.round(dot(F.col("vector"), F.col("v")), 6)).alias("sim"))


@query("track_vote", "SELECT asset, track, person AS track_person FROM (SELECT l_orderkey AS asset, l_linenumber % 2 AS track, l_suppkey AS person, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_returnflag = 'A' DESC, l_quantity DESC, l_linenumber, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1")
def _(t):
    faces = t.lineitem.select(F.col("l_orderkey").alias("asset"), (F.col("l_linenumber") % 2).alias("track"), F.col("l_linenumber").alias("face"), F.col("l_suppkey").alias("person"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("suggested").alias("source"), F.col("l_quantity").alias("sim"))
    return people.track_votes(faces).select("asset", "track", "track_person").distinct()


@query("must_link_pairs", "SELECT prev, face FROM (SELECT lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev, l_linenumber AS face, l_orderkey FROM lineitem) WHERE prev IS NOT NULL")
def _(t):
    from pyspark.sql import Window

    lag = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return t.lineitem.select(lag.alias("prev"), F.col("l_linenumber").alias("face")).filter("prev IS NOT NULL")


@query("representatives_top3", "SELECT l_orderkey AS asset, l_linenumber AS face FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_discount DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def _(t):
    return first_per(t.lineitem, "l_orderkey", F.desc(F.col("l_quantity") * F.col("l_discount")), "l_linenumber", n=3).select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("face"))


@query("face_reliable", "SELECT l_orderkey AS asset, l_linenumber AS face FROM lineitem WHERE l_discount * 10 >= 0.6 AND l_quantity >= 16 AND l_tax * 10 >= 0.25 AND l_quantity >= 17")
def _(t):
    c = F.col
    return t.lineitem.filter(people.reliable(c("l_discount") * 10, c("l_quantity"), c("l_tax") * 10, c("l_quantity"))).select(c("l_orderkey").alias("asset"), c("l_linenumber").alias("face"))


@query("face_rank", "SELECT p_partkey AS face, round(p_size / 50.0 * least(1.0, p_retailprice / 1000 / 64) * (p_partkey % 10) / 10.0, 4) AS rank FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("face"), F.round(people.quality_rank(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 10) / 10.0), 4).alias("rank"))


@query("review_faces", "SELECT l_orderkey AS face, l_quantity AS typical FROM lineitem WHERE l_suppkey = 7 AND l_linenumber = 1 ORDER BY l_quantity DESC, l_orderkey LIMIT 20")
def _(t):
    return t.lineitem.filter("l_suppkey = 7 AND l_linenumber = 1").orderBy(F.desc("l_quantity"), "l_orderkey").limit(20).select(F.col("l_orderkey").alias("face"), F.col("l_quantity").alias("typical"))


@query("people_merge", "SELECT CASE WHEN l_suppkey IN (3, 4) THEN 2 ELSE l_suppkey END AS person, count(*) AS labels FROM lineitem GROUP BY 1")
def _(t):
    from lodestone.operators.ledgers import merge_people

    labels = t.lineitem.select(F.col("l_suppkey").alias("person"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")]).alias("face_key"))
    after, _ = merge_people(labels, into=2, others=[3, 4])
    return after.groupBy("person").agg(F.count(F.lit(1)).alias("labels"))


@query("people_undo", "SELECT l_suppkey AS person, count(*) AS labels FROM lineitem GROUP BY 1")
def _(t):
    from lodestone.operators.ledgers import merge_people, undo

    labels = t.lineitem.select(F.col("l_suppkey").alias("person"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")]).alias("face_key"))
    after, before = merge_people(labels, into=2, others=[3, 4])
    return undo(after, before, "face_key").groupBy("person").agg(F.count(F.lit(1)).alias("labels"))


_NMS = """WITH RECURSIVE d AS (SELECT vec_id AS box, vec_id % 50 AS asset, CAST(least(embedding[1], embedding[2]) AS DOUBLE) AS x1, CAST(greatest(embedding[1], embedding[2]) AS DOUBLE) AS x2, CAST(least(embedding[3], embedding[4]) AS DOUBLE) AS y1, CAST(greatest(embedding[3], embedding[4]) AS DOUBLE) AS y2, round(CAST(embedding[5] AS DOUBLE), 6) AS score FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, box) AS n FROM d),
r(asset, n, box, score, ok, kept) AS (SELECT asset, n, box, score, true, [[x1, y1, x2, y2]] FROM o WHERE n = 1
UNION ALL SELECT asset, n, box, score, ok, CASE WHEN ok THEN list_append(kept, here) ELSE kept END FROM (
  SELECT o.asset, o.n, o.box, o.score, r.kept, [o.x1, o.y1, o.x2, o.y2] AS here, len(list_filter(list_transform(r.kept, lambda k: [greatest(0, least(k[3], o.x2) - greatest(k[1], o.x1)) * greatest(0, least(k[4], o.y2) - greatest(k[2], o.y1)), (k[3] - k[1]) * (k[4] - k[2]) + (o.x2 - o.x1) * (o.y2 - o.y1)]), lambda m: m[2] - m[1] > 0 AND m[1] / (m[2] - m[1]) > 0.4)) = 0 AS ok
  FROM r JOIN o ON o.asset = r.asset AND o.n = r.n + 1))
SELECT asset, box, score FROM r WHERE ok"""


@query("nms", _NMS)
def _(t):
    return people.kept_boxes(_boxes(t).withColumnRenamed("face", "box"), "asset").select("asset", "box", "score")


_TRACKS = """WITH RECURSIVE {vectors}, u AS (SELECT vec_id AS face, asset, ordinal, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS v FROM vectors),
o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ordinal, face) AS n FROM u),
r(asset, face, n, track, centres) AS (SELECT asset, face, n, 0, [v] FROM o WHERE n = 1
UNION ALL SELECT asset, face, n, CASE WHEN list_max(sims) >= 0.2 THEN best - 1 ELSE len(centres) END,
  CASE WHEN list_max(sims) >= 0.2 THEN list_transform(range(1, len(centres) + 1), lambda i: CASE WHEN i = best THEN list_transform(range(1, 65), lambda j: (centres[i][j] + v[j]) / sqrt(list_sum(list_transform(range(1, 65), lambda k: (centres[i][k] + v[k]) * (centres[i][k] + v[k]))))) ELSE centres[i] END) ELSE list_append(centres, v) END
  FROM (SELECT *, list_position(sims, list_max(sims)) AS best FROM (SELECT o.asset, o.face, o.n, o.v, r.centres, list_transform(r.centres, lambda c: list_sum(list_transform(range(1, 65), lambda j: c[j] * o.v[j]))) AS sims FROM r JOIN o ON o.asset = r.asset AND o.n = r.n + 1)))
SELECT asset, face, CAST(track AS INTEGER) AS track FROM r"""


@query("tracks", _TRACKS)
def _(t):
    return people.tracks(t.vectors.select("asset", F.col("vec_id").alias("face"), F.col("ordinal").alias("at"), normalised(F.col("vector")).alias("vector")), 0.2)
