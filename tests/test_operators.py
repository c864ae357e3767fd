"""Operators against worked examples and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, media, text
from lodestone.operators import browse, ledgers, people, ranking
from lodestone.operators.components import connected_components
from lodestone.operators.nearest import nearest
from lodestone.operators.scope import Scope
from lodestone.streaming import cdc


def _files(spark, n=250):
    rows = [(i, "A" if i % 2 == 0 else "B", "vertical", "video", "" if i == n else "20260928120000", i) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "asset long, camera string, shape string, kind string, captured string, arrival long")


def test_pages_cover_all_rows_once(spark):
    files = _files(spark)
    for newest in (True, False):
        seen, after = [], None
        while rows := browse.page(files, after=after, limit=100, newest=newest).collect():
            seen += [r.asset for r in rows]
            after = (rows[-1].captured, rows[-1].asset)
        assert seen == list(range(1, 251))  # all dates tie, and the unknown one is last


def test_scope_and_totals(spark):
    files = _files(spark)
    assets = spark.createDataFrame([(2,), (200,), (249,)], "asset long")
    assert sorted(r.asset for r in Scope(camera="A", assets=assets).apply(files).collect()) == [2, 200]
    assert Scope(assets=assets.limit(0)).apply(files).count() == 0
    counts = browse.day_facets(files)
    total = lambda **s: browse.total(files, counts, Scope(**s)).first().total
    day = {"camera": "A", "shape": "vertical", "kind": "video", "start": "20260928", "through": "20260928235959"}
    assert total(**day) == 124
    assert total(**day, arrival_through=100) == 50
    assert total(**(day | {"through": "20260928115959"})) == 0
    with pytest.raises(ValueError):
        browse.page(files, limit=0)


def test_text(spark):
    rows = spark.createDataFrame([(1, "Pe Dunăre cu capre"), (2, "Straße ÉTÉ"), (3, None)], "id int, t string").select("id", text.words(F.col("t")).alias("w"))
    hits = lambda q: [r.id for r in rows.filter(text.matches(F.col("w"), text.query_words(q), text.ends_in_word(q))).collect()]
    assert hits("dunare cap") == [1] and hits("dun cap") == [] and hits("dun ") == [] and hits("???") == [] and hits("strasse ete") == [2]


def test_dates():
    assert dates.cover("20240101", "20241231") == ["y2024"]
    assert dates.cover("20240201", "20240229") == ["m202402"]
    assert dates.cover("20240228", "20240302") == ["d20240228", "d20240229", "d20240301", "d20240302"]
    assert dates.cover("20240302", "20240228") == []


@pytest.mark.parametrize("bucket", [None, 7.0])
def test_nearest_against_brute_force(spark, bucket):
    random.seed(3)
    left = [(random.randrange(4), i, random.choice([None, float(random.randrange(60))])) for i in range(80)]
    right = [(random.randrange(3), i, float(random.randrange(60))) for i in range(60)]
    got = {r.id: r.nearest_at for r in nearest(spark.createDataFrame(left, "k int, id int, secs double"), spark.createDataFrame(right, "k int, rid int, secs double"), "k", "secs", "secs", "rid", bucket).collect()}
    for k, i, at in left:
        own = [s for q, _, s in right if q == k] if at is not None else []
        assert got[i] == min(own, key=lambda s: (abs(s - at), s), default=None)


def test_fusion_prefers_rows_in_both_lists(spark):
    lists = [spark.createDataFrame([(1, 1), (2, 2)], "asset long, rank int"), spark.createDataFrame([(2, 1), (3, 2)], "asset long, rank int")]
    rows = ranking.fuse(lists).collect()
    assert [r.asset for r in rows] == [2, 1, 3] and rows[0].lists == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)


def test_constrained_groups_and_merging():
    near = [(a, b, 0.9) for a in range(5) for b in range(a)] + [(a, b, 0.9) for a in range(5, 10) for b in range(5, a)]
    assert list(people.constrained_groups(range(11), near).values()) == [0] * 5 + [1] * 5 + [2]
    assert list(people.constrained_groups(range(6), near[:10] + [(4, 5, 0.8)], cannot=[(5, k) for k in range(5)]).values()) == [0] * 5 + [1]
    a, c = np.array([1.0, 0.0, 0.0]), np.array([0.2, np.sqrt(0.96), 0.0])
    b = np.array([0.6, (0.6 - 0.12) / np.sqrt(0.96), 0.0])
    b[2] = np.sqrt(1 - b @ b)
    assert len(set(people.merged_groups(np.stack([a, b, c]), np.ones(3)))) == 2


def test_people(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, vector array<double>")
    got = {(r.src, r.dst) for r in people.nearest_neighbours(frame, k=3, threshold=0.2, block=17).collect()}
    sims = points @ points.T
    wanted = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and sims[i, j] >= 0.2), key=lambda j: (-sims[i, j], j))[:3]}
    assert got == wanted
    boxes = spark.createDataFrame([(1, 1, 0.7, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.8, 0.1, 0.0, 1.1, 1.0), (1, 3, 0.6, 5.0, 5.0, 6.0, 6.0)], "image long, box long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.score for r in people.kept_boxes(boxes, "image").collect()) == [0.6, 0.8]
    faces = spark.createDataFrame([(1, i, float(i), [1.0, 0.0] if i % 2 == 0 else [0.0, 1.0]) for i in range(6)], "asset long, face long, at double, vector array<double>")
    assert [r.track for r in people.tracks(faces).orderBy("face").collect()] == [0, 1, 0, 1, 0, 1]


def test_edits_and_audit(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "person int, face_key string")
    after, before = ledgers.merge_people(labels, 1, [2])
    assert sorted(r.person for r in after.collect()) == [1, 1, 3]
    restored = ledgers.undo(after, before, "face_key")
    assert ledgers.same_rows(restored, labels).first().asDict() == {"missing": 0, "extra": 0}
    assert ledgers.digest(restored, "person", "face_key").first() == ledgers.digest(labels, "person", "face_key").first()
    actions = ledgers.differences(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(2, None), (3, "q"), (4, "n")], "k int, v string"), "k", ["v"])
    assert {r.k: r.action for r in actions.collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}


def test_media(spark):
    row = spark.range(1).select(media.move(F.array(*map(F.lit, (1, 2, 3))), 2, -2).alias("m"), media.shape(F.lit(100), F.lit(101)).alias("s"), media.shape(F.lit(100), F.lit(50), F.lit(6)).alias("t"), media.frame_rate(F.lit("0/0")).alias("r")).first()
    assert (row.m, row.s, row.t, row.r) == ([3, 1, 2], "square", "vertical", 0.0)


def test_change_consumer_is_idempotent(spark, tmp_path):
    events = tmp_path / "events"
    spark.createDataFrame([(1, 10, "A", False), (2, 11, "B", False), (3, 10, "C", False)], cdc.SCHEMA).coalesce(1).write.parquet(str(events))
    target = cdc.consume(spark, str(events), f"file://{tmp_path}/root", str(tmp_path / "offsets"))
    rows = lambda: sorted(tuple(r) for r in target.current().select("asset", "camera", "arrival").collect())
    assert rows() == [(10, "C", 3), (11, "B", 2)]
    spark.createDataFrame([(4, 11, "B", True), (5, 10, "D", False)], cdc.SCHEMA).coalesce(1).write.mode("append").parquet(str(events))
    cdc.consume(spark, str(events), f"file://{tmp_path}/root", str(tmp_path / "offsets"))
    assert rows() == [(10, "D", 3)]
    before = target.pointer()
    target.apply(spark.createDataFrame([(9, 10, "X", False)], cdc.SCHEMA), before["batch"])
    assert rows() == [(10, "D", 3)] and target.pointer() == before
