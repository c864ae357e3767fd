"""Boxes, the work that they save, and rows that a search must bear."""

from __future__ import annotations

import numpy as np

from lodestone.llm import vectors


def _search(points, ids, queries, own, k=5, leaf=32):
    best = vectors.Best(own, k, np.full(len(own), -np.inf), np.full(len(own), np.iinfo(np.int64).max))
    work = vectors.search_shard(best, queries, vectors.Tree(points, ids, leaf))
    return best, work


def test_every_node_has_a_tight_box():
    rng = np.random.default_rng(1)
    points, ids = rng.integers(-50, 50, (700, 3)).astype(float), rng.permutation(700)
    tree = vectors.Tree(points, ids, 16)
    for (a, b), low, high, first, children in zip(tree.spans, tree.low, tree.high, tree.first, tree.children, strict=True):
        own = tree.order[a:b]
        assert (points[own].min(0) == low).all() and (points[own].max(0) == high).all() and ids[own].min() == first
        if children:
            spans = [tree.spans[c] for c in children]
            assert spans[0][0] == a and spans[0][1] == spans[1][0] and spans[1][1] == b and abs((spans[0][1] - a) - (b - spans[0][1])) <= 1
        else:
            assert b - a <= 16
    assert sorted(tree.order) == list(range(700)) and sum(c is None for c in tree.children) < len(tree.spans)


def test_clustered_vectors_avoid_most_products():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 400
    points = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 8 for c in centres]))
    ids = np.arange(len(points))
    asked = ids[::50]
    best, work = _search(points, ids, points[asked], asked)
    for row, q in enumerate(asked):
        scores = points @ points[q]
        wanted = sorted((-s, i) for i, s in zip(ids, scores, strict=True) if i != q)[:5]
        assert list(zip(-best.scores[row], best.names[row], strict=True)) == wanted
    assert work < 0.25 * len(asked) * len(points)


def test_equal_vectors_end_early_and_by_id():
    points = np.ones((4000, 4))
    ids = np.random.default_rng(3).permutation(4000)
    best, work = _search(points, ids, np.ones((3, 4)), np.array([0, 7, 5000]))
    assert best.names.tolist() == [[1, 2, 3, 4, 5], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4]] and work <= 3 * 3 * 32


def test_rows_that_a_search_must_bear(spark):
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(-50, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, []), (100, [float("inf"), 0.0])]
    got = [tuple(r) for r in vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()]
    usable = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and np.isfinite(v).all()]
    wanted = []
    for q in (-50, 0):
        best = sorted((-int(a @ w), i) for j, a in usable if j == q for i, w in usable if i != q)[:3]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(wanted)
