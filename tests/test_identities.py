"""The identity rules against plain loops on random tables, and worked cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import identities, people

FACES = "face long, asset long, at double, x1 double, y1 double, x2 double, y2 double, norm double, track int, representative boolean, reliable boolean, vector array<double>"
LABELS = "label long, asset long, at double, x1 double, y1 double, x2 double, y2 double, person long, verdict string"


def _world(seed):
    rng, numbers = random.Random(seed), np.random.default_rng(seed)
    centres = numbers.normal(size=(9, 8))
    faces, media = [], []
    for asset in range(26):
        video = asset % 2 == 0
        media.append((asset, "video" if video else "image", None if asset % 11 == 5 else float(rng.randrange(5) * 50)))
        for k in range(rng.randrange(1, 7)):
            v = centres[rng.randrange(9)] + numbers.normal(size=8) * rng.choice([0.15, 0.45, 0.8])
            x = rng.randrange(4)
            faces.append((len(faces) + 1, asset, k * 0.2 if video else None, float(x), 0.0, x + 2.0, 2.0, rng.choice([16.0, 18.0, 25.0]), k % 3 if video else k, rng.random() < 0.8, rng.random() < 0.9, (v / np.linalg.norm(v)).tolist()))
    labels = []
    for n in range(34):
        f = rng.choice(faces)
        labels.append((n, f[1], None if f[2] is None else f[2] + rng.choice([0.0, 0.1, -0.2, 0.3]), f[3] + rng.choice([0, 0.3, 1.5]), f[4], f[5], f[6], rng.randrange(6), rng.choice(["confirmed", "confirmed", "rejected", "other"])))
    return faces, media, [(p,) for p in range(5)], labels


def _iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / whole if whole > 0 else 0.0


def _expected(faces, media, people_, labels):
    by = {f[0]: f for f in faces}
    vec = {f[0]: np.array(f[11]) for f in faces}
    kind, when = {m[0]: m[1] for m in media}, {m[0]: m[2] for m in media}
    confirmed, rejected = {}, set()
    for _, asset, at, *box, person, verdict in labels:
        if (person,) not in people_:
            continue
        fits = [(_iou(box, f[3:7]), f[0]) for f in faces if f[1] == asset and (f[2] is None if at is None else f[2] is not None and abs(f[2] - at) <= 0.25)]
        if fits and max(fits)[0] >= 0.5:
            if verdict == "confirmed":
                confirmed[max(fits)[1]] = person
            elif verdict == "rejected":
                rejected.add((max(fits)[1], person))
    seeds = [f[0] for f in faces if f[9] and f[10] and f[7] >= 17]
    out = {f: (p, "confirmed", None) for f, p in confirmed.items()}
    for f in seeds:
        if f in confirmed:
            continue
        best = sorted((-max(float(vec[f] @ vec[e]) for e, q in confirmed.items() if q == p), p) for p in sorted(set(confirmed.values())) if (f, p) not in rejected)
        if best and -best[0][0] >= 0.45 and (len(best) < 2 or best[1][0] - best[0][0] >= 0.08):
            out[f] = (best[0][1], "suggested", -best[0][0])
    for f, (p, source, sim) in list(out.items()):
        if source == "suggested" and sim < 0.65:
            a = by[f][1]
            for e, q in confirmed.items():
                b = by[e][1]
                near = b == a and kind[a] == "video" or b != a and kind[a] == kind[b] == "image" and when[a] is not None and when[b] is not None and abs(when[a] - when[b]) <= 60
                if q == p and near and vec[f] @ vec[e] >= 0.5:
                    out[f] = (p, "moment", sim)
    before = dict(out)
    for key in {(f[1], f[8]) for f in faces}:
        members = sorted(f[0] for f in faces if (f[1], f[8]) == key)
        own = [(m, *before[m]) for m in members if m in before]
        if not own:
            continue
        sure = [o for o in own if o[2] == "confirmed"]
        person = sure[0][1] if sure else min(own, key=lambda o: (-(o[3] or 0), o[0]))[1]
        settled = bool(sure) or any(o[1] == person and (o[2] == "moment" or o[2] == "suggested" and o[3] >= 0.65) for o in own)
        for m in members:
            if (m, person) not in rejected and (m not in before or settled and before[m][1] == "suggested" and before[m][0] == person and before[m][2] < 0.65):
                out[m] = (person, "track", None)
    rest = [f for f in seeds if f not in out]
    sims = {(a, b): float(vec[a] @ vec[b]) for a in rest for b in rest if a != b}
    top = {a: set(sorted((b for b in rest if b != a and sims[a, b] >= 0.5), key=lambda b: (-sims[a, b], b))[:10]) for a in rest}
    group = {f: f for f in rest}

    def unite(a, b):
        low, high = sorted((group[a], group[b]))
        group.update({f: low for f in rest if group[f] == high})

    for key in {(by[f][1], by[f][8]) for f in rest}:
        same = [f for f in rest if (by[f][1], by[f][8]) == key]
        for a, b in zip(same, same[1:], strict=False):
            unite(a, b)
    for a in rest:
        for b in top[a]:
            if a in top[b]:
                unite(a, b)
    for _ in range(3):
        names = sorted(set(group.values()))
        total = {g: sum(vec[f] for f in rest if group[f] == g) for g in names}
        cosine = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        pairs = []
        for g in names:
            near = sorted(((-cosine(total[g], total[h]), h) for h in names if h != g))[:10]
            pairs += [(s, g, h) for s, h in near if -s >= 0.55]
        moved = False
        for _, g, h in sorted(pairs):
            g, h = (next(group[f] for f in rest if f == x) for x in (g, h))
            if g != h and cosine(total[min(g, h)], total[max(g, h)]) >= 0.55:
                total[min(g, h)] = total[g] + total[h]
                unite(g, h)
                moved = True
        if not moved:
            break
    typical = {f: float(vec[f] @ (m := sum(vec[x] for x in rest if group[x] == group[f])) / np.linalg.norm(m)) for f in rest}
    return out, group, typical


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recompute_against_plain_loops(spark, seed):
    faces, media, people_, labels = _world(seed)
    made = identities.recompute(spark.createDataFrame(faces, FACES), spark.createDataFrame(media, "asset long, kind string, captured double"), spark.createDataFrame(people_, "person long"), spark.createDataFrame(labels, LABELS))
    out, group, typical = _expected(faces, media, people_, labels)
    near = lambda x: None if x is None else round(x, 6)
    assert {r.face: (r.person, r.source, near(r.sim)) for r in made.assignments.collect()} == {f: (p, s, near(x)) for f, (p, s, x) in out.items()}
    rows = made.groups.collect()
    assert {r.face: r.grp for r in rows} == group and {r.face: near(r.typical) for r in rows} == {f: near(t) for f, t in typical.items()}


def test_no_rows(spark):
    made = identities.recompute(spark.createDataFrame([], FACES), spark.createDataFrame([], "asset long, kind string, captured double"), spark.createDataFrame([], "person long"), spark.createDataFrame([], LABELS))
    assert made.assignments.count() == made.groups.count() == 0


def test_tracks_move_their_centres(spark):
    rng = np.random.default_rng(5)
    rows = []
    for asset in range(40):
        for k in range(12):
            v = rng.normal(size=3) + [1.5, 0, 0]
            rows.append((asset, 100 * asset + k, None if k % 6 == 5 else float(rng.integers(5)), (v / np.linalg.norm(v)).tolist()))
    wanted = {}
    for asset in range(40):
        centres = []
        for _, face, _, v in sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            sims = [float(np.dot(c, v)) for c in centres]
            if sims and max(sims) >= 0.55:
                best = sims.index(max(sims))
                centres[best] = (centres[best] + np.array(v)) / np.linalg.norm(centres[best] + np.array(v))
            else:
                best = len(centres)
                centres.append(np.array(v))
            wanted[face] = best
    got = people.tracks(spark.createDataFrame(rows, "asset long, face long, at double, vector array<double>"))
    assert {r.face: r.track for r in got.collect()} == wanted


def test_merging_goes_by_the_cosine_of_sums():
    one, two = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert people.merged_groups(np.stack([(one + two) / 2, (one + two) / 2]), np.array([2, 2])) == [0, 0]
    assert people.merged_groups(np.stack([one, one, two]), np.ones(3), cannot=[(0, 1)]) == [0, 1, 2]


def test_groups_under_constraints(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(60, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, vector array<double>")
    pairs = lambda n: [tuple(map(int, rng.choice(60, 2, replace=False))) for _ in range(n)]
    must, cannot = pairs(5), pairs(25)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    near = [(r.src, r.dst, r.sim) for r in people.mutual(people.nearest_neighbours(vectors, 10, 0.5)).collect()]
    label = people.constrained_groups(range(60), near, must, cannot)
    first = {}
    for f, g in label.items():
        first.setdefault(g, f)
    got = {r.vec_id: r.grp for r in people.grouped(vectors, frame(must), frame(cannot)).collect()}
    assert got == {f: first[g] for f, g in label.items()}
    forced = people.constrained_groups(range(60), [], must)
    assert all(got[a] != got[b] or forced[a] == forced[b] for a, b in cannot if label[a] != label[b])
    assert people.grouped(vectors, frame(must)).groupBy("grp").agg(F.count("*")).count() <= len(first)
