"""Folders as tables, snapshots and restores, detector arithmetic, against small cases and plain loops."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import faces
from lodestone.sources import files, snapshots


def test_media_scan(spark, tmp_path):
    for name in ("a/x.MP4", "a/b/y.jpg", "a/.hidden/z.jpg", "a/.z.jpg", "a/notes.txt", "c/w.heic", "a/noext"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = files.media_files(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/a/b", f"file://{tmp_path}/c", f"file://{tmp_path}/gone"])
    assert sorted((r.name, r.kind, r.bytes) for r in found.collect()) == [("w.heic", "image", 5), ("x.MP4", "video", 5), ("y.jpg", "image", 5)]
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    path = found.filter("name = 'y.jpg'").first().path
    rows = files.with_policy(found, spark.createDataFrame([(path, "skip")], "path string, policy string")).collect()
    assert [r.path for r in rows] == sorted(r.path for r in rows) and {r.name: r.policy for r in rows} == {"x.MP4": "keep", "y.jpg": "skip", "w.heic": "keep"}
    assert files.media_files(spark, [f"file://{tmp_path}/gone"]).count() == 0


def test_vectors_and_documents(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(4.0))
    np.save(tmp_path / "many.npy", np.ones((3, 4), np.float32))
    rows = files.npy_vectors(spark, f"file://{tmp_path}", 4).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.row, r.vector) for r in rows) == [("many.npy", k, [1.0] * 4) for k in range(3)] + [("one.npy", 0, [0.0, 1.0, 2.0, 3.0])]
    np.save(tmp_path / "bad.npy", np.array([1.0, np.nan, 0.0, 0.0]))
    with pytest.raises(Exception, match="finite"):
        files.npy_vectors(spark, f"file://{tmp_path}", 4).collect()
    said = tmp_path / "said"
    said.mkdir()
    (said / "30.json").write_text(json.dumps({"transcript": {"segments": [{"start": 1, "end": 2, "text": "a"}, {"start": 2, "end": 3, "text": "b"}]}}))
    (said / "notes.json").write_text(json.dumps({"transcript": {"segments": [{"start": 1, "end": 2, "text": "no"}]}}))
    assert [tuple(r) for r in files.transcripts(spark, f"file://{said}").orderBy("start").collect()] == [(30, 1.0, 2.0, "a"), (30, 2.0, 3.0, "b")]
    (tmp_path / "samples.json").write_text(json.dumps([{"path": "p", "kind": "video", "timestamp": 2.0, "frame": "f2"}, {"path": "p", "kind": "video", "timestamp": 1.0, "frame": "f1"}]))
    (tmp_path / "meta.json").write_text(json.dumps([{"path": "p", "metadata": {"date": "d"}}]))
    row = files.manifest(spark, f"file://{tmp_path}/samples.json", f"file://{tmp_path}/meta.json").first()
    assert [f.frame for f in row.frames] == ["f1", "f2"] and row.metadata == {"date": "d"}
    (tmp_path / "inventory.json").write_text(json.dumps({"files": [{"path": "a", "kind": "video", "probe": {"x": 1}}, {"path": "b", "error": "bad"}]}))
    assert [(r.path, json.loads(r.probe)) for r in files.inventory(spark, f"file://{tmp_path}/inventory.json").collect()] == [("a", {"x": 1})]
    events = tmp_path / "events"
    events.mkdir()
    for name, value in (("1", "old"), ("2", "new"), ("3", "seen")):
        (events / f"{name}.json").write_text(json.dumps({"asset": "a", "field": "tag", "value": value}))
    ledger, renamed = spark.createDataFrame([("3.json",)], "file string"), spark.createDataFrame([("a", "A")], "old string, asset string")
    assert [tuple(r) for r in files.new_annotation_events(spark, f"file://{events}", ledger, renamed).collect()] == [("A", "tag", "new", "2.json")]
    for name, at in (("x", "2024"), ("y", None), ("z", "2025")):
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / f"{name}.json").write_text(json.dumps({"asset": name, "captured": at}))
    assert [r.asset for r in files.receipts(spark, f"file://{tmp_path}/r", "asset string, captured string").collect()] == ["z", "x", "y"]


def test_requests(spark):
    lines = [("{\"query\": \" goats \", \"mode\": \"speech\", \"limit\": 5}",), ("{\"query\": \"\"}",), ("not json",), ("[1]",), ("{\"query\": \"x\", \"mode\": \"all\"}",), ("{\"query\": \"x\", \"limit\": 61}",), (json.dumps({"query": "y" * 2001}),), (None,), ("{\"query\": \"ok\"}",)]
    rows = files.requests(spark.createDataFrame(lines, "value string")).collect()
    assert [(r["query"], r["mode"], r["limit"]) for r in rows if r.error is None] == [("goats", "speech", 5), ("ok", "both", 60)]
    assert [bool(r.error) for r in rows] == [False] + [True] * 7 + [False]


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    table = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    first = store.snapshot(table, ["id", "v"], "lib", 1, "t")
    assert store.snapshot(table.limit(0), ["id", "v"], "lib", 1, "t") == first and first["rows"] == 2
    assert store.upsert(table.filter("id = 2"), "id", ["id", "v"]) == first
    second = store.upsert(spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), "id", ["id", "v"])
    assert sorted(map(tuple, store.current().collect())) == [(1, "a"), (2, "b"), (3, "c")] and second["folder"] != first["folder"]
    out = snapshots.restore(spark, store, first, f"file://{tmp_path}/back", ["id", "v"])
    assert out["digest"] == first["digest"] and spark.read.parquet(f"file://{tmp_path}/back/rows").count() == 2
    with pytest.raises(FileExistsError):
        snapshots.restore(spark, store, first, f"file://{tmp_path}/back", ["id", "v"])
    with pytest.raises(ValueError):
        snapshots.restore(spark, store, {**first, "digest": "0"}, f"file://{tmp_path}/wrong", ["id", "v"])
    broken = {0: lambda t: t.withColumn("n", F.length("v")), 1: lambda t: t.withColumn("m", F.raise_error(F.lit("step")).cast("int"))}
    with pytest.raises(Exception, match="step"):
        store.migrate(broken, 2, ["id"])
    assert store.current().columns == ["id", "v"] and len(store.receipts()) == 2
    done = store.migrate({**broken, 1: lambda t: t.drop("v")}, 2, ["id", "n"])
    assert done["schema"] == 2 and sorted(store.current().columns) == ["id", "n"] and store.migrate({}, 2, ["id"]) == done


def test_histories_and_overlays(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "sequence long, token string")
    state, good = {"identity": "i", "epoch": "e"}, {"identity": "i", "epoch": "e", "sequence": 2, "anchor": "b"}
    snapshots.check_history(None, state, log)
    snapshots.check_history(good, state, log)
    for bad in ({"epoch": "x"}, {"anchor": "z"}, {"sequence": 9}):
        with pytest.raises(ValueError):
            snapshots.check_history({**good, **bad}, state, log)
    snapshots.check_overlay(spark.range(4096).withColumnRenamed("id", "asset"))
    with pytest.raises(RuntimeError):
        snapshots.check_overlay(spark.range(4097).withColumnRenamed("id", "asset"))


def test_similarity_transform_is_the_least_squares_one(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], []
    for _ in range(8):
        source, target = rng.normal(size=(5, 2)), rng.normal(size=(5, 2))
        rows.append(tuple(c.tolist() for c in (*source.T, *target.T)))
        # unknowns a, b, e, f of the normal equations
        left = np.concatenate([np.column_stack([source[:, 0], -source[:, 1], np.ones(5), np.zeros(5)]), np.column_stack([source[:, 1], source[:, 0], np.zeros(5), np.ones(5)])])
        wanted.append(np.linalg.lstsq(left, target.T.ravel(), rcond=None)[0])
    rows.append(([1.0, 1.0], [2.0, 2.0], [0.0, 1.0], [0.0, 1.0]))
    frame = spark.createDataFrame(rows, "xs array<double>, ys array<double>, us array<double>, vs array<double>")
    got = [r.t for r in frame.coalesce(1).select(faces.similarity_transform(*map(F.col, ("xs", "ys", "us", "vs"))).alias("t")).collect()]
    assert got[-1] is None and np.allclose([tuple(t) for t in got[:-1]], wanted)


def test_detector_outputs(spark):
    # an input of 16 by 8 at stride 8 has two cells, two anchors each
    rows = [(1, 8, 2, 0.9, [0.5, 0.25, 1.0, 0.5], [1.0, -1.0], 16, 0.5), (1, 8, 3, 0.8, [0.5, 0.25, 1.0, 0.5], [0.0, 0.0], 16, 0.5), (1, 8, 0, 0.7, [0.0, 0.0, 0.5, 0.5], [0.0, 0.0], 16, 0.5), (1, 8, 1, 0.3, [0.0, 0.0, 0.5, 0.5], [0.0, 0.0], 16, 0.5)]
    frame = spark.createDataFrame(rows, "image long, stride int, place int, score double, distances array<double>, points array<double>, width int, scale double")
    kept = {r.box: r for r in faces.merged_scales(frame).collect()}
    assert set(kept) == {"8/0.5/2", "8/0.5/0"}
    best = kept["8/0.5/2"]
    assert (best.x1, best.y1, best.x2, best.y2, best.points) == (8.0, -4.0, 32.0, 8.0, [32.0, -16.0])


def test_quantised_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=130).tolist(), [2.0] * 64, rng.normal(size=5).tolist()]
    frame = spark.createDataFrame([(v,) for v in vectors], "v array<double>").select("v", faces.quantised(F.col("v")).alias("q"))
    for row in frame.select("v", "q", faces.restored(F.col("q.codes"), F.col("q.scales"), F.col("q.lows")).alias("r")).collect():
        steps = np.repeat(row.q.scales, 64)[: len(row.v)]
        assert len(row.r) == len(row.v) and max(row.q.codes) <= 15 and min(row.q.codes) >= 0
        assert (np.abs(np.array(row.r) - row.v) <= steps / 2 + 1e-9).all()


def test_encoders(spark):
    class Lengths:
        width = 2

        def __init__(self):
            self.asked = 0

        def encode(self, items):
            self.asked += len(items)
            return [[float(len(i or "")), 1.0] for i in items]

    rows = faces.encoded(spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string"), "t", Lengths).collect()
    assert {r.id: r.vector for r in rows} == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    own = Lengths()
    ask = faces.remembered(own, 2)
    assert [ask(t) for t in ("a", "bb", "a")] == [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)] and own.asked == 2
