"""Rules of several steps: registered queries against SQL, and worked cases."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, media, text
from lodestone.operators import edits, ledgers, queues
from test_whole_tables import _matches_sql


@pytest.mark.parametrize("name", ["capture_device", "people_edits", "job_sync_actions", "import_registered", "import_pass", "compaction_policy", "job_rounds", "units_in_force", "retention_receipts", "nms", "tracks", "date_cover", "date_phrase_parse", "gps_label", "frame_rate", "retention_tiers", "history_changes", "receipt_ledger", "attempts_since_disconnect", "lanes_with_work", "labels_token", "removed_assets", "facet_router_total", "face_reference", "packed_cells", "segment_words", "video_sizes", "date_selection", "generation_fates", "video_cameras", "iou_label_match", "toggle_selection", "visible_items", "preview_order", "preview_requests", "group_review_own", "group_toggles"])
def test_against_sql(spark, name):
    _matches_sql(spark, name, None)


def test_covers_against_days(spark):
    spans = [(date(2023, 12, 30), date(2025, 2, 28)), (date(2024, 2, 2), date(2024, 2, 29)), (date(2024, 1, 1), date(2024, 1, 1)), (date(2024, 5, 1), date(2024, 4, 1))]
    rows = spark.createDataFrame(spans, "a date, b date").select("a", "b", dates.cover_tokens(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [dates.cover(f"{a:%Y%m%d}", f"{b:%Y%m%d}") for a, b in spans]
    assert dates.cover("20231230", "20250228") == ["d20231230", "d20231231", "y2024", "m202501", "m202502"]


@pytest.mark.parametrize("phrase, wanted", [
    ("sea in September", ("sea", "20260901", "20260930", False)), ("in Sep 2025", ("", "20250901", "20250930", False)), ("in sept 2025", ("", "20250901", "20250930", False)), ("goats in Feb 2024 ", ("goats", "20240201", "20240229", False)),
    ("on 2026-02-30", ("on 2026-02-30", None, None, True)), ("from 2026-03-02 to 2026-03-01", ("from 2026-03-02 to 2026-03-01", None, None, True)), ("in 0000", ("in 0000", None, None, True)), ("within 2024", ("within 2024", None, None, False)),
])
def test_phrases(spark, phrase, wanted):
    row = spark.range(1).select(dates.parse_phrase(F.lit(phrase), F.lit("2026-11-26").cast("date")).alias("p")).first().p
    assert (row.rest, row.start, row.through, row.invalid) == wanted


def test_devices_and_places(spark):
    url = lambda u, source=None, camera=None, details=(): spark.range(1).select(media.device_name(F.lit(u), F.lit(source), F.lit(camera), F.array(*map(F.lit, details)).cast("array<string>")).alias("d")).first().d
    assert url("file:///a/Originals/x/Originals/My%20Cam/b.mp4") == "My Cam" and url("file:///a/Originals/My Cam/b.mp4", "iCloud", "Phone") == "Phone"
    assert url("file:///a/Originals", None, "", ("4K", "Zoom")) == "Unknown device" and url(None, None, None, ("4K", "Zoom")) == "Zoom" and url("file:///iCloud/a") == "iCloud · Device unavailable"
    place = lambda lat, a, lon, b: spark.range(1).select(media.gps_label(F.array(*map(F.lit, lat)), F.lit(a), F.array(*map(F.lit, lon)), F.lit(b), F.lit(None).cast("string")).alias("g")).first().g
    assert place((1.0, 30.0, 0.0), "n", (2.0, 0.0, 0.0), "e") == "1.500°N 2.000°E"
    assert place((1.0, 0.0, 0.0), "E", (2.0, 0.0, 0.0), "N") is None and place((1.0, -3.0, 0.0), "N", (2.0, 0.0, 0.0), "E") is None and place((1.0, 0.0, 0.0), None, (2.0, 0.0, 0.0), "E") is None


def test_query_words_fold_like_columns(spark):
    texts = ["Dunăre ÉTÉ", "naïve_x2 Straße", "ábc Ø9", "", "!!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.words(F.col("t")).alias("w")).collect()
    assert [text.query_words(t) for t in texts] == [r.w for r in rows]


def test_edits(spark):
    labels = spark.createDataFrame([("a", 1, "confirmed"), ("a", 2, "rejected"), ("b", 2, "confirmed"), ("b", 1, "rejected")], "face_key string, person long, verdict string")
    people = spark.createDataFrame([(1, "x"), (2, "y")], "person long, name string")
    faces = lambda *keys: spark.createDataFrame([(k,) for k in keys], "face_key string")
    rows = lambda frame: sorted(map(tuple, frame.select("face_key", "person", "verdict").collect()))
    assert rows(edits.confirm(labels, faces("a", "a"), 2)) == [("a", 2, "confirmed"), ("b", 1, "rejected"), ("b", 2, "confirmed")]
    assert rows(edits.reject(labels, faces("a"), 1)) == [("a", 1, "rejected"), ("a", 2, "rejected"), ("b", 1, "rejected"), ("b", 2, "confirmed")]
    left, moved = edits.merge(people, labels, 2, 1)
    assert rows(moved) == [("a", 1, "rejected"), ("b", 1, "confirmed")] and [r.person for r in left.collect()] == [1]
    before = labels.filter("face_key = 'a'")
    assert rows(ledgers.undo(edits.confirm(labels, faces("a"), 2), before, "face_key")) == rows(labels)


def test_history_before_the_token_is_gone(spark):
    assets = spark.createDataFrame([(1,), (2,), (3,)], "asset long")
    history = spark.createDataFrame([(10, 1, "updated"), (11, 2, "removed")], "sequence long, asset long, kind string")
    found = lambda token, **k: sorted(r.asset for r in queues.assets_to_examine(assets, history, token, 1.0, **k).collect())
    assert found(9) == [1] and found(8) == [1, 2, 3] and found(9, same_range=False) == [1, 2, 3] and found(11) == []


def test_overlapping_boxes_against_all_pairs(spark):
    from lodestone.operators import people

    rng = np.random.default_rng(6)
    boxes = []
    for n in range(150):
        x, y = rng.integers(0, 12, 2)
        w, h = rng.choice([0, 1, 2, 4, 5, 8, 16]), rng.choice([1, 2, 4, 5])
        boxes.append((n % 2, n, float(x), float(y), float(x + w), float(y + h)))
    frame = lambda p: spark.createDataFrame(boxes, f"asset long, {p}face long, {p}x1 double, {p}y1 double, {p}x2 double, {p}y2 double")
    for least in (0.3, 0.5, 1.0):
        wanted = set()
        for a in boxes:
            overlaps = people.overlaps(np.array(a[2:]), np.array([b[2:] for b in boxes]))
            wanted |= {(a[1], b[1]) for b, o in zip(boxes, overlaps, strict=True) if a[0] == b[0] and o >= least}
        assert sorted((r.l_face, r.f_face) for r in people.overlapping(frame("l_"), frame("f_"), "asset", least).collect()) == sorted(wanted)
