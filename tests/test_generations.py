"""A writer that is lost between any two steps, late events, and names that are no generations."""

from __future__ import annotations

import pytest

from lodestone.streaming import cdc


def _rows(target):
    return sorted(tuple(r) for r in target.current().select("asset", "camera", "arrival").collect())


def _events(spark, *rows):
    return spark.createDataFrame(list(rows), cdc.SCHEMA)


@pytest.mark.parametrize("lost_after", ["nothing", "rows", "manifest"])
def test_a_lost_writer_leaves_the_last_complete_generation(spark, tmp_path, monkeypatch, lost_after):
    target = cdc.Generations(spark, f"file://{tmp_path}/root")
    target.apply(_events(spark, (1, 10, "A", False), (2, 11, "B", False)), 0)
    change = _events(spark, (3, 10, "C", False), (4, 12, "D", False))

    class Lost(Exception):
        pass

    def lose(*args):
        raise Lost

    with monkeypatch.context() as patch:
        if lost_after == "nothing":
            patch.setattr(cdc.Generations, "write", lose)
        elif lost_after == "rows":
            patch.setattr(cdc.Generations, "complete", lose)
        if lost_after == "manifest":
            target.apply(change, 1)
        else:
            with pytest.raises(Lost):
                target.apply(change, 1)
            assert _rows(target) == [(10, "A", 1), (11, "B", 2)] and target.pointer()["batch"] == 0
    again = cdc.Generations(spark, f"file://{tmp_path}/root")
    again.apply(change, 1)
    assert _rows(again) == [(10, "C", 1), (11, "B", 2), (12, "D", 4)] and again.pointer()["batch"] == 1
    assert again.manifest(again.pointer()["generation"]) == {"batch": 1, "rows": 3}
    with pytest.raises(Exception, match="exist"):
        again.complete(again.pointer()["generation"], 1)


def test_late_events_change_nothing(spark, tmp_path):
    target = cdc.Generations(spark, f"file://{tmp_path}/root")
    target.apply(_events(spark, (5, 10, "new", False), (6, 11, None, True), (7, 12, "x", False)), 0)
    target.apply(_events(spark, (2, 10, "old", False), (3, 11, "old", False), (4, 12, None, True)), 1)
    assert _rows(target) == [(10, "new", 5), (12, "x", 7)]
    target.apply(_events(spark, (9, 11, "back", False)), 2)
    assert _rows(target) == [(10, "new", 5), (11, "back", 9), (12, "x", 7)]


def test_cleanup_and_names(spark, tmp_path):
    target = cdc.Generations(spark, f"file://{tmp_path}/root")
    assert target.pointer() == {"generation": None, "batch": -1} and _rows(target) == []
    for batch in range(5):
        target.apply(_events(spark, (batch + 1, batch, "A", False)), batch)
    left_behind = target.write(target.held(), 2)
    first = target._complete()[0][1]
    gone = target.cleanup(keep=2, pinned=[first])
    assert left_behind in gone and first not in gone and len(gone) == 3
    assert len(_rows(target)) == 5 and len(target._complete()) == 3
    for name in ("../outside", "generation-1", "rows", f"{first}/rows"):
        with pytest.raises(ValueError):
            target.resolve(name)
