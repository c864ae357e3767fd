"""Scratch tables: removal, and no private folders on a cluster; joins on hot keys; a guarded entry point."""

from __future__ import annotations

import builtins
import os
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.operators.skew import hot_keys, spread_join
from lodestone.sources import storage


def test_a_cluster_needs_a_shared_folder():
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda key: None)))
    with pytest.raises(RuntimeError):
        storage.checkpoint_root(bare)


def test_components_leave_one_table(spark):
    root = storage.checkpoint_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    edges = spark.range(700).select(F.lit(0).alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.range(30).select((F.col("id") + 1000).alias("src"), (F.col("id") + 1001).alias("dst")))
    got = {r.node: r.component for r in connected_components(spark, edges).collect()}
    assert got == {i: 0 for i in range(701)} | {i: 1000 for i in range(1000, 1031)}
    new = [d for d in os.listdir(root) if d not in before and d.startswith("components-")]
    assert [len(os.listdir(f"{root}/{d}")) for d in new] == [1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, how):
    many = spark.createDataFrame([(i % 3 if i < 90 else 7, i) for i in range(100)] + [(None, 200)], "k long, i long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    hot = hot_keys(many.groupBy("k").count(), "k", "count", above=4, most=2)
    assert hot.count() == 2
    rows = lambda f: sorted(map(tuple, f.select("k", "i", "v").collect()), key=repr)
    assert rows(spread_join(many, one, "k", "i", hot, how)) == rows(many.join(one, "k", how))


def test_catalogue_queries_without_what_the_text_operators_need(monkeypatch):
    import __spark_entry__

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith("lodestone.llm") or n in ("corpus_pipeline", "ahocorasick")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    names = set(__spark_entry__.queries())
    assert "facet_day" in names and not any(n.startswith("op1_") for n in names) and set(__spark_entry__.oracle_sql()) <= names
