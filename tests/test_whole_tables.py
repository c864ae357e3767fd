"""Queries over whole tables against SQL, and operators on inputs beyond one partition or block."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ledgers
from test_entry import SF, TABLES, _plain


def _matches_sql(spark, name, rows):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    import duckdb

    from lodestone.plans import registry

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = registry.queries()[name](spark, SF)
    wanted = connection.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    got = sorted((tuple(_plain(r[c]) for c in wanted.columns) for r in found.collect()), key=repr)
    assert got == sorted((tuple(map(_plain, r)) for r in wanted.fetchall()), key=repr)
    if rows:
        assert len(got) == connection.sql(f"select count(*) from {rows}").fetchall()[0][0]


def test_retention_of_every_snapshot(spark):
    _matches_sql(spark, "retention_tiers_all", None)
    rows = [(1, "2026-09-01 10:00:00"), (2, "2026-09-01 10:59:00"), (3, "2026-09-01 10:59:00"), (4, "2026-08-30 01:00:00"), (5, "2026-08-30 23:00:00"), (6, "2026-09-02 00:00:00"), (7, None)]
    files = spark.createDataFrame(rows, "file long, created string").withColumn("created", F.col("created").cast("timestamp"))
    assert sorted(r.file for r in ledgers.retained(files, "2026-09-01 12:00:00", newest=1).collect()) == [2, 5, 6]


def test_every_timestamp_is_converted(spark):
    _matches_sql(spark, "iso_to_sortdate_all", "events")


@pytest.mark.parametrize("name, rows", [("people_order_all", "customer"), ("result_sort_all", "orders")])
def test_whole_orders(spark, name, rows):
    _matches_sql(spark, name, rows)


def test_places_over_many_partitions(spark):
    from lodestone.operators.ranking import placed

    rng = random.Random(4)
    keys = [(rng.randrange(50), i) for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(spark.createDataFrame(keys, "k long, i long").repartition(7), F.desc("k"), "i").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    wanted = {key: n for n, key in enumerate(sorted(keys, key=lambda x: (-x[0], x[1])), 1)}
    assert {(r.k, r.i): r.place for r in got} == wanted and len(got) == 3000
    assert placed(spark.createDataFrame([], "k long"), "k").count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_suggestions_without_rejected_pairs(spark, block):
    from lodestone.operators import people

    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    faces, examples = unit(rng.normal(size=(60, 4))), unit(rng.normal(size=(17, 4)))
    owner = [i % 6 for i in range(17)]
    no = {(int(f), int(p)) for f, p in zip(rng.integers(0, 60, 150), rng.integers(0, 6, 150), strict=True)} | {(5, p) for p in range(6)}
    wanted = {}
    for i, face in enumerate(faces):
        best = sorted(((-max(float(face @ e) for e, o in zip(examples, owner, strict=True) if o == p), p) for p in range(6) if (i, p) not in no))
        if best and -best[0][0] >= 0.45 and (len(best) < 2 or best[1][0] - best[0][0] >= 0.08):
            wanted[i] = best[0][1]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = people.suggest(frame([(i, v.tolist()) for i, v in enumerate(faces)], "face long, vector array<double>"), frame([(o, v.tolist()) for o, v in zip(owner, examples, strict=True)], "person long, vector array<double>"), block=block, rejected=frame([*no, (None, 1)], "face long, person long"))
    assert {r.face: r.person for r in found.collect()} == wanted and 5 not in wanted and len(wanted) > 5


def test_suggestions_from_every_example(spark):
    _matches_sql(spark, "suggest_person_all", None)
