"""Registered queries against SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["browse_page_newest", "browse_page_next", "facet_delta_merge", "facet_router_total", "text_prefix", "text_score_rank", "nearest_frame", "vector_topk_per_asset", "hybrid_rrf", "components", "suggest_person", "iou_label_match", "job_sync_diff", "retention_tiers", "snapshot_digest", "date_phrase_parse"]


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value if value is None or isinstance(value, (int, str)) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    import duckdb

    from lodestone.plans import registry

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = registry.queries()[name](spark, SF)
    wanted = connection.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr) == sorted((tuple(_plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__

    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
