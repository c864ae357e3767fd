"""Groups that share boilerplate at many lengths, hot buckets and hot texts, and clashing column names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_copies
from test_llm import _brute_components, _text


def _rows():
    rng = random.Random(31)
    page = _text(rng, 60)
    # one page with tails of many lengths: all share bands, few are similar enough
    rows = [(i, f"{page} {_text(rng, rng.choice([0, 3, 6, 9, 12, 15, 20, 40, 70, 120, 200]))}") for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300 + i, " ".join([*rows[5][1].split()[:-1], f"end{i}"])) for i in range(60)]
    return rows + [(400, None), (401, ""), (402, "a b"), (403, "A B")]


@pytest.mark.parametrize("spread", [False, True])
def test_groups_of_many_sizes(spark, monkeypatch, spread):
    if spread:  # rows of small keys are spread as well
        monkeypatch.setattr(near_copies, "hot_keys", lambda counts, key, count: _hot(counts, key, count, above=3, most=20))
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.components(docs, block_docs=9).collect()}
    assert got == _brute_components(rows)


_hot = near_copies.hot_keys


def test_clashing_columns_stay(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("__near_copies_id"), F.lit(2).alias("__gone"), F.lit(3).alias("__near_copies_id__gone"))
    kept = near_copies.keep(docs)
    assert kept.columns == docs.columns and {tuple(r)[0] for r in kept.collect()} == {1, None} and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3)}
