"""The text index against a scan, updates in parts, and lookups that read one folder."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.postings import Postings
from test_whole_tables import _matches_sql

WORDS = "sea seal season goat goats hill été straße a ab abc x1 x_2 漢字".split()


def _scan(spark, rows, query):
    words = spark.createDataFrame(rows, "id long, text string").select("id", text.words(F.col("text")).alias("w"))
    return sorted(r.id for r in words.filter(text.matches(F.col("w"), text.query_words(query), text.ends_in_word(query))).collect())


def test_searches_against_a_scan(spark, tmp_path):
    rng = random.Random(2)
    make = lambda: " ".join(rng.choice(WORDS).upper() if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randrange(6)))
    rows = [(i, make()) for i in range(80)] + [(80, None), (81, ""), (82, "!!")]
    index = Postings(spark, f"file://{tmp_path}/index")
    assert index.search(["sea"]).count() == 0
    index.append(spark.createDataFrame(rows, "id long, text string"))
    queries = ["sea", "goat sea", "goat sea ", "a", "a ", "Ete hill", "hill hill goat", "nothing", "", "STRASSE x", "漢"]
    check = lambda rows, queries: [sorted(r.id for r in index.search(text.query_words(q), text.ends_in_word(q)).collect()) for q in queries] == [_scan(spark, rows, q) for q in queries]
    assert check(rows, queries)
    changed = [(3, "sea goat"), (200, "goats and seals")]
    index.append(spark.createDataFrame(changed, "id long, text string"), spark.createDataFrame([(3,), (4,), (200,)], "id long"))
    now = [r for r in rows if r[0] not in (3, 4)] + changed
    assert check(now, ["sea", "goat sea", "goats a", "a"]) and len(index.parts()) == 2
    counts = {r.term: r.docs for r in index.vocabulary("sea").collect()}
    words = [set(text.query_words(t or "")) for _, t in now]
    assert counts == {w: sum(w in own for own in words) for w in {w for own in words for w in own if w.startswith("sea")}}


def test_a_lost_writer_leaves_whole_parts(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([(1, "sea")], "id long, text string"))
    with pytest.raises(Exception, match="lost"):
        index.append(spark.createDataFrame([(2, "sea")], "id long, text string").withColumn("text", F.raise_error(F.lit("lost"))))
    assert [r.id for r in index.search(["sea"]).collect()] == [1]


def test_a_lookup_reads_one_folder(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([(i, f"w{i} v{i}") for i in range(50)], "id long, text string"))
    plan = index.lookup("w7", True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "StringStartsWith(term,w7)" in plan


@pytest.mark.parametrize("name", ["text_all_terms", "text_prefix", "text_prefix_flag", "vocabulary_prefix"])
def test_queries_of_the_index_against_sql(spark, name):
    _matches_sql(spark, name, None)
