"""The quality classifier's fit: the driver holds the weights only; the order of rows is total."""

from __future__ import annotations

import random
import tempfile
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality


def _long(spark, n, words):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.xxhash64(k, "id").cast("string"))).alias("text"))
    return docs, spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))


def test_the_driver_gets_no_features(spark):
    docs, labels = _long(spark, 300, 4000)
    quality.train(docs, labels.limit(0), bits=14)  # imports
    tracemalloc.start()
    try:
        model = quality.train(docs, labels, bits=14)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.weights) == 1 << 14 and np.count_nonzero(model.weights) > 1000
    assert peak < 4e6  # the features of 240 such rows are more than 30 MB


def test_the_fit_is_that_of_the_rows_in_a_list(spark):
    docs, labels = _long(spark, 40, 60)
    docs = docs.unionByName(docs.select((F.col("doc_id") + 40).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(80, None), (81, "")], "doc_id long, text string"))
    labels = labels.unionByName(spark.range(40, 82).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    rows = []
    for text, label in quality.labelled_sample(docs, labels, "quality", 5, 0, 4000).collect():
        found, n = quality.slots((text or "").encode(), 12)
        at, count = np.unique(found, return_counts=True)
        rows.append((at, (count / max(1, n)).astype(np.float32).astype(np.float64), label))
    rows.sort(key=lambda r: (len(r[0]), r[2], r[0][:8].tolist(), r[0].tobytes(), r[1].tobytes()))
    plain = quality.ftrl(rows, 12)
    for parts in (1, 7):
        model = quality.train(docs.repartition(parts), labels, bits=12)
        assert model.weights.tobytes() == plain.weights.tobytes() and model.intercept == plain.intercept


def test_stored_rows_in_order():
    rng = random.Random(4)
    rows = []
    for _ in range(200):  # many rows share size, label and first slots
        tail = sorted(rng.sample(range(20, 24), 2))
        rows.append((np.array([*range(8), *tail][: rng.choice((0, 3, 10))], np.int32), rng.randrange(2)))
    rows = [(s, np.array([rng.choice((0.25, 0.5)) for _ in s], np.float32), y) for s, y in rows]
    wide = [(s.astype(np.int64), v.astype(np.float64), y) for s, v, y in rows]
    wide.sort(key=lambda r: (len(r[0]), r[2], r[0][:8].tolist(), r[0].tobytes(), r[1].tobytes()))
    with tempfile.TemporaryFile() as file:
        stored = quality.StoredRows(file)
        for row in rows:
            stored.add(*row)
        stored.sort()
        assert len(stored) == len(wide)
        for got, want in zip(stored, wide, strict=True):
            assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() and got[2] == want[2]
