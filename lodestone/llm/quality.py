"""Quality classifier: hashed word n-grams and logistic regression by FTRL-proximal updates.

A word is a run of bytes without ASCII white space. Each word counts twice: by its lower-cased
bytes, and by its shape (runs of capitals, small letters and digits become one letter, other
signs stay). Unigrams and bigrams of both are hashed into ``2**bits`` slots; a bigram of two
equal words goes to one slot of its own. A document's vector holds counts over its number of
words, and its score is the sigmoid of a sparse dot product, taken over the whole text.

Nulls and edge cases: a null text counts as empty and scores the intercept alone; a null id is
carried along, is not held out and never trains; rows with one id are scored each by its own
text; without labelled rows all weights are zero and every score is 0.5.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, labelled_sample, remainder, sigmoid, slices, texts
from lodestone.llm.hashing import mix, word_keys

#: Classes of bytes: capitals, small letters (and all beyond ASCII), digits; white space stays.
_SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def slots(text: bytes, bits: int) -> tuple[np.ndarray, int]:
    """The slot of each n-gram in the text, repeats included, and the number of words."""
    shapes = _SHAPE[np.frombuffer(text, np.uint8)]
    if len(shapes):
        shapes = shapes[np.concatenate(([True], shapes[1:] != shapes[:-1]))]
    out = []
    shift = np.uint64(64 - bits)
    for k, key in enumerate((word_keys(text.translate(LOWER)), word_keys(shapes))):
        out.append((key * _MIX[k]) >> shift)
        if len(key) > 1:
            pair = mix(key[:-1] * _MIX[2 + k] + key[1:])
            if k == 0:
                pair[key[:-1] == key[1:]] = _MIX[3]
            out.append(pair >> shift)
    return np.concatenate(out).astype(np.int64), len(key)


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    bits: int

    def score(self, text: bytes) -> float:
        at, n = slots(text, self.bits)
        return float(sigmoid(self.intercept + (self.weights[at].sum() / n if n else 0.0)))


class StoredRows(Sequence):
    """Sparse rows (slots, values, label) in a file; in memory are their places and first slots.

    ``sort`` brings them into a total order, which does not depend on how they came.
    """

    def __init__(self, file) -> None:
        self.file = file
        self.size = 0
        self.rows: list[tuple[int, int, list[int], int]] = []  # slots, label, first slots, place

    def add(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        data = slots.astype(np.int64).tobytes() + values.astype(np.float64).tobytes()
        self.file.write(data)
        self.rows.append((len(slots), label, slots[:8].tolist(), self.size))
        self.size += len(data)

    def _bytes(self, row: tuple[int, int, list[int], int]) -> bytes:
        return os.pread(self.file.fileno(), 16 * row[0], row[3])

    def sort(self) -> None:
        self.file.flush()

        def compare(a, b) -> int:
            x, y = a[:3], b[:3]
            if x == y:
                x, y = self._bytes(a), self._bytes(b)
            return (x > y) - (x < y)

        self.rows.sort(key=cmp_to_key(compare))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        n, label, *_ = row = self.rows[i]
        data = self._bytes(row)
        return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n, 8 * n), label


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 3, alpha: float = 1.0, beta: float = 0.05, l1: float = 1e-4, l2: float = 1e-4) -> QualityModel:
    """FTRL-proximal logistic regression over sparse rows (slots, values, label)."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, values, label = rows[i]
            at = np.append(slots, size)
            x = np.append(values, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (float(sigmoid(wi @ x)) - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return QualityModel(w[:size].astype(np.float64), float(w[size]), bits)


def train(docs: DataFrame, labels: DataFrame, *, bound: int = 4000, bits: int = 18, divisor: int = 5, held_out: int = 0) -> QualityModel:
    """Fits on at most ``bound`` labelled rows, in one task; the driver gets the weights only.

    Features are made where the texts are. The task that fits keeps them in a temporary file of
    its own, so that its memory is that of the weights, however long the texts are.
    """

    def featurise(batches):
        for batch in slices(batches):
            found = [slots(t, bits) for t in texts(batch)]
            packed = [np.unique(s, return_counts=True) for s, _ in found]
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("label")).cast(pa.int32()), pa.array([u.astype(np.int32) for u, _ in packed], pa.list_(pa.int32())), pa.array([(c / max(1, n)).astype(np.float32) for (_, c), (_, n) in zip(packed, found, strict=True)], pa.list_(pa.float32()))],
                names=["label", "slots", "vals"],
            )

    def fit(batches):
        with tempfile.TemporaryFile() as file:
            rows = StoredRows(file)
            for batch in slices(batches):
                for label, s, v in zip(*batch.columns, strict=True):
                    rows.add(s.values.to_numpy(), v.values.to_numpy(), label.as_py())
            rows.sort()
            model = ftrl(rows, bits)
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])], names=["weights", "intercept"])

    sample = labelled_sample(docs, labels, "quality", divisor, held_out, bound)
    features = sample.mapInArrow(featurise, "label int, slots array<int>, vals array<float>")
    found = features.repartition(1).mapInArrow(fit, "weights binary, intercept double").collect()
    if not found:  # no task ran, as there were no rows
        return ftrl([], bits)
    return QualityModel(np.frombuffer(found[0].weights, np.float64), found[0].intercept, bits)


def score(docs: DataFrame, model: QualityModel, *, divisor: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            s = np.array([shared.value.score(t) for t in texts(batch)], np.float64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(remainder("doc_id", divisor) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            mask = [shared.value.score(t) >= threshold for t in texts(batch)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
