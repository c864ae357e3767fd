"""Pieces that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte that is neither a digit nor a letter turned into a space.
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(divisor)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows outside the held-out fold.

    The rows with the smallest hash of their id are taken, so that the sample does not depend
    on partitions. Where a document has several labels, the largest holds; of rows that share an
    id, one with the smallest text is taken. The sampled ids are at most ``bound`` rows, which
    is what bounds the broadcast.
    """
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & (remainder("__id", divisor) != held_out))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(bound)
    )
    chosen = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(ids), "__id")
    return chosen.groupBy("__id").agg(F.min("text").alias("text"), F.max("__label").alias("label")).select("text", "label")


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    global _libc
    if _libc is None:
        _libc = ctypes.CDLL(None)
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = None


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``: texts are long, and whole batches of them,
    with what is made from them, would set a worker's memory. What was freed goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
        _trim()


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def newton_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression; the last weight is the intercept."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
    return w
