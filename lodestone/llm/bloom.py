"""A Bloom filter of long ids with a fixed largest size.

It lets a scan drop most rows that a later exact join would drop, before they are shuffled. A
filter that is too small for its ids only lets more rows through; results never depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.hashing import mix

#: 2**27 bits are 16 MB, the most that is ever broadcast.
MOST_BITS = 1 << 27
_SEEDS = [np.uint64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    keys = ids.astype(np.int64).view(np.uint64)
    return [mix(keys + s) & np.uint64(bits - 1) for s in _SEEDS]


@dataclass
class Bloom:
    words: np.ndarray
    bits: int

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """True where an id may be in the set."""
        out = np.ones(len(ids), np.bool_)
        for at in _places(ids, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(np.bool_)
        return out

    def mask(self, ids: pa.Array) -> pa.Array:
        """The same for a column; nulls are never in the set."""
        ids = ids.cast(pa.int64())
        return pa.array(self.holds(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False), pa.bool_())


def build(ids: DataFrame, column: str) -> Bloom:
    """The filter of a column's ids; the driver gets one row for each of its words in use."""
    count = ids.count()
    bits = min(MOST_BITS, 1 << max(13, int(12 * count).bit_length()))

    def mark(batches):
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            word, at = np.unique(places >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (places & np.uint64(63)))
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = ids.select(F.col(column).cast("long").alias("id")).mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return Bloom(words, bits)


def matching(frame: DataFrame, column: str, bloom: Bloom, inside: bool = True) -> DataFrame:
    """The rows whose long id may be in the set, or those whose id surely isn't (nulls among them)."""
    shared = frame.sparkSession.sparkContext.broadcast(bloom)
    place = frame.columns.index(column)

    def run(batches):
        for batch in batches:
            mask = shared.value.mask(batch.column(place))
            yield batch.filter(mask if inside else pc.invert(mask))

    return frame.mapInArrow(run, frame.schema)
