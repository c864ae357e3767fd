"""Packing by concatenating and cutting.

Every text is encoded once; its ids, followed by an end id, are written to the shared scratch
folder (two bytes an id where the vocabulary allows). All rows, in the order of that table's
partitions and of rows within them, form one long stream of ids. The first pass over the
written lengths counts the ids of each partition; prefix sums over these totals (one row for
each partition, on the driver) give every partition its offset in the stream. The second pass
cuts the stream into windows of ``window`` ids and returns one boundary record for each piece of
a document. Only the last window can be short of ids; it is the only one that is padded.

The passes read one written table under one plan. The number and the order of rows in each
partition are compared all the same, and a difference stops the job.

Nulls and edge cases: a null text counts as empty and packs its end id alone; a null id is
carried along; rows with one id are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts
from lodestone.llm.tokens import encoder
from lodestone.sources.storage import Scratch

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """doc_id, n (ids with the end id), width (bytes an id), ids (little-endian)."""

    def run(batches):
        own = encoder(tokenizer)
        width = 2 if max(own.largest, end_id) < 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        for batch in slices(batches):
            found = [np.concatenate([own.ids(t.decode("utf-8")), end]).astype(f"<u{width}") for t in texts(batch)]
            yield pa.record_batch([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([width] * len(found), pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "n", "width", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, width int, ids binary")


def _mark(names: list, mark: int) -> int:
    """A running checksum over the ids of rows, in order."""
    return zlib.crc32("".join(f"{i};" for i in names).encode(), mark)


def pack(encoded: DataFrame, *, window: int = 1024) -> DataFrame:
    """One row for each piece of a document; ``encoded`` must be a written table."""

    def count(batches):
        total = mark = 0
        for batch in batches:
            total += sum(batch.column(1).to_pylist())
            mark = _mark(batch.column(0).to_pylist(), mark)
        if total:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64()), pa.array([mark], pa.int64())], names=["part", "total", "mark"])

    totals = sorted((r["part"], r["total"], r["mark"]) for r in encoded.select("doc_id", "n").mapInArrow(count, "part long, total long, mark long").toArrow().to_pylist())
    base = np.cumsum([0, *[t for _, t, _ in totals]])
    plan = encoded.sparkSession.sparkContext.broadcast({p: (int(base[k]), t, m) for k, (p, t, m) in enumerate(totals)})

    def cut(batches):
        at, expected, mark, done = None, None, 0, 0
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if at is None:
                at, *expected = plan.value[TaskContext.get().partitionId()]
            names, lengths, widths, ids = (batch.column(k).to_pylist() for k in range(4))
            mark = _mark(names, mark)
            out: list[tuple] = []
            for i, n, width, data in zip(names, lengths, widths, ids, strict=True):
                wide = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    length = min(window - at % window, n - start)
                    out.append((i, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, at // window, at % window))
                    start += length
                    at += length
                done += n
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        if at is not None and [done, mark] != list(expected):
            raise RuntimeError("the rows of a partition differ between the two passes")

    return encoded.select("doc_id", "n", "width", "ids").mapInArrow(cut, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Encodes, writes and packs the texts of ``docs``."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(encode(docs, tokenizer, end_id=end_id)), window=window)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
