"""Token counts by section, from one encoding of the whole document.

A document is rendered as its header fields, joined by one space, a newline, and its text. The
sections are the header fields and the lines of the text. The rendering is encoded once; every
token's character span is joined to the sections' spans (both are sorted, so that the interval
join is a binary search). A token belongs to the section with which it shares most characters;
of equal shares the earlier section gets it. Tokens that share no character with a section
(separators) stay with the document. Hence the sections' counts and the rest add up to the
document's tokens, which encoding the sections one by one would not give.

Nulls and edge cases: null fields and texts count as empty and still have their row (an empty
section with no tokens); a null id is carried along; rows with one id are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices
from lodestone.llm.tokens import encoder

SCHEMA = "doc_id long, field string, ordinal int, first_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long, doc_unassigned long"


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it crosses a section's boundary.

    ``starts`` and ``ends`` are sorted and don't overlap; empty sections get nothing.
    """
    owner = np.full(len(spans), -1, np.int64)
    crossing = np.zeros(len(spans), np.bool_)
    full = np.flatnonzero(ends > starts)
    if not len(full) or not len(spans):
        return owner, crossing
    s, e = starts[full], ends[full]
    first = np.searchsorted(e, spans[:, 0], "right")  # the first section that ends after the token starts
    last = np.searchsorted(s, spans[:, 1], "left") - 1  # the last that starts before the token ends
    one = first == last
    owner[one] = full[first[one]]
    crossing[one] = (spans[one, 0] < s[first[one]]) | (spans[one, 1] > e[first[one]])
    for t in np.flatnonzero(first < last):
        k = np.arange(first[t], last[t] + 1)
        share = np.minimum(e[k], spans[t, 1]) - np.maximum(s[k], spans[t, 0])
        owner[t] = full[k[np.argmax(share)]]
        crossing[t] = True
    return owner, crossing


def render(fields: list[str], text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The document as one string, and the start and end of each section."""
    head = " ".join(fields)
    lines = text.split("\n")
    size = np.array([len(f) for f in fields] + [len(line) for line in lines], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # one sign between any two sections
    return head + "\n" + text if fields else text, starts, starts + size


def count(docs: DataFrame, tokenizer: str, *, fields: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each header field and line of each document."""

    def run(batches):
        own = encoder(tokenizer)
        for batch in slices(batches):
            columns = [[v or "" for v in batch.column(k + 1).to_pylist()] for k in range(len(fields) + 1)]
            parts = []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                *head, text = (c[row] for c in columns)
                whole, starts, ends = render(head, text)
                spans = own.spans(whole)
                owner, crossing = allocate(spans, starts, ends)
                n = len(starts)
                got = np.bincount(owner[owner >= 0], minlength=n)
                crossed = np.bincount(owner[(owner >= 0) & crossing], minlength=n)
                parts.append((doc_id, n, starts, ends, got, crossed, len(spans), int((owner < 0).sum())))
            sizes = np.array([p[1] for p in parts])
            ordinal = np.concatenate([np.concatenate([np.zeros(len(fields), np.int32), np.arange(p[1] - len(fields), dtype=np.int32)]) for p in parts])
            names = np.concatenate([np.concatenate([np.arange(len(fields)), np.full(p[1] - len(fields), len(fields))]) for p in parts])
            spread = lambda k: pa.array([p[k] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
            yield pa.record_batch(
                [spread(0), pa.DictionaryArray.from_arrays(names.astype(np.int32), [*fields, "text"]).cast(pa.string()), pa.array(ordinal)]
                + [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (2, 3, 4, 5)]
                + [spread(6), spread(7)],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    wanted = [F.col(f).cast("string").alias(f"__{k}") for k, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *wanted, F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
