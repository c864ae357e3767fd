"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and reduced to words (runs of ASCII letters and digits and of bytes beyond
ASCII) joined by one space. A test item is searched as passages: the item itself up to
``window * 3 // 2`` characters, and overlapping windows of it if it is longer than ``window``, so that
a copied part is found as well: any run of about 1.5 windows of a long item, and the first or
last window of every item that has windows. Shorter parts are not searched. A passage of n
characters may differ by n // ``piece`` - 1 edits of a character, one in ``piece`` or so. A passage
with an error budget of k edits is split into k + 1 pieces; a text that holds the passage within
k edits holds one of the pieces unchanged. One automaton finds all pieces of all passages in a
text; around each hit Myers' bit-parallel algorithm takes the passage's least edit distance to
any part of the text, and accepts it within the budget.

The benchmark is held against all documents in blocks of at most ``block_bytes`` of item text,
which bounds what is broadcast; the documents are never shuffled.

Nulls and edge cases: null or empty texts and items match nothing; items of fewer than
``least_words`` words and ``least_bytes`` bytes are too common to be evidence and match nothing
(a text in a script without spaces is one word, however long); rows with a null id have no
match by id but are still filtered by text; an item with a null id matches under null; repeated
items match each under its own id; rows with one id are matched each by its own text, and their
matches merged: the least distance with its place, and the most passages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER_ALNUM, slices, texts


def reduced(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8")
    return b" ".join(text.translate(LOWER_ALNUM).split())


@dataclass(frozen=True)
class Passage:
    item: int  # index of the item
    text: bytes
    letters: str
    budget: int


def passages_of(item: int, text: bytes, *, window: int, piece: int, least_words: int, least_bytes: int) -> list[Passage]:
    """An item's passages; windows begin at words and overlap by half."""
    small = reduced(text)
    if not small or small.count(b" ") + 1 < least_words and len(small) < least_bytes:
        return []
    letters = small.decode("utf-8", "replace")
    parts = [letters] if len(letters) <= window * 3 // 2 else []
    if len(letters) > window:
        starts, at = [], 0
        while at + window < len(letters):
            starts.append(at)
            # the next word after half a window; without one, as in scripts without spaces, half a window on
            step = letters.find(" ", at + window // 2, at + window)
            at = step + 1 if step >= 0 else at + window // 2
        parts += [letters[s : s + window].strip() for s in starts] + [letters[-window:].strip()]
    return [Passage(item, p.encode(), p, max(0, len(p) // piece - 1)) for p in dict.fromkeys(parts)]


def pieces_of(passage: Passage) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n, parts = len(passage.letters), passage.budget + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, passage.letters[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_masks(pattern: Sequence) -> dict:
    masks: dict = {}
    for i, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | 1 << i
    return masks


def least_distance(masks: dict, length: int, text: Sequence) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of ``text``, and that part's end.

    Vertical differences of the dynamic programme's column are held as bits of two integers.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, now = full, 0, length
    best, end = length, 0
    for at, letter in enumerate(text, 1):
        equal = masks.get(letter, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        vertical = equal | minus
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if now < best:
            best, end = now, at
    return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, bytes]], *, window: int, piece: int, least_words: int, least_bytes: int) -> None:
        self.ids = [i for i, _ in items]
        self.passages = [p for k, (_, t) in enumerate(items) for p in passages_of(k, t, window=window, piece=piece, least_words=least_words, least_bytes=least_bytes)]
        self.masks: dict[int, dict] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for number, p in enumerate(self.passages):
            for offset, part in pieces_of(p):
                where.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, uses in where.items():
            self.automaton.add_word(part, (len(part), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> dict[int, tuple[int, int, int]]:
        """item index: (distance, passages found, place of the best) for one text."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.passages:
            return found
        small = reduced(text).decode("utf-8", "replace")
        done: set[int] = set()
        tried: dict[int, int] = {}
        for end, (length, uses) in self.automaton.iter(small):
            for number, offset in uses:
                if number in done:
                    continue
                p = self.passages[number]
                start = end + 1 - length - offset
                if start >= 0 and small.startswith(p.letters, start):
                    distance = 0
                else:
                    if tried.get(number) == start:
                        continue
                    tried[number] = start
                    if number not in self.masks:
                        self.masks[number] = letter_masks(p.letters)
                    distance, _ = least_distance(self.masks[number], len(p.letters), small[max(0, start - p.budget) : start + len(p.letters) + p.budget])
                if distance <= p.budget:
                    done.add(number)
                    place = len(small[: max(0, start)].encode())
                    old = found.get(p.item)
                    found[p.item] = (distance, 1, place) if old is None else (min(old[0], distance), old[1] + 1, place if distance < old[0] else old[2])
        return found


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks; the driver holds one block at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").isNotNull()).toLocalIterator():
        data = text.encode("utf-8")
        held.append((item, data))
        size += len(data)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 160, piece: int = 16, least_words: int = 5, least_bytes: int = 48, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, distance (the least), n_passages, first_byte (in the reduced text)."""
    result = None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    schema = "doc_id long, item_id long, distance int, n_passages int, first_byte long"
    for block in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, window=window, piece=piece, least_words=least_words, least_bytes=least_bytes)
            for batch in slices(batches):
                rows = [(i, matcher.ids[k], *f) for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for k, f in sorted(matcher.find(t).items())]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "n_passages", "first_byte"])

        found = source.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("distance", "first_byte")).alias("best")
    merged = result.groupBy("doc_id", "item_id").agg(best, F.max("n_passages").alias("n_passages"))
    return merged.select("doc_id", "item_id", "best.distance", "n_passages", "best.first_byte")


def keep(docs: DataFrame, benchmark: DataFrame, *, window: int = 160, piece: int = 16, least_words: int = 5, least_bytes: int = 48, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    for block in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, window=window, piece=piece, least_words=least_words, least_bytes=least_bytes)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.find(t) for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
