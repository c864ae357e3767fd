"""Language identification by compression with per-language zstandard dictionaries.

Each learned language has a raw-content dictionary of sampled text. A text, lower-cased in A-Z
and reduced to words, is compressed whole with every dictionary, in blocks that each start from
the dictionary alone, so that a long text's own repetitions do not drown the dictionary. The
smallest total wins; ties go to the language that was commonest among the rows learned from. ``rejected`` marks wins
by a narrow margin (relative to the runner-up); callers that want them as unknown filter on it.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; rows with a
null lang or id never train; a null id is carried along and is not held out; rows with one id
are classified each by its own text; if no language could be learned, every row is ``und``.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import remainder, slices, texts

#: Lower-cases A-Z; ASCII bytes that aren't letters become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def reduced(text: bytes) -> bytes:
    return b" ".join(text.translate(_LETTERS).split())


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]  # commonest language first
    block: int = 8192
    margin: float = 0.01

    def classifier(self):
        return Classifier(self)


class Classifier:
    """Compressors made once for each Python worker's use of a model."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.languages = list(model.dictionaries)
        # matches of three bytes count: syllables of a language are that short
        settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=18, chain_log=16, hash_log=16, search_log=4, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
        contents = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in model.dictionaries.values()]
        self.compressors = [zstandard.ZstdCompressor(dict_data=c, compression_params=settings) for c in contents]

    def sizes(self, text: bytes) -> np.ndarray:
        small, block = reduced(text), self.model.block
        parts = [small[i : i + block] for i in range(0, len(small), block)] or [b""]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], np.int64)

    def classify(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is too narrow."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        others = np.delete(sizes, best)
        score = float(1.0 / (1.0 + np.sum(np.exp2(-np.minimum(60.0, (others - sizes[best]).astype(float)))))) if len(others) else 1.0
        return self.languages[best], score, bool(len(others) and (others.min() - sizes[best]) < self.model.margin * others.min())


def train(docs: DataFrame, *, per_language: int = 120, divisor: int = 3, held_out: int = 1) -> LanguageModel:
    """Dictionaries from at most ``per_language`` documents for each language that has rows.

    Every partition sends its ``per_language`` smallest id hashes of a language, from the id
    and lang columns alone; the texts of the chosen ids alone are read after that. A language's
    dictionary is the whole distinct texts, reduced and joined; of rows that share an id one with
    the smallest text is taken. This sample bounds the fit only.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held_out)).select(F.col("doc_id").cast("long").alias("__id"), F.col("lang").cast("string").alias("__lang"))
    names = [r[0] for r in known.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").collect()]
    if not names:
        return LanguageModel({})

    def smallest(batches):
        best: dict[str, list[tuple[int, int]]] = {n: [] for n in names}
        for batch in batches:
            for i, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in best:
                    item = (-(xxhash.xxh64_intdigest(str(i)) >> 1), i)
                    (heapq.heappush if len(best[lang]) < per_language else heapq.heappushpop)(best[lang], item)
        rows = [(i, n, -h) for n, items in best.items() for h, i in items]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["__id", "__lang", "__hash"])

    top = known.mapInArrow(smallest, "__id long, __lang string, __hash long").distinct()
    ids = top.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy("__hash", "__id"))).filter(F.col("__n") <= per_language).select("__id", F.col("__lang").alias("__of"), "__hash")

    def reduce(batches):
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([reduced(t) for t in texts(batch)], pa.binary())], names=["__of", "__hash", "piece"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(ids), "__id").groupBy("__id", "__of", "__hash").agg(F.min("text").alias("text"))
    rows = chosen.select("__of", "__hash", "text").mapInArrow(reduce, "__of string, __hash long, piece binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["__of"], r["__hash"], r["piece"]))
    content: dict[str, list[bytes]] = {n: [] for n in names}
    for r in rows:
        content[r["__of"]].append(r["piece"])
    # zstandard takes no dictionary of fewer than eight bytes: spaces, which no word holds, fill it
    return LanguageModel({n: b" ".join(dict.fromkeys(p for p in parts if p)).rjust(8) for n, parts in content.items()})


def predict(docs: DataFrame, model: LanguageModel, *, divisor: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classifier = shared.value.classifier()
        for batch in slices(batches):
            found = [classifier.classify(t) for t in texts(batch)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(remainder("doc_id", divisor) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
