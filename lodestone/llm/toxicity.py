"""Toxicity by maximum-scoring segments of token log-odds.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, lower-cased. On a bounded
sample of labelled rows each word gets the log-odds ratio of toxic against other documents
under an informative Dirichlet prior (the pooled counts); its lower credible bound, less a
penalty, is its score. Words' prefixes of several sizes are tokens too, each size with its own
totals, since inflected and compound words are too rare one by one: a word without clear
evidence takes the score of its longest prefix with some, and the penalty alone if there is
none. A linear scan finds every maximal-scoring segment (disjoint passages none of whose
extensions or parts score higher). Segment scores are calibrated by extreme-value statistics:
lambda solves sum(p * exp(lambda * s)) = 1 over clean words, K is counted from clean documents,
and a passage of score S in n words has E-value K * n * exp(-lambda * S). As the number of
passages that score S or more is Poisson with that mean, a document's passages together have the
evidence max over k of -log P(k or more at the k-th best score). A document's score is a logistic
map of its best calibrated score, that evidence and the number of its significant passages.

Nulls and edge cases: a null text counts as empty, has no passage and gets the logistic map's
value for none; a null id is carried along, is not held out and never trains; rows with one id
are scored each by its own text; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER_ALNUM, labelled_sample, newton_logistic, remainder, sigmoid, slices, texts
from lodestone.llm.hashing import prefix_keys, word_keys
from lodestone.sources.storage import Scratch

#: Words whose evidence lies within this many standard errors of none are neutral.
CREDIBLE = 2.576
#: Bytes of the prefixes that are tokens, longest first.
PREFIXES = (8, 7, 6, 5)


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + prefixes): the keys of each word and of its prefixes, and which of them it has."""
    plain = text.translate(LOWER_ALNUM)
    words = word_keys(plain)
    keys, has = prefix_keys(plain, PREFIXES)
    return np.column_stack([words, keys]), np.column_stack([np.ones(len(words), np.bool_), has])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments, in linear time.

    Only positive entries start work: ``low`` and ``high`` are the running totals before and
    after each. A new candidate swallows earlier ones back to the nearest that starts lower,
    whenever it also ends higher.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    stack: list[list] = []  # first, last, low, high, index of the nearest candidate with a lower start
    for i, low, high in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist(), strict=True):
        new = [i, i, low, high, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    penalty: float = 0.5
    scale: float = 1.0  # lambda
    k: float = 1.0
    weights: np.ndarray | None = None
    evalue: float = 0.01

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, np.bool_)
        self.seen[self.keys >> np.uint64(44)] = True

    def word_items(self, text: bytes) -> np.ndarray:
        """The place of each word's token among ``keys``: its own, else its longest prefix's; else -1."""
        keys, has = tokens(text)
        found = np.full(len(keys), -1)
        if not len(self.keys):
            return found
        for k in range(keys.shape[1]):
            some = np.flatnonzero((found < 0) & has[:, k] & self.seen[keys[:, k] >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, keys[some, k]), len(self.keys) - 1)
            same = self.keys[place] == keys[some, k]
            found[some[same]] = place[same]
        return found

    def word_scores(self, text: bytes) -> np.ndarray:
        return self.scores_of(self.word_items(text))

    def scores_of(self, items: np.ndarray) -> np.ndarray:
        return np.append(self.values, -self.penalty)[items]

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float, float]], int]:
        """(first word, last word, score, E-value) of every maximal segment, and the words."""
        scores = self.word_scores(text)
        n = len(scores)
        return [(a, b, s, float(self.k * n * np.exp(-self.scale * s))) for a, b, s in maximal_segments(scores)], n

    def describe(self, found: list[tuple[int, int, float, float]], n: int) -> tuple[float, float, float]:
        if not found:
            return 0.0, 0.0, 0.0
        best = max(f[2] for f in found)
        mean = np.maximum(1e-12, np.sort([f[3] for f in found]))  # E-values, the best passage's first
        k = np.arange(1, len(mean) + 1)
        joint = float(np.max(np.where(mean < k, k * np.log(k / mean) - k + mean, 0.0)))  # Chernoff's bound of the Poisson tail
        return min(40.0, max(0.0, self.scale * best - np.log(max(1.0, self.k * n)))), float(np.log1p(joint)), float(np.log1p(sum(f[3] <= self.evalue for f in found)))

    def probability(self, found: list[tuple[int, int, float, float]], n: int) -> float:
        if self.weights is None:
            return 0.0
        return float(sigmoid(np.append(self.describe(found, n), 1.0) @ self.weights))


def lower_bound(toxic: Column, clean: Column, all_toxic: float, all_clean: float, prior: float) -> Column:
    """The lower credible bound of a token's log-odds ratio, under a Dirichlet prior of the pooled counts."""
    alpha = (toxic + clean) * F.lit(prior / (all_toxic + all_clean))
    a, b = toxic + alpha, clean + alpha
    ratio = F.log(a / (F.lit(all_toxic + prior) - a)) - F.log(b / (F.lit(all_clean + prior) - b))
    return ratio - F.lit(CREDIBLE) * F.sqrt(1 / a + 1 / b)


def train(docs: DataFrame, labels: DataFrame, *, bound: int = 6000, prior: float = 5000.0, penalty: float = 0.5, least: float = 0.25, divisor: int = 3, held_out: int = 1) -> ToxicityModel:
    """Fits on at most ``bound`` labelled rows; equal texts count once.

    Tokens are counted by the documents that hold them, and weighed, on the executors; those
    whose lower bound exceeds ``least`` reach the driver, each of which needs several toxic
    documents of the sample. A second pass over the same rows brings one small row for each
    sampled document for the calibration.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled_sample(docs, labels, "toxic", divisor, held_out, bound).groupBy("text").agg(F.max("label").alias("label")))

    def count(batches):
        for batch in slices(batches):
            parts = []
            for y, text in zip(batch.column(1).to_pylist(), texts(batch), strict=True):
                keys, has = tokens(text)
                for order in range(keys.shape[1]):
                    u = np.unique(keys[has[:, order], order])
                    parts.append((u, np.full(len(u), order), np.full(len(u), y), np.full(len(u), 1 - y)))
            if parts:
                key, order, toxic, clean = (np.concatenate([p[k] for p in parts]) for k in range(4))
                u, first, at = np.unique(key, return_index=True, return_inverse=True)
                total = lambda n: pa.array(np.bincount(at, n, len(u)).astype(np.int64))
                yield pa.record_batch([pa.array(order[first].astype(np.int32)), pa.array(u.view(np.int64)), total(toxic), total(clean)], names=["order", "key", "toxic", "clean"])

    counts = scratch.save(sample.mapInArrow(count, "order int, key long, toxic long, clean long").groupBy("order", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = {r["order"]: (float(r["toxic"]), float(r["clean"])) for r in counts.groupBy("order").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    if 0 not in totals or not all(totals[0]):
        scratch.keep_only()
        return ToxicityModel()
    value = F.lit(None).cast("double")
    for own, (all_t, all_c) in totals.items():
        if all_t and all_c:
            few = min(prior, 0.05 * (all_t + all_c))  # a small sample must not drown in its prior
            value = F.when(F.col("order") == own, lower_bound(F.col("toxic"), F.col("clean"), all_t, all_c, few)).otherwise(value)
    picked = counts.select("key", value.alias("value")).filter(F.col("value") > least).toArrow()
    key, value = picked.column(0).to_numpy(), picked.column(1).to_numpy()
    by_key = np.argsort(key.view(np.uint64))
    model = ToxicityModel(key.view(np.uint64)[by_key], value[by_key] - penalty, penalty)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in slices(batches):
            label, rows = batch.column(1).to_pylist(), []
            for y, text in zip(label, texts(batch), strict=True):
                items = shared.value.word_items(text)
                rows.append((len(items), [s for _, _, s in maximal_segments(shared.value.scores_of(items))], [] if y else items[items >= 0]))
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["label", "n", "segments", "items"])

    rows = sample.mapInArrow(measure, "label int, n long, segments array<double>, items array<long>").toArrow().to_pylist()
    scratch.keep_only()
    clean = [r for r in rows if r["label"] == 0]
    # lambda and K from clean documents: positive words are rare, so each gets half a count more
    p = np.bincount(np.concatenate([np.array(r["items"], np.int64) for r in clean]), minlength=len(model.keys)) + 0.5
    p = p / (sum(r["n"] for r in clean) + 0.5 * len(p))
    model.scale = _scale(p, model.values, max(1e-9, 1 - p.sum()), -penalty)
    floor = 1.0
    hits = sum(sum(s >= floor for s in r["segments"]) for r in clean)
    model.k = float((hits + 1) * np.exp(model.scale * floor) / max(1, sum(r["n"] for r in clean)))
    points = [[(0, 0, s, model.k * r["n"] * np.exp(-model.scale * s)) for s in r["segments"]] for r in rows]
    x = np.array([model.describe(f, r["n"]) for f, r in zip(points, rows, strict=True)])
    model.weights = newton_logistic(x, np.array([r["label"] for r in rows], float))
    return model


def _scale(p: np.ndarray, s: np.ndarray, rest: float, low: float) -> float:
    """The positive root of sum(p * exp(x * s)) + rest * exp(x * low) = 1."""
    if not len(s) or s.max() <= 0 or p @ s + rest * low >= 0:
        return 1.0
    a, b = 1e-6, 50.0
    for _ in range(100):
        m = (a + b) / 2
        a, b = (m, b) if np.log(p @ np.exp(np.clip(m * s, -700, 700)) + rest * np.exp(m * low)) < 0 else (a, m)
    return float(a)


def score(docs: DataFrame, model: ToxicityModel, *, divisor: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (significant), first_word, last_word (of the best)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            p, count, first, last = [], [], [], []
            for text in texts(batch):
                found, n = shared.value.passages(text)
                best = max(found, key=lambda f: (f[2], -f[0]), default=(None, None))
                p.append(shared.value.probability(found, n))
                count.append(sum(f[3] <= shared.value.evalue for f in found))
                first.append(best[0])
                last.append(best[1])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "passages", "first_word", "last_word"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(remainder("doc_id", divisor) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages long, first_word long, last_word long")


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, first_word, last_word, score, e_value of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for f in shared.value.passages(t)[0] if f[3] <= shared.value.evalue]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64())], names=["doc_id", "first_word", "last_word", "score", "e_value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word long, last_word long, score double, e_value double")


def keep(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            mask = [shared.value.probability(*shared.value.passages(t)) < threshold for t in texts(batch)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
