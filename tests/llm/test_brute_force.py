"""Whole queries against plain loops on the smallest tables, held-out rows, cut pieces, edge tables."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, packing, quality, token_counts, toxicity
from lodestone.llm.common import LOWER, LOWER_ALNUM
from lodestone.llm.hashing import mix, word_keys
from lodestone.llm.tokens import encoder
from test_llm import _docs, _edge_rows, _text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def _rows(spark, sf=SF):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return docs, labels


def _fold(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def test_decontamination_against_all_distances(spark):
    rng = random.Random(14)
    items = [(k, _text(rng, n)) for k, n in enumerate((9, 22, 45))] + [(7, " ".join("".join(chr(rng.randrange(0x430, 0x44F)) for _ in range(6)) for _ in range(9)))]
    rows = []
    for n in range(36):
        text = rng.choice(items)[1]
        letters = list(text)
        for _ in range(rng.randrange(14)):
            letters[rng.randrange(len(letters))] = rng.choice("abз  ")
        rows.append((n, _text(rng, 6) + " " + "".join(letters)[: rng.choice([60, 400])] + " " + _text(rng, 5)))
    settings = {"window": 160, "piece": 16, "least_words": 5, "least_bytes": 48}

    def least(pattern, text):
        row = list(range(len(pattern) + 1))
        best = row[-1]
        for c in text:
            new = [0]
            for i, x in enumerate(pattern):
                new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row, best = new, min(best, new[-1])
        return best

    wanted = {}
    for doc, text in rows:
        small = decontamination.reduced(text.encode()).decode()
        for item, own in items:
            hits = [d for p in decontamination.passages_of(0, own.encode(), **settings) if (d := least(p.letters, small)) <= p.budget]
            if hits:
                wanted[doc, item] = (min(hits), len(hits))
    docs, benchmark = _docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(wanted) and 8 < len({d for d, _ in wanted}) < 36
    assert {(r.doc_id, r.item_id): r.n_passages for r in found} == {k: n for k, (_, n) in wanted.items()}
    assert all(r.distance >= wanted[r.doc_id, r.item_id][0] for r in found)
    assert {r.doc_id for r in decontamination.keep(docs, benchmark).collect()} == {d for d, _ in rows} - {d for d, _ in wanted}


def test_decontamination_of_ids(spark):
    item = "seven words stand in this test item, no more and no less than that"
    rows = [(None, item), (1, "x " + item), (1, item.replace("less", "lees")), (2, "other"), (3, None)]
    benchmark = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.distance) for r in decontamination.matches(_docs(spark, rows), benchmark).collect()), key=repr)
    assert found == [(1, 5, 0), (1, None, 0)]
    assert sorted(r.doc_id for r in decontamination.keep(_docs(spark, rows), benchmark).collect()) == [2, 3]


def test_token_counts_against_characters(spark, path):
    own = encoder(path).tokenizer
    rows = [*_rows(spark)[0], *spark.createDataFrame([(i, t, "s", None) for i, t in _edge_rows()] + [(900, "a\r\nb\n\n  c日本\n", None, "x y")], "doc_id long, text string, source string, lang string").collect()]
    wanted = Counter()
    for doc_id, text, source, lang in rows:
        fields = [source or "", lang or ""]
        parts = [("source", 0, fields[0]), ("lang", 0, fields[1]), *(("text", k, line) for k, line in enumerate((text or "").split("\n")))]
        whole, at, spans, owner = " ".join(fields) + "\n" + (text or ""), 0, [], []
        for k, (_, _, part) in enumerate(parts):
            spans.append((at, at + len(part)))
            owner += [k] * len(part) + [-1]
            at += len(part) + 1
        got, crossed, rest = Counter(), Counter(), 0
        tokens = own.encode(whole, add_special_tokens=False).offsets
        for a, b in tokens:
            shares = Counter(o for o in owner[a:b] if o >= 0)
            if not shares:
                rest += 1
                continue
            best = min(shares, key=lambda o: (-shares[o], o))
            got[best] += 1
            crossed[best] += a < spans[best][0] or b > spans[best][1]
        for k, (name, n, _) in enumerate(parts):
            wanted[(doc_id, name, n, *spans[k], got[k], crossed[k], len(tokens), rest)] += 1
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, source string, lang string")
    assert Counter(map(tuple, token_counts.count(frame, path).collect())) == wanted
    assert token_counts.count(frame.limit(0), path).collect() == []


def test_every_piece_of_packing(spark, path):
    own = encoder(path).tokenizer
    rows = [(r.doc_id, r.text) for r in _rows(spark)[0]] + _edge_rows()
    ids = Counter()
    for i, t in rows:
        ids[(i, np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())] += 1
    pieces = packing.pack_documents(_docs(spark, rows).repartition(5), path).collect()
    assert any(p.start for p in pieces)
    place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at, found, k = 0, Counter(), 0
    while k < len(place):  # the pieces of a document follow each other
        first, parts = place[k], []
        while not parts or k < len(place) and place[k].start:
            p = place[k]
            assert p.sequence_id * 1024 + p.offset == at and p.offset + p.length <= 1024 and p.start == sum(q.length for q in parts)
            assert (p.doc_id, p.doc_tokens) == (first.doc_id, first.doc_tokens)
            parts.append(p)
            at += p.length
            k += 1
        whole = [data for i, data in ids if i == first.doc_id and len(data) == 4 * first.doc_tokens and all(zlib.crc32(data[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in parts)]
        assert sum(p.length for p in parts) == first.doc_tokens and len(whole) == 1
        found[(first.doc_id, whole[0])] += 1
    assert found == ids


@pytest.mark.parametrize("letter", ["x", " ", "\n", "é", "!"])
def test_ids_of_long_runs(path, letter):
    own = encoder(path)
    for n in (19_999, 20_000, 20_001):
        text = "a " + letter * n + " b"
        assert own.ids(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def _quality_slots(text, bits):
    """The slots of one text, word by word."""
    marks = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    data = text.encode()
    words = data.translate(LOWER).split()
    shape = re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[\t-\r]", b" ", re.sub(rb"[0-9]", b"0", data)))), flags=re.DOTALL)
    out = []
    with np.errstate(over="ignore"):
        for k, parts in enumerate((words, shape.split())):
            keys = [word_keys(w)[0] for w in parts]
            out += [int(key * marks[k] >> np.uint64(64 - bits)) for key in keys]
            for a, b, x, y in zip(keys, keys[1:], parts, parts[1:], strict=False):
                out.append(int((marks[3] if k == 0 and x == y else mix(np.array([a * marks[2 + k] + b]))[0]) >> np.uint64(64 - bits)))
    return out, len(words)


def test_quality_against_plain_ftrl(spark):
    docs, labels = _rows(spark)
    bits = 18
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), bits=bits)
    rows = []
    for doc_id, text, *_ in docs:
        if doc_id in labels and labels[doc_id].quality in (0, 1) and _fold(doc_id, 5) != 0:
            found, n = _quality_slots(text or "", bits)
            counts = sorted(Counter(found).items())
            rows.append((np.array([s for s, _ in counts], np.int64), [float(np.float32(c / max(1, n))) for _, c in counts], labels[doc_id].quality))
    rows.sort(key=lambda r: (len(r[0]), r[2], r[0][:8].tolist(), r[0].tobytes()))
    z, total, order = Counter(), Counter(), np.random.default_rng(11)
    weight = lambda s: 0.0 if abs(z[s]) <= 1e-4 else -(z[s] - np.sign(z[s]) * 1e-4) / ((0.05 + total[s] ** 0.5) / 1.0 + 1e-4)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            held = [*zip(rows[i][0].tolist(), rows[i][1], strict=True), (1 << bits, 1.0)]
            w = {s: weight(s) for s, _ in held}
            p = 1 / (1 + np.exp(-np.clip(sum(w[s] * v for s, v in held), -40, 40)))
            for s, v in held:
                g = (p - rows[i][2]) * v
                z[s] += g - ((total[s] + g * g) ** 0.5 - total[s] ** 0.5) / 1.0 * w[s]
                total[s] += g * g
    assert abs(weight(1 << bits) - model.intercept) < 1e-6 and len(rows) > 50
    assert all(abs(weight(s) - model.weights[s]) < 1e-6 for s in list(z)[:5000] if s < 1 << bits)
    got = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    for doc_id, text, *_ in docs:
        found, n = _quality_slots(text or "", bits)
        score = 1 / (1 + np.exp(-np.clip(weight(1 << bits) + (sum(weight(s) for s in found) / n if n else 0), -40, 40)))
        assert abs(got[doc_id].score - score) < 1e-6 and got[doc_id].predicted == (got[doc_id].score >= 0.3) and got[doc_id].held_out == (_fold(doc_id, 5) == 0)


def _forms(word):
    return [(0, word), *((k + 1, word[:n]) for k, n in enumerate(toxicity.PREFIXES) if len(word) >= n)]


def test_toxicity_against_plain_loops(spark):
    docs, labels = _rows(spark, SF.replace("0.001", "0.01"))
    sf = SF.replace("0.001", "0.01")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    sample = {}
    for doc_id, text, *_ in docs:
        if doc_id in labels and labels[doc_id].toxic in (0, 1) and _fold(doc_id, 3) != 1:
            sample[text] = max(sample.get(text, 0), labels[doc_id].toxic)
    counts = (Counter(), Counter())
    for text, y in sample.items():
        for form in {f for w in (text or "").encode().translate(LOWER_ALNUM).split() for f in _forms(w)}:
            counts[y][form] += 1
    value = {}
    for order in range(5):
        clean, toxic = (sum(n for f, n in c.items() if f[0] == order) for c in counts)
        prior = min(5000.0, 0.05 * (clean + toxic))
        for form in {f for c in counts for f in c if f[0] == order}:
            alpha = prior * (counts[0][form] + counts[1][form]) / (clean + toxic)
            a, b = counts[1][form] + alpha, counts[0][form] + alpha
            low = np.log(a / (toxic + prior - a)) - np.log(b / (clean + prior - b)) - toxicity.CREDIBLE * np.sqrt(1 / a + 1 / b)
            if low > 0.25:
                value[form] = low - 0.5
    assert len(value) == len(model.keys) > 3 and np.allclose(sorted(value.values()), sorted(model.values))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    for doc_id, text, *_ in docs[:250]:
        words = (text or "").encode().translate(LOWER_ALNUM).split()
        scores = [next((value[f] for f in _forms(w) if f in value), -0.5) for w in words]
        found, at = [], 0
        while at < len(scores):  # maximal segments of a run that never falls to nothing
            if scores[at] <= 0:
                at += 1
                continue
            end, total = at, 0.0
            while end < len(scores) and total + scores[end] > 0:
                total += scores[end]
                end += 1
            found += _segments(scores, at, end)
            at = end
        n = len(scores)
        evalue = sorted(model.k * n * np.exp(-model.scale * s) for _, _, s in found)
        features = [0.0, 0.0, 0.0]
        if found:
            joint = max([0.0, *(k * np.log(k / max(1e-12, e)) - k + max(1e-12, e) for k, e in enumerate(evalue, 1) if max(1e-12, e) < k)])
            features = [min(40.0, max(0.0, model.scale * max(s for *_, s in found) - np.log(max(1.0, model.k * n)))), np.log1p(joint), np.log1p(sum(e <= 0.01 for e in evalue))]
        wanted = 1 / (1 + np.exp(-np.clip(np.dot([*features, 1.0], model.weights), -40, 40)))
        assert abs(got[doc_id].score - wanted) < 1e-6 and got[doc_id].passages == sum(e <= 0.01 for e in evalue)


def _segments(scores, a, b):
    """Best part, then the best parts beside it."""
    best = max(((sum(scores[i : j + 1]), i, j) for i in range(a, b) if scores[i] > 0 for j in range(i, b) if scores[j] > 0), key=lambda x: (round(x[0], 12), x[2] - x[1]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    return _segments(scores, a, best[1]) + [(best[1], best[2], best[0])] + _segments(scores, best[2] + 1, b)


@pytest.mark.parametrize("name, module, label, divisor, fold", [("quality", quality, "quality", 5, 0), ("toxicity", toxicity, "toxic", 3, 1)])
def test_held_out_rows(spark, name, module, label, divisor, fold):
    sf = SF.replace("0.001", "0.1")
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    query = quality.op8_quality if name == "quality" else toxicity.op6_toxicity
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    counts = {(r.y, r.predicted): r["count"] for r in query(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("y", "predicted").count().collect()}
    found = lambda y: counts.get((y, y), 0) / max(1, counts.get((y, 0), 0) + counts.get((y, 1), 0))
    assert found(0) > (0.9 if name == "quality" else 0.98) and found(1) > (0.98 if name == "quality" else 0.8)


def test_samples_are_bounded_in_rows(spark):
    from lodestone.llm.common import labelled_sample

    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(5000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] * 2 + [(None, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 3, 1, 10).count() == 10


def test_stages_bear_edge_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, __id long, component_id long, print binary"
    rows = [(i, t, None, None, None, None, None, None, None, None) for i, t in _edge_rows()] + [(50, "z " * 200_000, "en", "s", 1, 0.5, 1, 2, 3, b"x")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            kept = out.collect()
            if name != "packing":
                assert out.columns == frame.columns and {r.doc_id for r in kept} <= {r[0] for r in rows}
            else:
                assert sum(r.length for r in kept) == sum(n for n in {(r.doc_id, r.doc_tokens, r.sequence_id, r.offset): r.doc_tokens for r in kept if r.start == 0}.values())
