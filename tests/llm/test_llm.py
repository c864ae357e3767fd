"""Text operators against brute force, round trips and planted cases; edge rows in every column."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, html, language, licenses, near_copies, packing, quality, token_counts, toxicity, vectors
from lodestone.llm.common import LOWER
from lodestone.llm.hashing import SEGMENT, prefix_keys, word_keys
from lodestone.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, print string, component_id string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, None, None, "x") for i, t in rows], DOCS)


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def _edge_rows():
    return [(None, "a text without id, long enough to matter"), (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "é ü 漢字 🎉"), (6, "x" * 30000), (7, "again and again " * 3000), (7, "again and again " * 3000), (8, "<|endoftext|> 3 < 4")]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_word_keys_do_not_depend_on_place_or_segments():
    words = [b"a", b"bc", b"\xc3\xa9", b"x" * 50, b"bc"]
    keys = word_keys(b" ".join(words))
    assert [int(word_keys(b"\n " + w)[0]) for w in words] == keys.tolist() and keys[1] == keys[4]
    long = b"y" * (SEGMENT + 5)
    both = word_keys(b"a " * (SEGMENT // 2) + long + b" bc")
    assert both[-1] == keys[1] and both[0] == keys[0] and len(both) == SEGMENT // 2 + 2
    assert word_keys(long + b" a")[0] == word_keys(b"q " + long)[1]


def _brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_against_brute_force(spark, block):
    rng = random.Random(8)
    base = _text(rng, 90).split()
    rows = list(_edge_rows())
    for i in range(20, 80):  # a large group with zero to six edits, and copies
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i + 100, rows[i][1]) for i in range(12, 30, 3)] + [(i, _text(rng, 60)) for i in range(300, 330)]
    found = near_copies.components(_docs(spark, rows), block_docs=block).collect()
    assert len(found) == len(rows)
    wanted = _brute_components(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    kept = {r.doc_id for r in near_copies.keep(_docs(spark, rows)).collect()}
    assert kept == {i for i, c in wanted.items() if i == c} | {None}
    assert near_copies.components(_docs(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(1, _text(rng, 25)), (2, _text(rng, 90)), (3, None), (4, "too short"), (5, "")]
    spoiled = list(items[0][1])
    spoiled[30], spoiled[70] = "#", "q"
    part = " ".join(items[1][1].split()[20:75])
    rows = [(10, "before " + items[0][1].upper() + " after"), (11, _text(rng, 40) + " " + "".join(spoiled) + " tail"), (12, "x " + part), (13, _text(rng, 200)), (14, "too short")] + [(i, t) for i, t in _edge_rows() if i != 7]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(_docs(spark, rows), benchmark, block_bytes=50).collect()}
    assert found == {(10, 1), (11, 1), (12, 2)}
    left = decontamination.keep(_docs(spark, rows), benchmark)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {10, 11, 12} and left.columns == _docs(spark, []).columns
    assert decontamination.matches(_docs(spark, rows), benchmark.limit(0)).count() == 0


def test_myers_against_dynamic_programme():
    rng = random.Random(5)
    for _ in range(60):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (12, 40))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row = new
            best = min(best, row[-1])
        assert decontamination.least_distance(decontamination.letter_masks(p), len(p), t)[0] == best


def test_packing_round_trip(spark, path):
    rng = random.Random(1)
    rows = _edge_rows() + [(i, _text(rng, rng.randrange(1, 900))) for i in range(30, 70)]
    docs = _docs(spark, rows).repartition(3)
    out = packing.pack_documents(docs, path).collect()
    own = encoder(path)
    wanted = sorted((str(i), len(x := own.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.doc_tokens, r.ids_crc32) for r in out if r.length == r.doc_tokens) == [w for w in wanted if any(w == (str(r.doc_id), r.doc_tokens, r.ids_crc32) for r in out)]
    assert sum(r.length for r in out) == sum(n for _, n, _ in wanted)
    places = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in out)
    at = 0
    for place, length in places:
        assert place == at and place % 1024 + length <= 1024
        at += length
    assert packing.pack_documents(_docs(spark, []), path).count() == 0


def test_spans_equal_the_library(path):
    own = encoder(path)
    for t in ["", " ", "a  b ", "x <|endoftext|> y", "日本語 🎉 é", "\n\n x", "don't stop"]:
        found = own.tokenizer.encode(t, add_special_tokens=False)
        assert own.ids(t).tolist() == found.ids and [tuple(s) for s in own.spans(t).tolist()] == found.offsets


def test_token_counts_add_up(spark, path):
    out = token_counts.count(_docs(spark, _edge_rows()), path).collect()
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.doc_tokens, r.doc_unassigned), []).append(r.n_tokens)
    for (i, tokens, rest), counts in by.items():
        copies = 2 if i == 7 else 1
        assert sum(counts) + copies * rest == copies * tokens
    spans, starts, ends = np.array([[0, 2], [2, 5], [5, 6], [6, 9]]), np.array([0, 4, 7]), np.array([3, 6, 9])
    owner, crossing = token_counts.allocate(spans, starts, ends)
    assert owner.tolist() == [0, 0, 1, 2] and crossing.tolist() == [False, True, False, True]


def test_language(spark):
    rng = random.Random(6)
    syllables = {"aa": "ka lo mi ren tu sha".split(), "bb": "gru pfe zan ott hei lux".split()}
    make = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make("aa" if i % 2 else "bb", 40), "aa" if i % 2 else "bb") for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !!", None), (None, make("aa", 9), "aa"), (502, "", "bb")], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[None].lang_pred == "aa"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert {r.lang_pred for r in language.predict(docs, language.train(docs.limit(0))).collect()} == {"und"}


def _labelled(spark, bad):
    rng = random.Random(9)
    rows = [(i, _text(rng, 30) + (" " + bad if i % 4 == 0 else "") + " " + _text(rng, 10)) for i in range(200)]
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(150)] + [(None, 1, 1), (3, None, None)]
    return _docs(spark, rows + [(900, None), (901, ""), (None, "no id")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = _labelled(spark, "BUY!! NOW!! CLICK!! HERE!! FREE!! WIN!!")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 != 0) for i in range(200)) and all(0 <= r.score <= 1 for r in got.values())
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(200) if i % 4}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_toxicity(spark):
    docs, labels = _labelled(spark, "nasty brute nasty")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and got[900].predicted == got[901].predicted == 0
    assert (got[0].first_word, got[0].last_word) == (30, 32)
    assert {r.doc_id for r in toxicity.passages(docs, model).collect()} == {i for i in range(200) if i % 4 == 0}
    assert {r.doc_id for r in toxicity.keep(docs, model).collect()} == {i for i in range(200) if i % 4} | {900, 901, None}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_of_inflected_words(spark):
    """No inflected form occurs twice; only their stem tells."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, _text(rng, 30) + (" " + " ".join("vermaldé" + word(7) for _ in range(3)) if i % 4 == 0 else " " + word(15)) + " " + _text(rng, 10)) for i in range(400)]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400) if got[i].held_out)


def test_prefix_keys_against_slices():
    words = [w for w in "a bc defgh defghi defghij éàü xyzxyzxyz defgh".encode().split(b" ")]
    keys, has = prefix_keys(b" ".join(words), (6, 5))
    seen = {}
    for k, size in enumerate((6, 5)):
        for i, w in enumerate(words):
            assert has[i, k] == (len(w) >= size)
            if len(w) >= size:
                assert seen.setdefault((size, w[:size]), keys[i, k]) == keys[i, k]
    assert len(set(seen.values()) | set(word_keys(b" ".join(words)).tolist())) == len(seen) + len(set(words))
    assert prefix_keys(b"", (6, 5))[0].shape == (0, 2)


def test_maximal_segments_against_recursion():
    def brute(s, a, b):
        best = max(((sum(s[i : j + 1]), -(j - i), -i) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(s, a, i) + [(i, j, best[0])] + brute(s, j + 1, b)

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        got = toxicity.maximal_segments(np.array(s, float))
        assert [g[:2] for g in got] == [w[:2] for w in brute(s, 0, len(s))]


def test_licenses(spark):
    rows = [(1, "x CC-BY y. Licensed under CC BY-NC 4.0."), (2, "All Rights Reserved. all rights reserved"), (3, "Released under the terms of the MIT License"), (4, "Copyright (c) 2020 Some One. All rights reserved."), (5, "licensed under the apache licence version 2"), (6, None), (7, ""), (None, "GNU General Public License")]
    got = {r.doc_id: r for r in licenses.scan(_docs(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 1, 6, "cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[2].n_base, got[2].labels, got[2].score) == (2, "reserved", 0.5)
    assert (got[3].n_base, got[3].labels, got[3].first_word) == (0, "mit", None)
    assert got[4].labels == "copyright-notice,reserved" and got[5].labels == "" and got[6].n_words == got[7].n_words == 0 and got[None].labels == "gpl"
    made = licenses.compile_template("t", "@a a [[b c]] {{d|e f}} <<1-2>> z")
    ok = lambda s: made.match(s.encode().split(), 0) == len(s.split())
    assert ok("a d q z") and ok("a b c e f q r z") and not ok("a b d q z") and not ok("a d z") and not ok("a d q r s z")


def test_licenses_against_sql(spark):
    """Renderings of every template, whole, with one word changed, and repeated, against the regular expressions."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(21)
    rows = []
    for _, markup in licenses.TEMPLATES:
        for _ in range(6):
            words = []
            for part in licenses._PART.finditer(markup.partition(" ")[2]):
                if part["word"] or part["either"]:
                    words += rng.choice((part["word"] or part["either"]).split("|")).split()
                elif part["optional"] is not None:
                    words += part["optional"].split() if rng.random() < 0.5 else []
                else:
                    words += [rng.choice(WORDS + ["copyright"]) for _ in range(rng.randrange(int(part["low"]), int(part["high"]) + 2))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = rng.choice([" ", "\n", ", ", " -"]).join(w.upper() if rng.random() < 0.2 else w for w in words)
            rows.append((len(rows), _text(rng, 5) + " " + text + (" " + text if rng.random() < 0.3 else "") + " é " + _text(rng, 4)))
    rows += [(1000, None), (1001, ""), (1002, "cc by cc by"), (1003, "copyright copyright x all rights reserved all rights reserved"), (1004, " !! ")]
    frame = licenses.scan(_docs(spark, rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({licenses.op5_sql()}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in frame.orderBy("doc_id").collect()]
    assert got == want and {label for label, _ in licenses.TEMPLATES} <= {own for r in got for own in r[6].split(",")}


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body><header>Site name</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site, please accept</div>
    <article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text.<p>Yes.</p><aside>Related things to read today</aside><p>3 < 4 &eacute;</p><form><label>Mail</label></form></article>
    <div id="comments"><p>I liked this article very much indeed, thank you all</p></div><footer>(c) all</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "v", "<p>open <", 0), (3, "w", "", 0)], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert got[1].text == "Head & line\nFirst bold text.\nYes.\n3 < 4 é" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and len(got) == 4


@pytest.mark.parametrize("settings", [{}, {"block": 3, "leaf": 4, "shard": 16, "pilot": 8}])
def test_vectors_against_brute_force(spark, settings):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(120)] + [(200 + i, rows_, 0) for i, rows_ in enumerate([[0.5] * 6] * 9)]
    rows += [(300, None, 0), (350, [float("nan")] * 6, 0), (400, [1.0, None] + [0.0] * 4, 0), (450, [1.0, 2.0], 0), (None, [0.1] * 6, 0)]
    got = [tuple(r) for r in vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), **settings).collect()]
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    wanted = []
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(wanted)


def test_pipeline_against_its_operators(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_copies", "decontamination", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "near_copies":
            assert left == {i for i, c in _brute_components(before).items() if i == c}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
    assert out.agg(F.sum("length")).first()[0] == out.groupBy("doc_id").agg(F.first("doc_tokens").alias("n")).agg(F.sum("n")).first()[0]
