"""Language identification against compression one by one, held-out accuracy, and edge rows."""

from __future__ import annotations

import os
import zlib

import pytest

from lodestone.llm import language

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_query_against_brute_force_and_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = docs.select("doc_id", "text", "lang").collect()
    found = {r.doc_id: r for r in language.op3_language(spark, SF).collect()}
    assert len(found) == len(rows)
    own = model.classifier()
    right = total = 0
    for doc_id, text, lang in rows:
        got = found[doc_id]
        assert got.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        data = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        small = b" ".join("".join(c if c.isalpha() or not c.isascii() else " " for c in (text or "")).translate({k: k + 32 for k in range(65, 91)}).encode().split())
        assert small == language.reduced(data)
        sizes = [sum(len(c.compress(small[i : i + 8192])) for i in range(0, max(1, len(small)), 8192)) for c in own.compressors]
        assert got.lang_pred == own.languages[sizes.index(min(sizes))]
        if got.held_out and lang is not None:
            right, total = right + (got.lang_pred == lang), total + 1
    assert total > 100 and right >= 0.98 * total


def test_edge_rows(spark):
    rows = [(k, ("sol luna mar " if k % 2 else "wald berg tal ") * 6, "es" if k % 2 else "de", "clash") for k in range(40)] + [(40, "x", "tiny", None), (41, "x", "tiny", None), (43, "x", "tiny", None)]
    rows += [(50, "luna mar " * 60_000, None, None), (51, "luna mar sol luna mar", None, None), (51, "wald berg tal wald", None, None), (52, "", "es", None), (53, None, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.train(docs)
    assert set(model.dictionaries) == {"es", "de", "tiny"}
    got = language.predict(docs, model).collect()
    by = lambda i: sorted(r.lang_pred for r in got if r.doc_id == i)
    assert len(got) == len(rows) and by(50) == ["es"] and by(51) == ["de", "es"] and by(52) == by(53) == ["und"]
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id < 40} == {i: lang for i, _, lang, _ in rows if i < 40}
    assert language.predict(docs.limit(0), model).collect() == []
    assert language.Classifier(language.LanguageModel({"a": b"same text here", "b": b"same text here"})).classify(b"same text")[0] == "a"
