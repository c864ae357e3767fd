"""Every language that has rows is learned, however many there are."""

from __future__ import annotations

from lodestone.llm import language


def test_more_than_two_hundred_languages(spark):
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(12 * k + j, f"{name(k)}{name(7 * k + 3)} " * 5, f"l{k:03d}") for k in range(230) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert set(model.dictionaries) == {r[2] for r in rows}
    late = docs.filter("lang >= 'l200'")
    assert {r.doc_id: r.lang_pred for r in language.predict(late, model).collect()} == {i: lang for i, _, lang in rows if lang >= "l200"}
