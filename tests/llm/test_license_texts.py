"""Notices and whole licences as they are written, the length that the SQL allows, and edge rows."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import licenses

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License 2.0", {"apache-2.0"}), (GPL3, {"gpl-3.0"}), (GPL3.replace("General", "Lesser General").replace("version 3", "version 2.1"), {"lgpl-2.1"}),
    (ISC, {"isc"}), (ISC.replace("ALL IMPLIED", "MOST IMPLIED"), set()), ("This is free and unencumbered software released into the public domain.", {"unlicense"}), (GPL3.replace("any later", "no later"), set()),
])
def test_notices(text, labels):
    assert {label for *_, label in licenses.Scanner().scan(text.encode())[2]} == labels


def test_templates_fit_the_regular_expressions():
    """The SQL takes 251 words from a start."""
    for _, markup in licenses.TEMPLATES:
        longest = 0
        for part in licenses._PART.finditer(markup.partition(" ")[2]):
            longest += int(part["high"]) if part["high"] else max(len(c.split()) for c in (part["word"] or part["optional"] or part["either"]).split("|"))
        assert longest <= 251


def test_steps_that_are_forgotten_are_made_again(monkeypatch):
    rng = random.Random(4)
    words = [rng.choice([b"copyright", b"c", b"all", b"rights", b"reserved", b"x", b"y"]) for _ in range(3000)]
    made = licenses.compile_template("t", "@copyright copyright [[c]] <<1-8>> all rights reserved")
    whole = [made.match(words, k) for k in range(len(words))]
    monkeypatch.setattr(licenses, "MOST_STEPS", 7)
    again = licenses.compile_template("t", "@copyright copyright [[c]] <<1-8>> all rights reserved")
    assert [again.match(words, k) for k in range(len(words))] == whole and max(whole) > 0 and len(again.known) <= 7


def test_edge_rows(spark):
    schema = "doc_id long, text string, labels string, score int"
    rows = [(1, "filler " * 100_000 + "all rights reserved", None, 1), (2, "cc by", "x", None), (2, "cc by", "x", None), (2, "mit", None, None), (None, None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels) for r in got), key=repr) == sorted([(1, 100_003, 1, 100_000, "reserved"), (2, 2, 1, 0, "cc-by"), (2, 2, 1, 0, "cc-by"), (2, 1, 0, None, ""), (None, 0, 0, None, "")], key=repr)
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
