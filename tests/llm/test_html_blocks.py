"""What the tree decides by, pages without names of classes, whole pages against their articles, edge rows."""

from __future__ import annotations

import html as markup
import os
import re

import pytest

from lodestone.llm import html

LONG = "This paragraph says something at some length, so that nobody takes it for a label of the page."


def _features(node):
    return set() if node.feature < 0 else {html.FEATURES[node.feature]} | _features(node.yes) | _features(node.no)


def test_the_tree_splits_on_density_and_both_neighbours():
    used = _features(html.train())
    assert "density" in used and used & {"words_before", "density_before"} and used & {"words_after", "density_after"} and "words" in used
    assert {f for f in html.FEATURES if "words" not in f and "density" not in f} == {"furniture"}


def test_pages_without_names_of_classes():
    links = "".join(f"<div><a href=/{k}>Part {k}</a></div>" for k in range(5))
    text = lambda page: html.extract(page, html.train())
    assert text(f"<div>My site</div>{links}<h1>A heading</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>{links}<div>(c) 2020</div>") == f"A heading\n{LONG}\nYes.\n{LONG}"
    assert text("<a href=/about>About us</a>") == ""
    assert text(f"<p>Yes.</p><p>{LONG}</p>") == f"Yes.\n{LONG}"
    assert text(f"<article><p>{LONG}</p><section class='related-work'><p>Others did it too.</p></section><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div></article>") == f"{LONG}\nOthers did it too.\n{LONG}"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_pages_against_their_articles(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("needs the driver's tables")
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    wanted = {}
    for row in pages:
        inside = re.sub(r"</?b>", "", (row.html or "").partition("<article>")[2].partition("</article>")[0]).replace("<br>", " ")
        parts = [" ".join(markup.unescape(p).split()) for p in re.split(r"<[^>]*>", inside)]
        wanted[row.page_id] = "\n".join(p for p in parts if p)
    got = {r.page_id: r for r in html.op7_html(spark, f"/root/testdata/{sf}").collect()}
    assert {i: r.text for i, r in got.items()} == wanted and all(r.n_chars == len(r.text) for r in got.values())


def test_long_pages_repeated_ids_and_no_rows(spark):
    schema = "page_id long, url string, html string, text string"
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", f"<p>{LONG}</p>", "clash"), (1, "u", f"<p>{LONG}</p>", "clash"), (1, "v", "<p>Other words stand here, quite a few of them.</p>", None), (2, "w", long, None), (3, None, "<" * 5000, None)]
    got = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.text for r in got if r.page_id == 1) == sorted([LONG, LONG, "Other words stand here, quite a few of them."])
    assert next(r for r in got if r.page_id == 2).n_chars == 20_000 * (len(LONG) + 1) - 1 and len(got) == 5
    assert html.main_text(spark.createDataFrame([], schema)).collect() == []
