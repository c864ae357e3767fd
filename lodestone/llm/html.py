"""Main text of web pages from flat text blocks and a small decision tree.

A page is read as a flat sequence of text blocks: text between block-level tags, with inline
markup removed. Every block has its number of words and its link density, those of the blocks
before and after it, and one mark: whether it stands in a container of furniture (navigation,
footers, adverts, notices, forms, comments and the like, by tag, role, class or id), since a short
advert can't be told from a short paragraph by counts. A CART tree, grown from the labelled table
below by Gini impurity, decides whether a block belongs to the main text. White space in a block
becomes one space; the accepted blocks are joined by one newline.

Nulls and edge cases: a null html counts as empty; a page without accepted blocks has an empty
text; broken markup (open tags, cut references, a stray "<") never fails: what cannot be read as
a tag is text; an unclosed or self-closed video, svg, button and the like loses its tag only; a null id is carried along; rows with one id are extracted each by its own html.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices

# Elements of HTML by what they mean for text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe"  # their text runs to the end tag, or to the end of the page
HIDDEN = set("noscript template svg math select datalist option button object canvas audio video".split())
FURNITURE_TAGS = set("nav footer aside form dialog menu".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter pager pagination popup "
    "promo promotion promoted replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that name furniture only as a whole name or with one of the second list.
FURNITURE_WITH = set("notice notices recommended related respond tags teaser".split())
FURNITURE_OF = set("articles box content items links list news pages posts reading stories".split())
ARTICLE_NAMES = set("article articlebody content entry entrycontent main maincontent post postbody story storybody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<title(?:\s[^>]*)?/>"
    rf"|<(?P<skip>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_HIDDEN = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})[\s/>]", re.IGNORECASE)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture")
#: The labelled table: FEATURES, then 1 for main text. No row knows of an article's tags.
LABELLED = [
    # menus, link lists, bread crumbs: linked, and so are the neighbours
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 0),
    (6, 0.83, 2, 1.0, 3, 1.0, 0, 0), (12, 1.0, 9, 1.0, 11, 1.0, 0, 0), (4, 1.0, 0, 0.0, 5, 1.0, 0, 0), (9, 0.9, 60, 0.0, 8, 1.0, 0, 0), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0), (5, 1.0, 0, 0.0, 0, 0.0, 0, 0),
    (2, 1.0, 3, 0.0, 0, 0.0, 0, 0), (3, 1.0, 90, 0.0, 0, 0.0, 0, 0), (7, 0.86, 45, 0.0, 0, 0.0, 0, 0), (14, 0.7, 3, 1.0, 9, 0.6, 0, 0), (22, 0.8, 12, 0.9, 18, 0.8, 0, 0), (4, 0.75, 6, 0.5, 4, 0.8, 0, 0),
    (2, 1.0, 0, 0.0, 5, 0.0, 0, 0), (3, 1.0, 0, 0.0, 40, 0.0, 0, 0), (8, 0.6, 2, 1.0, 60, 0.0, 0, 0), (10, 0.5, 1, 1.0, 2, 1.0, 0, 0),
    # plain lines between or beside linked ones: names of sites and menus, signatures
    (2, 0.0, 0, 0.0, 1, 1.0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0), (5, 0.0, 1, 1.0, 2, 1.0, 0, 0), (8, 0.0, 2, 1.0, 1, 1.0, 0, 0), (4, 0.0, 3, 1.0, 0, 0.0, 0, 0),
    (12, 0.0, 4, 1.0, 0, 0.0, 0, 0), (7, 0.0, 2, 1.0, 2, 1.0, 0, 0), (9, 0.3, 4, 1.0, 0, 0.0, 0, 0), (12, 0.4, 4, 1.0, 0, 0.0, 0, 0), (6, 0.0, 1, 1.0, 0, 0.0, 0, 0), (3, 0.0, 6, 0.7, 2, 1.0, 0, 0),
    (2, 0.0, 2, 1.0, 0, 0.0, 0, 0), (1, 0.0, 3, 1.0, 0, 0.0, 0, 0), (3, 0.0, 1, 1.0, 0, 0.0, 0, 0), (2, 0.0, 8, 0.9, 0, 0.0, 0, 0),
    # inside furniture by its mark, whatever the counts
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0), (25, 0.1, 40, 0.0, 60, 0.0, 1, 0), (60, 0.0, 80, 0.0, 3, 0.0, 1, 0), (120, 0.0, 30, 0.0, 45, 0.0, 1, 0), (3, 0.0, 90, 0.0, 80, 0.0, 1, 0), (40, 0.0, 55, 0.0, 62, 0.0, 1, 0),
    (14, 0.2, 100, 0.0, 12, 0.5, 1, 0), (2, 0.0, 14, 0.0, 45, 0.0, 1, 0), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0), (90, 0.02, 75, 0.0, 88, 0.0, 1, 0), (9, 0.0, 70, 0.0, 0, 0.0, 1, 0), (10, 0.0, 1, 0.0, 0, 0.0, 1, 0),
    (2, 0.0, 3, 0.0, 2, 0.0, 1, 0), (16, 0.0, 5, 0.0, 8, 0.0, 1, 0), (12, 0.0, 0, 0.0, 0, 0.0, 1, 0), (30, 0.0, 2, 1.0, 18, 0.0, 1, 0),
    # paragraphs and headings among plain text, long and short
    (80, 0.0, 9, 0.0, 95, 0.0, 0, 1), (45, 0.02, 60, 0.0, 30, 0.0, 0, 1), (15, 0.0, 80, 0.0, 2, 0.0, 0, 1), (1, 0.0, 90, 0.0, 60, 0.0, 0, 1), (2, 0.0, 4, 0.0, 1, 0.0, 0, 1), (3, 0.0, 2, 0.0, 9, 0.0, 0, 1),
    (9, 0.0, 8, 0.0, 90, 0.0, 0, 1), (12, 0.1, 50, 0.0, 9, 0.0, 0, 1), (7, 0.0, 120, 0.0, 9, 0.0, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1), (30, 0.3, 45, 0.0, 60, 0.1, 0, 1), (22, 0.45, 18, 0.2, 40, 0.0, 0, 1),
    (5, 0.0, 3, 0.0, 0, 0.0, 0, 1), (60, 0.0, 8, 0.0, 6, 0.4, 0, 1), (1, 0.0, 0, 0.0, 18, 0.0, 0, 1), (18, 0.0, 1, 0.0, 0, 0.0, 0, 1), (1, 0.0, 0, 0.0, 1, 0.0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (130, 0.0, 0, 0.0, 0, 0.0, 0, 1), (6, 0.0, 50, 0.0, 64, 0.0, 0, 1), (4, 0.0, 0, 0.0, 35, 0.0, 0, 1), (33, 0.2, 41, 0.0, 9, 0.0, 0, 1), (1, 0.0, 6, 0.0, 0, 0.0, 0, 1), (9, 0.2, 7, 0.0, 12, 0.1, 0, 1),
    # the same beside linked lines, where the other side is plain text
    (5, 0.0, 2, 1.0, 60, 0.0, 0, 1), (7, 0.0, 1, 1.0, 35, 0.0, 0, 1), (3, 0.0, 1, 1.0, 2, 0.0, 0, 1), (1, 0.0, 1, 1.0, 9, 0.0, 0, 1), (70, 0.1, 2, 1.0, 80, 0.0, 0, 1), (21, 0.0, 1, 1.0, 30, 0.0, 0, 1),
    (12, 0.0, 45, 0.0, 3, 1.0, 0, 1), (1, 0.0, 30, 0.0, 4, 1.0, 0, 1), (2, 0.0, 3, 0.0, 1, 1.0, 0, 1), (90, 0.0, 5, 1.0, 4, 1.0, 0, 1), (40, 0.0, 2, 1.0, 3, 1.0, 0, 1), (25, 0.0, 1, 1.0, 2, 1.0, 0, 1),
    (64, 0.0, 3, 1.0, 0, 0.0, 0, 1), (35, 0.05, 2, 1.0, 0, 0.0, 0, 1), (28, 0.0, 0, 0.0, 1, 1.0, 0, 1), (55, 0.1, 0, 0.0, 4, 1.0, 0, 1),
    # linked lines between paragraphs: headings and references of the article
    (3, 1.0, 70, 0.0, 85, 0.0, 0, 1), (6, 1.0, 40, 0.0, 14, 0.0, 0, 1), (2, 1.0, 9, 0.0, 33, 0.0, 0, 1), (18, 0.9, 30, 0.1, 44, 0.0, 0, 1), (1, 1.0, 11, 0.0, 12, 0.0, 0, 1), (48, 0.6, 30, 0.1, 52, 0.0, 0, 1),
]


@dataclass
class Node:
    feature: int = -1
    below: float = 0.0
    yes: Node | None = None  # feature <= below
    no: Node | None = None
    label: int = 0

    def decide(self, row) -> int:
        node = self
        while node.feature >= 0:
            node = node.yes if row[node.feature] <= node.below else node.no
        return node.label


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1, depth: int = 8) -> Node:
    """A CART tree: the split with the lowest weighted Gini impurity, first feature on ties."""
    share = labels.mean() if len(labels) else 0.0
    node = Node(label=int(share >= 0.5))
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return node
    best = 2 * share * (1 - share) * len(labels) - 1e-12
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                cost = sum(2 * len(y) * y.mean() * (1 - y.mean()) for y in (labels[left], labels[~left]))
                if cost < best:
                    best, node.feature, node.below = cost, f, float(cut)
    if node.feature >= 0:
        left = rows[:, node.feature] <= node.below
        node.yes, node.no = grow(rows[left], labels[left], least, depth - 1), grow(rows[~left], labels[~left], least, depth - 1)
    return node


def train(table: list[tuple] = LABELLED) -> Node:
    data = np.array(table, float)
    return grow(data[:, :-1], data[:, -1])


def _names(rest: str) -> tuple[set[str], set[str], bool]:
    """Words of class and id (whole names too, without separators), roles, and whether a name is furniture's."""
    words, roles, furniture = set(), set(), False
    for m in _NAMED.finditer(rest):
        value = next(g for g in m.groups()[1:] if g is not None)
        if m[1].lower() == "role":
            roles.update(value.lower().split())
        else:
            for name in value.split():
                own = {w.lower() for w in _WORD.findall(name)}
                words |= own | {re.sub(r"[-_]", "", name).lower()}
                furniture |= bool(own & FURNITURE_WITH) and not own - FURNITURE_WITH - FURNITURE_OF
    return words, roles, furniture or bool(words & FURNITURE_NAMES)


def _block_text(parts: list[str]) -> str:
    return " ".join(markup.unescape("".join(parts)).split())


def _hidden(tokens: list[re.Match]) -> dict[int, int]:
    """Where the text goes on after each closed hidden element, by its start tag's place in ``tokens``.

    An element is closed if its end tag comes before its container's; an option, which holds
    text alone, also ends at the next tag of a block. Of the others only the tag is dropped.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for k, m in enumerate(tokens):
        name = (m["name"] or "").lower()
        if not name or name in INLINE or name in VOID:
            continue
        depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), -1) if m["end"] else -1
        if stack and stack[-1][0] == "option" and name != "option" and (depth >= 0 or not m["end"]):
            out[stack.pop()[1]] = m.start()
        if depth >= 0:
            if name in HIDDEN:
                out[stack[depth][1]] = m.end()
            del stack[depth:]
        elif not m["end"] and (name in HIDDEN - {"svg", "math"} or not m["rest"].endswith("/")):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                start = stack.pop()[1]
                if name == "option":
                    out[start] = m.start()
            stack.append((name, k))
    return out


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, furniture) of each non-empty block."""
    out, parts, linked = [], [], []
    stack: list[tuple[str, int, int]] = []  # name, furniture, article (whose header is no furniture)
    state = 0
    links, at = 0, 0

    def flush() -> None:
        if parts and (text := _block_text(parts)):
            out.append((text, len(text.split()), len(_block_text(linked).split()), state))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    tokens, hidden = _TOKEN.finditer(page), {}
    if _HIDDEN.search(page):
        tokens = list(tokens)
        hidden = _hidden(tokens)
    for k, m in enumerate(tokens):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in HIDDEN:
            at = hidden.get(k, at) if not m["end"] else at
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if m["end"] else links + (not m["rest"].endswith("/"))
            if name in ("br", "img"):
                add(" ")
            continue
        flush()
        if not m["end"]:
            links = 0 if name != "a" else links
        if name in VOID or m["rest"].endswith("/"):
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if depth >= 0:
                del stack[depth:]
        else:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                stack.pop()  # these end where the next one begins
            outer = stack[-1][1:] if stack else (0, 0)
            words, roles, named = _names(m["rest"]) if "=" in m["rest"] else (set(), set(), False)
            article = outer[1] or int(name in ("article", "main") or "main" in roles or bool(words & ARTICLE_NAMES))
            furniture = outer[0] or int(name in FURNITURE_TAGS or bool(roles & FURNITURE_ROLES) or named or name == "header" and not article or name == "head")
            furniture = furniture if name not in ("html", "body") else outer[0]
            stack.append((name, int(furniture), int(article)))
        state = stack[-1][1] if stack else 0
    if at < len(page):
        add(page[at:])
    flush()
    return out


def extract(page: str, tree: Node) -> str:
    found = blocks(page)
    sides = [(0, 0.0), *((b[1], min(1.0, b[2] / b[1])) for b in found), (0, 0.0)]
    rows = [(*sides[k + 1], *sides[k], *sides[k + 2], *b[3:]) for k, b in enumerate(found)]
    return "\n".join(b[0] for b, row in zip(found, rows, strict=True) if tree.decide(row))


def main_text(pages: DataFrame, table: list[tuple] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = train(table)

    def run(batches):
        for batch in slices(batches):
            texts = [extract(h or "", tree) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
