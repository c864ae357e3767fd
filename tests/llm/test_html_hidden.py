"""Elements without an end tag must not take the rest of the page with them."""

from __future__ import annotations

import pytest

from lodestone.llm import html

FIRST, LAST = "The first paragraph has quite a few words of its own.", "The last paragraph also has enough words to be kept."


@pytest.mark.parametrize(
    "between",
    [
        '<svg viewBox="0 0 1 1"/>', "<math/>", "<video src=a>", "<video src=a />", "<p><audio src=b></p>", "<object data=c>", "<canvas>", "<button>", "<noscript>", "<template>",
        "<video-player src=a></video-player>", "<button-group></button-group>", "<title-bar></title-bar>", "<script-list></script-list>",
        "<datalist id=d><option>no<option>never</datalist>", "<select><option>no</select>", "<option>no", "<svg><title/><path d=x /></svg>",
        "<svg><title>no</title><g><text>never</text></g></svg>", "<video><p>no</p></video>", "<button><span>no</span></button>", "<script>var a = '<p>no</p>';</script>", "<textarea><p>no</textarea>",
    ],
)
def test_the_rest_of_the_article_stays(between):
    page = f"<html><body><article><p>{FIRST}</p>{between}<p>{LAST}</p></article><footer>(c) all</footer></body></html>"
    assert html.extract(page, html.train()) == f"{FIRST}\n{LAST}"


def test_hidden_elements_inside_a_paragraph():
    page = f"<article><p>One <svg><path d=x /></svg>two <button>no</button>three <svg/>four.</p><p>{LAST}</p><script>var never = 1"
    assert html.extract(page, html.train()) == f"One two three four.\n{LAST}"
