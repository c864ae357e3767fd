"""Items without spaces, and copied parts of items of one to one and a half windows."""

from __future__ import annotations

import random

from lodestone.llm.decontamination import Matcher

SETTINGS = {"window": 160, "piece": 16, "least_words": 5}


def test_items_without_spaces_are_searched():
    rng = random.Random(1)
    item = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40))
    found = Matcher([(1, item.encode()), (2, "四字成語".encode())], least_bytes=48, **SETTINGS).find(f"前文 {item} 四字成語".encode())
    assert found == {0: (0, 1, 7)}
    assert Matcher([(1, item[:15].encode())], least_bytes=48, **SETTINGS).find(item.encode()) == {}


def test_parts_of_middle_items_are_found():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(27)]
    item = " ".join(words).encode()
    assert 160 < len(item) <= 240
    other = b" ".join(b"zz%d" % i for i in range(30))
    matcher = Matcher([(1, item)], least_bytes=48, **SETTINGS)
    assert set(matcher.find(item[:162] + b" " + other)) == set(matcher.find(other + b" " + item[-162:])) == {0}
    assert matcher.find(item[:100] + b" " + other) == {}
    assert any(p.text == item for p in matcher.passages)
