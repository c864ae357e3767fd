"""Token ids and character spans of whole texts, from a byte-level BPE tokenizer file.

The ids are those of the ``tokenizers`` library for the file. They are computed by ``tiktoken``,
which is several times as fast, from the vocabulary in the same file, whenever that is the same
thing: plain byte-level BPE whose token numbers follow its merges. A file of another kind, a
text with a special token's string, or one with an extremely long run without a word boundary
goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the split pattern of byte-level BPE.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space or of other characters beyond this go through ``tokenizers``.
_LONG = re.compile(r"\s{20000}|\S{20000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next free from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _numbers(vocabulary: dict | list) -> list[int]:
    return list(vocabulary.values()) if isinstance(vocabulary, dict) else [len(vocabulary) - 1]


class TextEncoder:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.largest = max([*_numbers(spec["model"]["vocab"]), *(t["id"] for t in spec.get("added_tokens", []))])
        self.fast, self.lengths = self._fast(spec)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded only when a text needs it."""
        return Tokenizer.from_file(self.path)

    def _fast(self, spec: dict) -> tuple[tiktoken.Encoding | None, np.ndarray | None]:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
        if not plain:
            return None, None
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        numbers = [vocabulary.get(m.replace(" ", "", 1)) for m in merged]
        if None in numbers or numbers != sorted(numbers) or len(merged) + 256 != len(vocabulary):
            return None, None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), lengths

    def _whole(self, text: str) -> bool:
        return self.fast is None or any(s in text for s in self.special) or bool(_LONG.search(text))

    def ids(self, text: str) -> np.ndarray:
        """The ids without any added special tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False).ids if self._whole(text) else self.fast.encode_ordinary(text)
        return np.array(found, np.uint32)

    def spans(self, text: str) -> np.ndarray:
        """(tokens, 2): first character of each token and the one after its last."""
        if self._whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        ends = np.cumsum(self.lengths[np.array(self.fast.encode_ordinary(text), np.int64)])
        if not len(ends):
            return np.empty((0, 2), np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(data) == len(text):
            return np.column_stack([starts, ends])
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return np.column_stack([char[starts], char[ends - 1] + 1])


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each file and Python worker."""
    return TextEncoder(path)
