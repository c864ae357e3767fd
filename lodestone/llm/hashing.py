"""64-bit keys of all words of a text, by whole-array arithmetic.

A word's polynomial key is taken from prefix sums: with odd P, sum(b_j * P**j) over the word's
bytes, times the inverse of P**start, does not depend on where the word stands. Everything is
modulo 2**64. Long texts are cut at white space into segments, so that the tables of powers
stay small; a word that is longer than a segment is keyed by the same sum in a loop.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
#: Bytes of a segment.
SEGMENT = 1 << 20
_SEPARATOR = np.zeros(256, np.int8)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = 1
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_tables[0])
    if have < n:
        size = max(n, 2 * have, 1 << 15)
        for k, base in enumerate((_P, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table, dtype=np.uint64)
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not ASCII white space."""
    flags = np.ones(len(a) + 2, np.int8)
    flags[1:-1] = _SEPARATOR[a]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


def _segment(a: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(a)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_keys(data: bytes | np.ndarray) -> np.ndarray:
    """The key of each word, in order."""
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if len(a) <= SEGMENT:
        return _segment(a)
    out, at = [], 0
    while at < len(a):
        end = min(len(a), at + SEGMENT)
        if end < len(a):
            spaces = np.flatnonzero(_SEPARATOR[a[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word fills the segment
                step, total, power = end, np.uint64(0), np.uint64(1)
                powers, _ = _powers(SEGMENT)
                step = at
                while step < len(a):
                    piece = a[step : step + SEGMENT]
                    stop = np.flatnonzero(_SEPARATOR[piece])
                    piece = piece[: stop[0]] if len(stop) else piece
                    with np.errstate(over="ignore"):
                        total = total + power * np.sum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], dtype=np.uint64)
                        power = power * powers[SEGMENT - 1] * _P
                    step += len(piece)
                    if len(stop):
                        break
                out.append(mix(np.array([total])))
                at = step
                continue
        out.append(_segment(a[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def prefix_keys(data: bytes, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(words, sizes): the key of each word's first bytes, for each size, and whether the word
    has that many. A prefix never has the key of a word or of a prefix of another size, but by
    chance; sizes count bytes and may end within a letter beyond ASCII."""
    a = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(a)
    keys = np.zeros((len(starts), len(sizes)), np.uint64)
    power, _ = _powers(max(sizes) + 1)
    total = np.zeros(len(starts), np.uint64)
    for j in range(max(sizes)):
        total = total + (a[np.minimum(starts + j, max(0, len(a) - 1))].astype(np.uint64) + np.uint64(1)) * power[j] if len(a) else total
        if j + 1 in sizes:
            keys[:, sizes.index(j + 1)] = mix(mix(total) + np.uint64(j + 1))
    return keys, (ends - starts)[:, None] >= np.array(sizes)


def shingle_keys(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct keys, sorted, of all runs of ``width`` words; of all words if there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    key = words[:n].copy()
    for k in range(1, width):
        key = key * _P + words[k : n + k]
    key = mix(key + np.uint64(width))
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))]
