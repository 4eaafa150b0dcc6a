"""Words of whole batches of texts as 64-bit hashes, without a Python loop over words.

A word is a run of letters and digits; case, and the four kinds of i
(``ı i I İ``), make no difference.  Marks without a composed form are passed
over.  The hash of a word is a polynomial of random values of its letters,
taken from prefix sums over the whole batch, so the work is a few numpy passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

_LAST = 0x33480  # beyond it there are no letters
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: An odd multiplier for each place in an n-gram.
_PLACE = [np.uint64((0xD1342543DE82EF95 * (2 * k + 1) + 2 * (0xA0761D6478BD642F * k % (1 << 62))) % (1 << 64) | 1) for k in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(c: str) -> str:
    """The letter that stands for a letter of either case."""
    if c in "ıIİi":
        return "i"
    low = c.lower()
    return low if len(low) == 1 else low[0]


@lru_cache(1)
def _values() -> np.ndarray:
    """A random value for each letter and digit, 0 for what parts words, 1 for what is passed over."""
    code = np.zeros(_LAST + 1, np.uint64)
    for o in range(_LAST):
        if 0xD800 <= o <= 0xF8FF or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3:
            if o < 0xD800:
                code[o] = o  # ideographs and syllables: letters without case
            continue
        kind = unicodedata.category(chr(o))
        if kind[0] == "L" or kind == "Nd":
            code[o] = ord(fold(chr(o)))
        elif kind in ("Mn", "Me"):
            code[o] = 1
    values = mix(code * np.uint64(0x9E3779B97F4A7C15))
    values[code == 0] = 0
    values[code == 1] = 1
    return values


class Words(NamedTuple):
    """``hashes`` of all words in order; ``text`` of each word; ``start``, ``end`` in the joined signs; ``at`` where each text begins there."""

    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    signs: np.ndarray


def words(texts: Sequence[str | None]) -> Words:
    """The words of a batch; null and empty texts have none."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens + 1)))[: len(texts)]
    signs = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    value = _values()[np.minimum(signs, _LAST)]
    skip = value == 1
    if skip.any():
        keep = np.flatnonzero(~skip)
        value = value[keep]
    else:
        keep = None
    inside = np.concatenate(([False], value != 0))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    powers = np.full(len(value), _BASE, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)))
    powers[:] = _INV
    hashes = mix((sums[end] - sums[start]) * np.cumprod(powers, dtype=np.uint64)[start])
    if keep is not None:
        end = keep[end - 1] + 1
        start = keep[start]
    return Words(hashes, np.searchsorted(at, start, "right") - 1, start, end, at, signs)


def ngrams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words within one text, index of its first word)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * _PLACE[k]
    whole = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(total[whole]), whole
