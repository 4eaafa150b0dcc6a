"""The plain form of a text: what a reader sees, spelled one way.

Visually equal spellings are brought together: composed letters, ordinary
spaces and hyphens, ASCII digits, letters of one script per word, nothing
invisible.  Signs with a meaning of their own stay: subscripts, superscripts,
fractions, the degree sign, Greek letters used as symbols, curly quotes, long
dashes, the ellipsis, circumflexed letters and words truly in another script.

The script step works as UTS 39 describes it: every letter has a resolved
script set (its own script plus the scripts that hold a look-alike of it); the
sets of a word are intersected.  An empty intersection leaves the word as it is
(``Δt``); one script left selects the spelling in that script (mixed-script
confusable); several scripts left make the word a whole-script confusable,
decided by the nearest words whose script is certain.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from kavak.functions.lookalikes import CYRILLIC_LATIN, GREEK_LATIN

LATIN_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_LATIN.items())}
LATIN_GREEK = {v: k for k, v in reversed(GREEK_LATIN.items())}
# Compatibility kinds whose signs only look different.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Signs that show nothing although they are no format characters.
BLANK = "͏ᅟᅠ឴឵ㅤﾠ"


def _is_invisible(c: str) -> bool:
    o = ord(c)
    kind = unicodedata.category(c)
    return (
        kind == "Cf"
        or c in BLANK
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
        or 0x180B <= o <= 0x180F
        or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85")
    )


def _one(c: str) -> str | None:
    """What a sign becomes on its own; None if it stays."""
    if _is_invisible(c):
        return ""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return None if c == " " else " "
    if c in "‐‑﹣－":
        return "-"
    parts = unicodedata.decomposition(c)
    if kind == "Nd" and c > "9":
        return str(unicodedata.decimal(c))
    if parts.startswith(SAME_LOOK):
        return unicodedata.normalize("NFKC", c)
    if parts.startswith("<compat>"):
        flat = unicodedata.normalize("NFKC", c)
        # ligatures and joined letters are letters only; the ellipsis and the like are not
        return flat if kind[0] == "L" and flat.isalpha() else None
    return None


@lru_cache(1)
def _single_map() -> dict[int, str]:
    """The signs that change on their own, from the character database."""
    out = {}
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xE000 <= o <= 0xF8FF or 0x20000 <= o <= 0x3FFFF or o >= 0xF0000:
            continue
        t = _one(chr(o))
        if t is not None:
            out[o] = t
    out.update({o: "" for o in (*range(9), *range(0x0E, 0x20), 0x7F)})
    return out


#: Text made only of these signs is plain: the query engine can test it with the same class.
SAFE = "\\t\\n\\r\\x20-\\x7e°½¼¾²³¹ÇĞİÖŞÜçğıöşüÂÎÛâîûÄäßÀàÈèÉéÊêËëÔôÏïÙùŒœÑñÁáÍíÓóÚúƏə“”‘’„—–…•·−×÷→≤≥≠±₀-₉ΔλβγμπσΩΣ"
UNSAFE = f"[^{SAFE}]"
_FOREIGN = re.compile("[Ͱ-ԯᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟ]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*", re.UNICODE)
_DOTTED = re.compile("([ijіј])̇")

L, C, G = 1, 2, 4


@lru_cache(65536)
def _scripts(c: str) -> tuple[int, int]:
    """(own script, scripts in which it has a spelling); 0 for signs of any script."""
    o = ord(c)
    if 0x0370 <= o <= 0x03FF or 0x1F00 <= o <= 0x1FFF:
        return G, G | (L if c in GREEK_LATIN else 0)
    if 0x0400 <= o <= 0x052F or 0x1C80 <= o <= 0x1C8F or 0x2DE0 <= o <= 0x2DFF or 0xA640 <= o <= 0xA69F:
        return C, C | (L if c in CYRILLIC_LATIN else 0)
    if c.isalpha() and (o < 0x0250 or 0x1E00 <= o <= 0x1EFF):
        return L, L | (C if c in LATIN_CYRILLIC else 0) | (G if c in LATIN_GREEK else 0)
    return 0, 7


def _spell(word: str, script: int) -> str:
    if script == L:
        return "".join(CYRILLIC_LATIN.get(c) or GREEK_LATIN.get(c, c) for c in word)
    table = LATIN_CYRILLIC if script == C else LATIN_GREEK
    own = C if script == C else G
    return "".join(c if _scripts(c)[0] in (own, 0) else table.get(c, c) for c in word)


def _word_scripts(word: str) -> tuple[int, int]:
    """(union of own scripts, intersection of resolved script sets)."""
    own, both = 0, 7
    for c in word:
        o, s = _scripts(c)
        own |= o
        both &= s
    return own, both


def _in_word(c: str) -> bool:
    return c.isalpha() or "\u0300" <= c <= "\u036f"


def _unify(text: str) -> str:
    """One script for each word; see the module's head."""
    out, last, words = [], 0, []
    for m in _FOREIGN.finditer(text):
        a, b = m.span()
        if a < last:
            continue
        while a > last and _in_word(text[a - 1]):
            a -= 1
        while b < len(text) and _in_word(text[b]):
            b += 1
        w = text[a:b]
        own, both = _word_scripts(w)
        if not own & (C | G):
            continue
        new = w
        if own in (C, G):
            if both & L:  # every letter has a Latin look-alike: the neighbours decide
                if own == G and len(w) == 1:
                    continue  # a letter used as a symbol
                words = words or [(x.start(), _certain(x.group())) for x in _WORD.finditer(text)]
                i = bisect_left(words, (a,))
                near = [words[j][1] for j in (i - 1, i + 1) if 0 <= j < len(words) and words[j][1]]
                far = next((words[j][1] for d in range(2, 9) for j in (i - d, i + d) if 0 <= j < len(words) and words[j][1]), L)
                if own not in (near or [far]):
                    new = _spell(w, L)
        elif both & L:
            new = _spell(w, L)
        elif both in (C, G):
            new = _spell(w, both)
        elif sum(_scripts(c)[0] == L for c in w) * 2 > len(w):
            # no script spells the whole word: a symbol joined to Latin letters stays, its look-alikes turn Latin
            new = _spell(w, L)
        out += [text[last:a], new]
        last = b
    if not out:
        return text
    return unicodedata.normalize("NFC", "".join(out) + text[last:])


@lru_cache(65536)
def _certain(word: str) -> int:
    """The script a word surely has, 0 if its letters leave it open."""
    own, both = _word_scripts(word)
    if both in (L, C, G):
        return both
    return L if own == L else 0


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 0 as it is, 1 a Greek or Cyrillic letter, 2 changes or may join its neighbour."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds[0x0370:0x0530] = 1
    kinds[0x1C80:0x1C90] = kinds[0x1F00:0x2000] = kinds[0x2DE0:0x2E00] = kinds[0xA640:0xA6A0] = 1
    for o in range(0x0300, 0x33480):
        c = chr(o)
        if 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xF900:
            continue
        if unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or not unicodedata.is_normalized("NFC", c):
            kinds[o] = 2
    kinds[0x1100:0x1200] = 2  # conjoining letters
    kinds[list(_single_map())] = 2
    return kinds


@lru_cache(1)
def _changing() -> re.Pattern[str]:
    """The signs that change on their own."""
    spans: list[list[int]] = []
    for k in sorted(_single_map()):
        if spans and spans[-1][1] == k - 1:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def _plain(text: str, kind: int) -> str:
    if kind & 2:
        single = _single_map()
        text = unicodedata.normalize("NFC", _changing().sub(lambda m: single[ord(m.group())], text))
        if "\u0307" in text:
            text = _DOTTED.sub(r"\1", text).replace("ı\u0307", "i")
    if kind & 1 or _FOREIGN.search(text):
        text = _unify(text)
    return text


def plain_many(texts: Sequence[str | None]) -> list[str | None]:
    """The plain forms of many texts; null stays null, empty stays empty."""
    out = [t for t in texts]
    lens = np.fromiter((len(t) if t else 0 for t in out), np.int64, len(out))
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    signs = np.frombuffer("".join(out[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(lens[full])[:-1]))
    kinds = np.bitwise_or.reduceat(_kinds()[signs], starts)
    for i, k in zip(full[kinds > 0].tolist(), kinds[kinds > 0].tolist()):
        out[i] = _plain(out[i], k)
    return out


def plain(text: str | None) -> str | None:
    """The plain form of one text; null stays null."""
    return plain_many([text])[0]
