"""Keys brought to one form, inside the query engine.

Keys are short codes in Latin letters and digits, so a letter of another script
that looks Latin is always meant as Latin; case and outer blanks don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavak.functions.lookalikes import CYRILLIC_LATIN, GREEK_LATIN

# Marks that follow their letter, and the composed small letter.
_COMPOSED = {"c\u0327": "ç", "s\u0327": "ş", "g\u0306": "ğ", "o\u0308": "ö", "u\u0308": "ü", "a\u0308": "ä", "a\u0302": "â", "i\u0302": "î", "u\u0302": "û", "e\u0301": "é", "e\u0300": "è"}
_WIDE = {chr(0xFEE0 + o): chr(o) for o in range(0x21, 0x7F)}
_SAME = CYRILLIC_LATIN | GREEK_LATIN | _WIDE | {"\u2010": "-", "\u2011": "-", "\u0130": "i", "I": "i", "\u0131": "i", "\u212a": "k"}
_BLANKS = r"[\s\u0085\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_UNSEEN = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{034F}\x{115F}\x{1160}\x{3164}]"


def plain_key(key: Column) -> Column:
    """The form in which keys compare; null stays null, a key of blanks becomes empty."""
    seen = F.regexp_replace(key, _UNSEEN, "")
    latin = F.lower(F.translate(seen, "".join(_SAME), "".join(_SAME.values())))
    # what a look-alike capital left after the first pass: I is i in any spelling
    latin = F.regexp_replace(F.translate(latin, "ı", "i"), "i\\x{0307}", "i")
    for parts, whole in _COMPOSED.items():
        latin = F.replace(latin, F.lit(parts), F.lit(whole))
    return F.trim(F.regexp_replace(latin, _BLANKS, " "))
