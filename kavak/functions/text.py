"""Normalisers and tokenisers as column expressions; each is a semantics of its own.

All take and give string columns (or arrays of them) and stay inside the query
engine.  Null stays null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the normalisers' users.
STOP_CROSSWALK = (
    "ve veya ile ilgili icin için bir bu su şu olarak olan hakkinda hakkında gibi yapabilme sorgulayabilme aciklayabilme açıklayabilme "
    "yorumlayabilme cikarim çıkarım bilimsel elde etme eder edebilme yurutebilme yürütebilme toplayabilme olusturabilme oluşturabilme "
    "analiz degerlendirebilme değerlendirebilme canli canlı canlilar canlılar biyoloji"
).split()
STOP_VERIFY = (
    "ve veya ile ilgili icin bir bu su olarak olan hakkinda gibi yapabilme sorgulayabilme yorumlayabilme aciklayabilme olusturabilme "
    "toplayabilme degerlendirebilme siniflandirabilme cozumleyebilme yurutebilme bilimsel cikarim akil deney bilgi model canli canlilar "
    "biyoloji surec surecleri onemi etkileri etkileyen dayali yapilan konusunda uygunlugu"
).split()
STOP_MAPPING = "ve veya ile bir bu icin gibi olan olarak konusu konulari temel genel".split()
STOP_LEXICAL = "ve veya ile bir bu icin gibi olan olarak de da ki mi mu mı mü the and page sayfa".split()
STOP_SOURCE = "ve ile icin olan olarak temel konu bilgi giris genel sistem sistemleri turleri ozellikleri kavram kavramlar yapi yapisi".split()
STOP_GROUNDING = "anlat nedir nasil konu konusu icin olan olarak ve ile bir bu".split()
SUFFIXES = (
    "larindan lerinden larinin lerinin larina lerine larini lerini larin lerin lar ler inin ının unun ünün nın nin nun nün dan den tan ten "
    "dır dir dur dür tır tir tur tür lık lik luk lük lı li lu lü ını ini unu ünü yla yle ya ye da de ta te ın in un ün ı i u ü ma me mak mek "
    "sina sine suna sune inda inde unda unde indan inden undan unden idir udur ilir ulur lanir lenir"
).split()
GENERIC_ROOTS = (
    "acikla anla uygula ogren ogrenci ogret konu kavram kural temel ornek soru cevap coz cozum dogru yanlis hata dikkat goster kullan bul "
    "hesapla ifade islem yontem adim bilgi amac hedef iliski ilgili gereken gerek durum sekil bicim deger sonuc fark toplam sabit fonksiyon "
    "matematik yks sinif gercek hayat olarak ol kabul edil et yaz yazil burada say sayi denir adlandir ele alin veril gerektir aciklan kapsa biçim"
).split()

_WIDE = "".join(chr(0xFEE0 + o) for o in range(0x21, 0x7F))
_NARROW = "".join(chr(o) for o in range(0x21, 0x7F))
# A small letter and its mark, and the composed letter.
_PAIRS = {"ç": "ç", "ş": "ş", "ğ": "ğ", "ö": "ö", "ü": "ü", "â": "â", "î": "î", "û": "û"}
#: Letters with marks that are folded to bare ones, and what they become.
_MARKED, _BARE = "çğıöşüâîûäáàãåéèêëíìïñóòôõúùÿ", "cgiosuaiuaaaaaeeeeiiinoooouuy"
_UNSEEN = "[\\x{00AD}\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]"


def _small(c: Column) -> Column:
    """Small letters, composed; İ becomes i and a dot above, as casefolding has it."""
    out = F.lower(F.translate(c, _WIDE, _NARROW))
    for pair, letter in _PAIRS.items():
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (also inside its own lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def searchable(c: Column) -> Column:
    """For searching: Turkish letters stay, ı becomes i, other signs part words; null becomes empty.

    Full-width signs and joined marks are resolved; other compatibility
    characters part words.
    """
    low = F.replace(F.replace(_small(F.coalesce(c, F.lit(""))), F.lit("̇"), F.lit("")), F.lit("ı"), F.lit("i"))
    return squeeze(F.regexp_replace(F.regexp_replace(low, _UNSEEN, ""), "[^a-z0-9çğıöşü\\s]", " "))


def bare(c: Column) -> Column:
    """Small letters without marks; ı becomes i, ß ss; everything else stays."""
    low = F.replace(F.replace(_small(c), F.lit("̇"), F.lit("")), F.lit("ß"), F.lit("ss"))
    return F.translate(low, _MARKED, _BARE)


def bare_keeping_dotless(c: Column) -> Column:
    """As :func:`bare`, without outer blanks, but ı stays ı."""
    low = F.replace(F.replace(_small(F.trim(F.coalesce(c, F.lit("")))), F.lit("̇"), F.lit("")), F.lit("ß"), F.lit("ss"))
    return F.translate(low, _MARKED.replace("ı", ""), _BARE.replace("i", "", 1))


def bare_words(c: Column) -> Column:
    """Runs of bare letters and digits, parted by one blank."""
    return F.trim(F.regexp_replace(bare(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def turkish_small(c: Column) -> Column:
    """Turkish casing: İ to i and I to ı, then small letters and squeezed blanks."""
    return squeeze(F.lower(F.translate(c, "İI", "iı")))


def keyword_small(c: Column) -> Column:
    """İ and I to i, capital ÇŞĞÜÖ to ASCII (small ones stay), small letters."""
    return F.lower(F.translate(c, "İIÇŞĞÜÖ", "iicsguo"))


def trimmed_small(c: Column) -> Column:
    """Trimmed small letters; null becomes ``none``."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("None"))))


def slug(c: Column) -> Column:
    """Bare letters and digits with ``_`` between runs."""
    return F.btrim(F.regexp_replace(bare(c), "[^a-z0-9]+", "_"), F.lit("_"))


def unit_slug(c: Column) -> Column:
    """Keeps Turkish letters and ``._-``; other runs become ``-``; empty becomes ``unit``."""
    out = F.btrim(F.regexp_replace(F.lower(F.translate(F.trim(c), "İIı", "iii")), "[^a-z0-9çğıöşü._-]+", "-"), F.lit("-"))
    return F.when(out == "", "unit").otherwise(out)


def joined_lines(c: Column) -> Column:
    """Text taken from pages: no soft hyphens, words broken at a line end joined, \\n line ends, at most one empty line."""
    letter = "[A-Za-zÇĞİÖŞÜçğıöşü]"
    out = F.replace(c, F.lit("­"), F.lit(""))
    out = F.regexp_replace(out, f"({letter})-\\s*\\n\\s*({letter})", "$1$2")
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def one_line(c: Column) -> Column:
    """Without page markers, squeezed, without outer colons and dashes."""
    return F.btrim(squeeze(F.regexp_replace(c, "\\[\\[PAGE:\\d+\\]\\]", " ")), F.lit(" \n\t:-"))


def distinct_values(values: Column) -> Column:
    """Trimmed, not empty, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def package_name(c: Column) -> Column:
    """A folder's or file's name without a copy number such as `` (1)``."""
    return F.regexp_replace(F.lower(F.trim(c)), "\\s+\\(\\d+\\)$", "")


def file_stem(c: Column) -> Column:
    """The last part of a path without its ending, as :func:`package_name`."""
    return package_name(F.regexp_replace(F.regexp_extract(c, "([^/]+)$", 1), "\\.[^.]*$", ""))


def grade_number(c: Column) -> Column:
    """``grade12`` or ``12`` to ``12``."""
    return F.regexp_replace(F.lower(F.trim(c)), "^grade", "")


def math_text(c: Column) -> Column:
    """Signs of school mathematics as an expression: ^ to **, the minus sign, π and √."""
    out = F.replace(F.replace(c, F.lit("^"), F.lit("**")), F.lit("−"), F.lit("-"))
    return F.trim(F.replace(F.replace(out, F.lit("π"), F.lit("pi")), F.lit("√"), F.lit("sqrt")))


# tokens ---------------------------------------------------------------------


def words_without(normal: Column, stop: Sequence[str], least: int = 3) -> Column:
    """Words of a normalised text in order, repeats kept, without short ones and stop words."""
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) >= least) & ~t.isin(list(stop)))


def search_tokens(c: Column, stop: Sequence[str] = STOP_CROSSWALK) -> Column:
    """Tokens for searching, repeats kept."""
    return words_without(searchable(c), stop)


def distinct_search_tokens(c: Column, stop: Sequence[str] = STOP_VERIFY) -> Column:
    """Tokens for searching, first occurrences."""
    return F.array_distinct(search_tokens(c, stop))


def bare_tokens(c: Column, stop: Sequence[str] = STOP_MAPPING) -> Column:
    """Runs of bare letters and digits, repeats kept."""
    return words_without(bare_words(c), stop)


def source_tokens(c: Column) -> Column:
    """Distinct bare words of four letters or more."""
    return F.array_distinct(words_without(bare_words(c), STOP_SOURCE, 4))


def grounding_tokens(c: Column) -> Column:
    """Distinct bare words of three letters or more without question words."""
    return F.array_distinct(words_without(bare_words(c), STOP_GROUNDING))


def question_tokens(c: Column) -> Column:
    """Distinct words of three letters or more with their form without the accusative ending."""
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(squeeze(F.replace(bare_keeping_dotless(c), F.lit("-"), F.lit(" "))), " "), lambda t: F.length(t) >= 3), token_variants)))


def token_variants(t: Column) -> Column:
    """The token and, if it has five letters or more and ends in ni, nı or nu, the token without them."""
    return F.when((F.length(t) >= 5) & t.rlike("n[iıu]$"), F.array(t, F.substring(t, F.lit(1), F.length(t) - 2))).otherwise(F.array(t))


def root(t: Column) -> Column:
    """The token without its longest listed ending, if four letters stay; shorter tokens stay whole."""
    endings = "|".join(sorted(SUFFIXES, key=lambda s: (-len(s), s)))
    return F.when(F.length(t) < 5, t).otherwise(F.regexp_replace(t, f"^(.{{4,}}?)(?:{endings})$", "$1"))


def is_generic(t: Column, stem: Column) -> Column:
    """Whether a token or its stem is a common word of teaching, or one begins with the other (four letters at least)."""

    def same(a: Column, g: Column) -> Column:
        return (a == g) | ((F.length(a) >= 4) & (F.length(g) >= 4) & (F.startswith(a, g) | F.startswith(g, a)))

    return F.exists(F.array(*map(F.lit, GENERIC_ROOTS)), lambda g: same(t, g) | same(stem, g))


def meaningful_roots(c: Column) -> Column:
    """Distinct stems, not generic, of bare tokens of four letters or more."""
    kept = F.filter(F.split(bare_words(c), " "), lambda t: (F.length(t) >= 4) & let(root(t), lambda r: ~is_generic(t, r)))
    return F.array_distinct(F.transform(kept, root))


def roots_overlap(left: Column, right: Column) -> Column:
    """Whether a stem of one side equals, or (four letters) begins with, one of the other."""
    return F.exists(left, lambda a: F.exists(right, lambda b: (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))))


def bigrams(tokens: Column) -> Column:
    """Neighbours joined by a blank; none for fewer than two."""
    empty = F.array().cast("array<string>")
    pairs = lambda t: F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda x, y: F.concat_ws(" ", x, y))
    return let(tokens, lambda t: F.when(F.size(t) >= 2, pairs(t)).otherwise(empty))


def phrase(tokens: Column) -> Column:
    """Tokens joined by one blank."""
    return F.array_join(tokens, " ")


def sentences_of(c: Column) -> Column:
    """Useful sentences of an excerpt: of lines of 20 signs or more that aren't addresses; long ones must be closed."""
    line = F.transform(F.split(F.regexp_replace(c, "\\r\\n?", "\n"), "\n"), squeeze)
    line = F.filter(line, lambda x: (F.length(x) >= 20) & ~x.rlike("^https?://"))
    piece = F.flatten(F.transform(line, lambda x: F.split(x, "(?<=[.!?])\\s+")))
    closed = lambda x: (F.size(F.split(x, " ")) < 8) | x.rlike("[.!?:;)\\]}]$") | F.contains(x, F.lit("="))
    return F.filter(piece, lambda x: (F.length(x) >= 20) & closed(x))
