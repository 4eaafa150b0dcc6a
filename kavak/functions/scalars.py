"""Other scalar functions: hashes, addresses, page numbers, parts of structured texts, overlaps and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavak.functions.text import let

# Blocks of scripts that an answer must not contain.
FOREIGN_SCRIPTS = "[\\x{0400}-\\x{052F}\\x{0590}-\\x{05FF}\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"
# Parts that an expression must not contain.
UNSAFE_EXPRESSION = ("__", "import", "exec", "eval", "open(", "os.", "sys.", "subprocess", "lambda")


def text_hash(c: Column) -> Column:
    """SHA-256 in hexadecimal, of a string's UTF-8 or of bytes."""
    return F.sha2(c.cast("binary"), 256)


def page_number(name: Column) -> Column:
    """N of a file name ``pageN.html``, null for others."""
    return F.nullif(F.regexp_extract(name, "(?:^|/)page(\\d+)\\.html$", 1), F.lit("")).try_cast("int")


def page_numbers(html: Column) -> Column:
    """All distinct positive N of ``pageN.html`` in a text, ascending."""
    found = F.transform(F.regexp_extract_all(html, F.lit("page(\\d+)\\.html"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n > 0)))


def is_official_url(url: Column, host: str) -> Column:
    """https and exactly that host."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("HOST")) == host), F.lit(False))


def page_url(base: Column, number: Column) -> Column:
    """The address of a numbered page under a base address."""
    return F.concat(F.regexp_replace(base, "[^/]*$", ""), F.lit("page"), number.cast("string"), F.lit(".html"))


def section(block: Column, header: str, ends: Sequence[str]) -> Column:
    """The text between a header and the nearest following end header (or the end); empty without the header."""
    start = F.locate(header, block)
    rest = F.substring(block, start + F.lit(len(header)), F.length(block))
    stops = [F.nullif(F.locate(e, rest), F.lit(0)) for e in ends]
    stop = F.least(*stops, F.length(rest) + 1) if stops else F.length(rest) + 1
    return F.when(start > 0, F.trim(F.substring(rest, F.lit(1), stop - 1))).otherwise(F.lit(""))


def outcome_title(block: Column, ends: Sequence[str] = ("a)",)) -> Column:
    """The text after an outcome code up to its first point ``a)`` or section header."""
    stop = "|".join(e.replace(")", "\\)").replace("(", "\\(") for e in ends)
    return F.trim(F.regexp_replace(F.regexp_extract(block, f"(?s)^\\s*[^\\s.]+(?:\\.\\d+)+\\.?\\s+(.*?)(?:{stop}|$)", 1), "\\s+", " "))


def marked_page(text: Column, position: Column) -> Column:
    """The last ``[[PAGE:n]]`` that begins before a position, null before the first."""
    found = F.regexp_extract_all(F.substring(text, F.lit(1), position), F.lit("\\[\\[PAGE:(\\d+)\\]\\]"), F.lit(1))
    return F.element_at(F.when(F.size(found) > 0, found), -1).try_cast("int")


def has_foreign_script(c: Column) -> Column:
    """Whether a text holds a sign of the listed scripts."""
    return c.rlike(FOREIGN_SCRIPTS)


def json_part(c: Column) -> Column:
    """The JSON object in a text: without a code fence, else from the first { to the last }."""
    fenced = F.regexp_extract(c, "(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$", 1)
    inner = F.when(fenced != "", fenced).otherwise(c)
    return F.nullif(F.regexp_extract(inner, "(?s)(\\{.*\\})", 1), F.lit(""))


def overlap_share(topic: Column, page: Column) -> Column:
    """Share of the topic's tokens found on the page, to four places; 0 if either is empty."""
    return F.when((F.size(topic) > 0) & (F.size(page) > 0), F.round(F.size(F.array_intersect(topic, page)) / F.size(F.array_distinct(topic)), 4)).otherwise(F.lit(0.0))


def label(value: Column, steps: Sequence[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """The label of the first (highest) bound that a value reaches; ``strict``: exceeds.  Null has none."""
    out = F.lit(other)
    for bound, name in sorted(steps):
        out = F.when(value > bound if strict else value >= bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def confidence(share: Column) -> Column:
    """HIGH from 0.99, MEDIUM from 0.67, LOW above 0, else NONE."""
    return F.when(share >= 0.99, "HIGH").when(share >= 0.67, "MEDIUM").when(share > 0, "LOW").otherwise("NONE")


def share_of_hundred(score: Column) -> Column:
    """score / 100, kept between 0 and 1; null for null."""
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 100)))


def first_of(*choices: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in choices))


def path_of(*parts: Column) -> Column:
    """Parts joined to a path."""
    return F.concat_ws("/", *parts)


def without_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """A request without one known closing phrase, first letter large, the rest small."""
    out = F.trim(F.regexp_replace(F.trim(c), "(?i)\\s*(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + ")[.!?]*$", ""))
    return F.concat(F.upper(F.left(out, F.lit(1))), F.lower(F.substring(out, F.lit(2), F.length(out))))


def is_safe_expression(c: Column) -> Column:
    """Whether an expression text holds none of the refused parts, in whatever case."""
    return ~let(F.lower(c), lambda t: F.exists(F.array(*map(F.lit, UNSAFE_EXPRESSION)), lambda x: F.contains(t, x)))


def value_at(values: Column, place: Column) -> Column:
    """An array's value at a place from 0, null outside."""
    return F.get(values, place)
