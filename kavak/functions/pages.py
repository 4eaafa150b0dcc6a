"""Functions over raw pages and documents that need Python: visible HTML text, entities, canonical JSON, archives.

All are Arrow UDFs over batches; the functions they wrap are plain and can be used alone.
"""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import unicodedata
import zipfile
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Elements whose text isn't seen, and those whose text is a heading.
UNSEEN = ("script", "style", "noscript", "template")
UNREAD = ("script", "style", "noscript")
HEADINGS = ("h1", "h2", "h3", "h4")
_CODE = re.compile(r"<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>", re.S | re.I)
_TAG = re.compile(r"<[^>]+>")


class _Seen(HTMLParser):
    """Collects the text that a reader of a page sees, and its title and headings apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.inside = 0, []
        self.body, self.title, self.headings = [], [], []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in UNSEEN:
            self.hidden += 1
        elif tag == "title" or tag in HEADINGS:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN and self.hidden:
            self.hidden -= 1
        elif tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if self.hidden or not text:
            return
        if "title" in self.inside:
            self.title.append(text)
            return
        if self.inside:
            self.headings.append(text)
        self.body.append(text)


class _Plain(HTMLParser):
    """Collects all text outside scripts and styles as it stands, the title's too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in UNREAD

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in UNREAD and self.hidden > 0

    def handle_data(self, data: str) -> None:
        text = html.unescape(data).strip()
        if text and not self.hidden:
            self.parts.append(text)


def plain_lines(page: str | None) -> str:
    """The text of a page outside scripts and styles, a line for each piece, inner blanks as they are; empty for null."""
    parser = _Plain()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.parts)


def seen(page: str | None) -> tuple[str, str, str]:
    """(visible text, title, headings) of a page; empty for null."""
    parser = _Seen()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.body), " ".join(parser.title), "\n".join(parser.headings)


def code_text(page: str | None) -> str:
    """The ``<pre><code>`` bodies of a page without tags and entities, squeezed, parted by an empty line."""
    parts = (" ".join(html.unescape(_TAG.sub(" ", x)).replace(" ", " ").split()) for x in _CODE.findall(page or ""))
    return "\n\n".join(p for p in parts if p)


def canonical_hash(document: str | None, without: str | None = None) -> str | None:
    """SHA-256 of a JSON object written with sorted names and no blanks, less one name; null for null or broken JSON."""
    try:
        value = json.loads(document) if document is not None else None
    except ValueError:
        return None
    if value is None:
        return None
    if without and isinstance(value, dict):
        value = {k: v for k, v in value.items() if k != without}
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fingerprint(page: str | None, stop: frozenset[str], most: int = 400) -> dict:
    """The ``most`` commonest terms of a page by (count, term), and the sorted terms of its title and headings."""
    body, title, headings = seen(page)

    def terms(text: str) -> list[str]:
        low = unicodedata.normalize("NFKD", text.replace("İ", "I").replace("ı", "i"))
        low = "".join(c for c in low if not unicodedata.combining(c)).casefold()
        return [t for t in re.findall("[a-z0-9]+", low) if len(t) >= 3 and t not in stop]

    counts = Counter(terms(f"{title}\n{body}"))
    best = sorted(counts, key=lambda t: (-counts[t], t))[:most]
    return {"terms": best, "title_terms": sorted(set(terms(title))), "heading_terms": sorted(set(terms(headings)))}


def members(content: bytes | None, pattern: str = r"(?:^|/)basic-html/page(\d+)\.html$") -> list[tuple[str, int, bytes]]:
    """(name, page, bytes) of the archive's members that match; a name with ``..`` or from the root is an error."""
    out = []
    if not content:
        return out
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            m = re.search(pattern, name)
            if not m:
                continue
            if name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name):
                raise ValueError(f"archive member outside its folder: {name}")
            out.append((name, int(m.group(1)), z.read(name)))
    return out


def visible_text(page: Column) -> Column:
    """Struct (text, title, headings) of an HTML column."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "headings")])

    def work(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([seen(p) for p in pages], columns=["text", "title", "headings"])

    return pandas_udf(work, kind)(page)


def page_lines(page: Column) -> Column:
    """:func:`plain_lines` of an HTML column."""

    def work(pages: pd.Series) -> pd.Series:
        return pages.map(plain_lines)

    return pandas_udf(work, T.StringType())(page)


def page_code_text(page: Column) -> Column:
    """:func:`code_text` of an HTML column."""

    def work(pages: pd.Series) -> pd.Series:
        return pages.map(code_text)

    return pandas_udf(work, T.StringType())(page)


def json_hash(document: Column, without: str | None = None) -> Column:
    """:func:`canonical_hash` of a JSON column."""

    def work(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: canonical_hash(d if isinstance(d, str) else None, without))

    return pandas_udf(work, T.StringType())(document)


def html_fingerprints(page: Column, stop: list[str], most: int = 400) -> Column:
    """:func:`fingerprint` of an HTML column, as a struct of three arrays."""
    kind = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("terms", "title_terms", "heading_terms")])
    held = frozenset(stop)

    def work(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint(p, held, most) for p in pages], columns=["terms", "title_terms", "heading_terms"])

    return pandas_udf(work, kind)(page)


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, member, page, bytes)`` of each page file in ZIP archives; broken archives give no rows (see ``archives``)."""

    def work(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf[path], pdf[content]):
                try:
                    rows += [(p, *m) for m in members(c)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "page", "bytes"])

    return files.select(path, content).mapInPandas(work, "path string, member string, page int, bytes binary")


def compatible(text: Column) -> Column:
    """Unicode's compatibility composition (NFKC), for texts whose signs the query engine can't resolve."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)

    return F.when(text.rlike("[^\\x00-\\x{024F}]"), pandas_udf(work, T.StringType())(text)).otherwise(text)


def composed(text: Column) -> Column:
    """Letters and their marks composed (NFC); texts without combining marks stay in the query engine."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)

    return F.when(text.rlike("[\\x{0300}-\\x{036F}]"), pandas_udf(work, T.StringType())(text)).otherwise(text)
