"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their definitions by brute force."""

from __future__ import annotations

from kavak.functions.lookalikes import CYRILLIC_LATIN, GREEK_LATIN
from kavak.llm.queries import LIKENESS

_WIDE = {chr(0xFEE0 + o): chr(o) for o in range(0x21, 0x7F)}
# letters that look Latin, taken as Latin in every word: words truly in another script change alike wherever they stand
_SAME = {a: b for a, b in (CYRILLIC_LATIN | GREEK_LATIN | _WIDE).items() if len(b) == 1 and b != "'"}
_FROM, _TO = "".join(_SAME), "".join(_SAME.values())


def _words(c: str) -> str:
    """A text's words without case; the four kinds of i are one."""
    seen = rf"regexp_replace(nfc_normalize({c}), '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{034F}}\x{{115F}}\x{{1160}}\x{{3164}}]', '', 'g')"
    latin = f"nfc_normalize(lower(translate(translate({seen}, '{_FROM}', '{_TO}'), 'İIı', 'iii')))"
    return rf"regexp_extract_all(regexp_replace(translate({latin}, 'ı', 'i'), '\p{{M}}', '', 'g'), '[\p{{L}}\p{{Nd}}]+')"


def _runs(rows: str, id: str, words: str, n: int) -> str:
    """(id, run) of the distinct runs of ``n`` words."""
    return f"SELECT DISTINCT {id}, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS run FROM (SELECT {id}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {id}, {words} AS w FROM {rows}))"


_RECORDS = r"(SELECT record_no, evidence_text FROM evidence_records WHERE length(regexp_replace(nfc_normalize(evidence_text), '[\p{Cf}]', '', 'g')) >= 120)"
_ALIKE = f"""
WITH r AS ({_runs(_RECORDS, "record_no", _words("evidence_text"), 3)}), n AS (SELECT record_no, count(*) AS n FROM r GROUP BY 1),
met AS (SELECT a.record_no AS a, b.record_no AS b, count(*) AS h FROM r a JOIN r b ON a.run = b.run AND a.record_no < b.record_no GROUP BY 1, 2),
pairs AS (SELECT a, b, h / (x.n + y.n - h) AS likeness FROM met JOIN n x ON x.record_no = a JOIN n y ON y.record_no = b WHERE h >= {LIKENESS} * (x.n + y.n - h) - 1e-9)
"""

_LOOK = "".join(CYRILLIC_LATIN) + "".join(GREEK_LATIN)
_LATIN = "".join(sorted({x for x in CYRILLIC_LATIN.values() if len(x) == 1}))
# not composed; signs unseen, wide, joined or blank in another way; a Latin dotted i with another dot
_ODD = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{034F}\x{115F}\x{1160}\x{3164}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{FE63}\x{FF01}-\x{FFE6}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}]|i\x{0307}"
# words of Latin and look-alike letters, or of two or more look-alikes; words of another script with a Latin letter that looks like one of its own
_MIXED = rf"""regexp_matches(w, '[{_LOOK}]') AND NOT regexp_matches(w, '[^{_LOOK}\p{{Latin}}\p{{M}}]') AND (regexp_matches(w, '\p{{Latin}}') OR length(w) > 1)
  OR regexp_matches(w, '\p{{Cyrillic}}') AND regexp_matches(w, '\p{{Latin}}') AND NOT regexp_matches(w, '[^{_LATIN}\p{{Cyrillic}}\p{{M}}]')"""
_NOT_PLAIN = f"""
SELECT record_no, field FROM (SELECT record_no, 'evidence_text' AS field, evidence_text AS v FROM evidence_records UNION ALL SELECT record_no, 'outcome_title', outcome_title FROM evidence_records)
WHERE v IS NOT NULL AND (nfc_normalize(v) <> v OR regexp_matches(v, '{_ODD}') OR len(list_filter(regexp_extract_all(v, '[\\p{{L}}\\p{{M}}]+'), lambda w: {_MIXED})) > 0)"""

_LEAKS = f"""
WITH i AS ({_runs("eval_items", "item_id", _words("text"), 10)}), d AS ({_runs("(SELECT doc_id, regexp_replace(text, '&nbsp;', ' ', 'gi') AS text FROM documents WHERE text IS NOT NULL)", "doc_id", _words("text"), 10)})
"""

ORACLE: dict[str, str] = {
    "p2_found": _NOT_PLAIN,
    "p3_found": _ALIKE + "SELECT a AS record_no_a, b AS record_no_b FROM pairs",
    "p3_groups": _ALIKE
    + """, class AS (SELECT n.record_no, coalesce((SELECT min(a) FROM pairs p WHERE p.b = n.record_no AND p.likeness = 1), n.record_no) AS class_id FROM n),
c AS (SELECT class_id, count(*) AS members FROM class GROUP BY 1),
links AS (SELECT id, count(*) AS links FROM (SELECT x.class_id AS id, y.class_id AS other FROM pairs p JOIN class x ON x.record_no = p.a JOIN class y ON y.record_no = p.b WHERE x.class_id <> y.class_id
  UNION SELECT y.class_id, x.class_id FROM pairs p JOIN class x ON x.record_no = p.a JOIN class y ON y.record_no = p.b WHERE x.class_id <> y.class_id) GROUP BY 1)
SELECT s.record_no, s.class_id, c.members, coalesce(l.links, 0) AS links FROM class s JOIN c ON c.class_id = s.class_id LEFT JOIN links l ON l.id = s.class_id""",
    "p7_found": _LEAKS + "SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON i.run = d.run",
    "p7_shares": _LEAKS + "SELECT d.doc_id, i.item_id, count(*) AS shared, n.n AS passages, round(count(*) / n.n, 6) AS containment FROM d JOIN i ON i.run = d.run JOIN (SELECT item_id, count(*) AS n FROM i GROUP BY 1) n ON n.item_id = i.item_id GROUP BY 1, 2, n.n",
}
