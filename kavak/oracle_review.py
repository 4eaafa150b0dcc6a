"""DuckDB SQL for the queries of reviewed records, written from their definitions."""

from __future__ import annotations

from kavak.functions import text as T
from kavak.functions.scalars import UNSAFE_EXPRESSION
from kavak.oracle import _bare_words, _words
from kavak.oracle_store import _LEVEL, _Q, _S
from kavak.plans.review import SOURCE_FIELDS, TEMPLATES

_E = """(SELECT record_id, record_no, outcome_id, grade, evidence_text, source, verification.status AS verified, review_status, evidence_status, student_visible, compiler_policy, deleted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY record_no) AS r FROM evidence_records) WHERE r = 1)"""
_M = "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY loaded_at) AS r FROM biology_release_manifest) WHERE r = 1)"
_ENTRY = f"(SELECT unit_id, record_id, canonical_path, canonical_text_sha256, status AS entry_status, student_ready, student_visible AS entry_visible, release_policy FROM {_M})"


def _failed(checks: dict[str, str]) -> str:
    return f"concat_ws(',', {', '.join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in checks.items())})"


def _gated(rows: str, checks: dict[str, str], name: str, status: str = "status") -> str:
    return f"SELECT CASE WHEN failed = '' THEN 'PASS' ELSE 'MANUAL' END AS {status}, failed, count(*) AS {name} FROM (SELECT {_failed(checks)} AS failed FROM {rows}) GROUP BY 1, 2"


def _counted(rows: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failed, count(*) AS total FROM {rows}" for n, c in checks.items())


def _once(rows: str, name: str, columns: str) -> str:
    there = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
    return f"SELECT '{name}' AS \"check\", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM {rows} WHERE {there} GROUP BY {columns})"


_FILLED = " AND ".join(f"coalesce(CAST(source.{f} AS VARCHAR), '') NOT IN ('', '0')" for f in SOURCE_FIELDS)
_UNIT = {
    "text": "length(trim(evidence_text)) >= 120",
    "hash_1": "source.text_sha256 = sha256(evidence_text)",
    "canonical": "regexp_matches(canonical_text_sha256, '^[0-9a-f]{64}$')",
    "provenance": _FILLED,
    "verified": "verified = 'VERIFIED'",
    "review": "review_status = 'PASS'",
    "evidence": "evidence_status = 'READY'",
    "policy": "compiler_policy = 'FAIL_CLOSED'",
    "hidden": "student_visible = false",
    "kept": "deleted_at IS NULL",
}
_ENTRY_CHECKS = {
    "status": "entry_status = 'RELEASED'",
    "ready": "student_ready",
    "not_visible": "entry_visible = false",
    "policy": "release_policy = 'FAIL_CLOSED'",
    "path": "contains(canonical_path, lower(translate(trim(unit_id), 'İIı', 'iii')))",
    "identity": "starts_with(unit_id, outcome_id)",
}
_BOTH = f"(SELECT n.*, e.* EXCLUDE (record_id), e.record_id IS NOT NULL AS there FROM {_ENTRY} n LEFT JOIN {_E} e ON e.record_id = n.record_id)"
_UNIT_FAILED = f"CASE WHEN NOT there THEN 'original' ELSE {_failed(_UNIT)} END"
_GOOD = "list_filter(coalesce(choices, []), lambda x: trim(x) <> '')"
_QUESTION = {
    "fields": "trim(id) <> '' AND trim(subject) <> '' AND trim(topic) <> '' AND trim(question) <> ''",
    "grade": "grade BETWEEN 9 AND 12",
    "choices": f"len({_GOOD}) = 5 AND len(list_distinct({_GOOD})) = 5",
    "answer": "list_position(['A', 'B', 'C', 'D', 'E'], answer) BETWEEN 1 AND len(coalesce(choices, []))",
    "concepts": "len(list_filter(coalesce(concepts, []), lambda x: trim(x) <> '')) > 0",
    "solution": "trim(solution_id) <> ''",
    "level": f"{_LEVEL} IS NOT NULL",
}
_SOLUTION = {
    "steps": "len(coalesce(steps, [])) > 0 AND len(list_filter(steps, lambda x: coalesce(trim(x) <> '', false))) = len(steps)",
    "answer": "final_answer IN ('A', 'B', 'C', 'D', 'E')",
    "strategy": "trim(strategy) <> ''",
    "question": "trim(question_id) <> ''",
}
_RELATION: dict[str, str] = {}
for _c in ("dependencies", "next_topics"):
    _RELATION[f"{_c}_filled"] = f"len(list_filter(coalesce({_c}, []), lambda x: coalesce(trim(x) <> '', false))) = len(coalesce({_c}, []))"
    _RELATION[f"{_c}_once"] = f"len(list_distinct(coalesce({_c}, []))) + CASE WHEN len(list_filter(coalesce({_c}, []), lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END = len(coalesce({_c}, []))"
    _RELATION[f"{_c}_other"] = f"NOT list_contains(coalesce({_c}, []), topic)"
_ENDINGS = "|".join(sorted(T.SUFFIXES, key=lambda s: (-len(s), s)))
_GENERIC = "[" + ", ".join(f"'{g}'" for g in T.GENERIC_ROOTS) + "]"


def _root(t: str) -> str:
    """A token without its longest listed ending if four letters stay."""
    return f"CASE WHEN length({t}) < 5 THEN {t} ELSE regexp_replace({t}, '^(.{{4,}}?)(?:{_ENDINGS})$', '\\1') END"


def _alike(a: str, b: str) -> str:
    return f"({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"


def _roots(rows: str, id: str, text: str) -> str:
    """(id, root) of the meaningful stems of a text."""
    return f"""(SELECT DISTINCT id, root FROM (SELECT id, t, {_root("t")} AS root FROM (SELECT {id} AS id, unnest(string_split({_bare_words(text)}, ' ')) AS t FROM {rows}) WHERE length(t) >= 4)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest({_GENERIC}) AS g) WHERE {_alike("t", "g")} OR {_alike("root", "g")}))"""


_CLAIMS = f"(SELECT * FROM {_Q} WHERE question IS NOT NULL AND choices IS NOT NULL)"
_HIDDEN = " OR ".join(f"contains(lower(text), '{x}')" for x in UNSAFE_EXPRESSION)
_SHY, _LETTER = "chr(173)", "[A-Za-zÇĞİÖŞÜçğıöşü]"
_PAGE_FORM = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, {_SHY}, ''), '({_LETTER})-[\\s\\x0b]*\\n[\\s\\x0b]*({_LETTER})', '\\1\\2', 'g'), '\\r\\n?', chr(10), 'g'),"
    " '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x0b]+', ''), '[\\s\\x0b]+$', '')"
)
_ONE_LINE = "trim(trim(regexp_replace(regexp_replace(text, '\\[\\[PAGE:\\d+\\]\\]', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g')), ' ' || chr(10) || chr(9) || ':-')"
_SPACE = "\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _stripped(c: str) -> str:
    """Without outer blanks of any kind."""
    return f"regexp_replace(regexp_replace({c}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


_SEEN = "regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')"

ORACLE: dict[str, str] = {
    "evidence_build": """
SELECT v.record_no, v.package_id, v.page, p.n AS page_record_no, CASE WHEN p.n IS NULL THEN 'page' END AS error FROM (SELECT record_no, source.package_id AS package_id, source.page AS page FROM evidence_records WHERE verification.status = 'VERIFIED') v
LEFT JOIN (SELECT source.package_id AS package_id, source.page AS page, min(record_no) AS n FROM evidence_records WHERE length(trim(evidence_text)) >= 120 GROUP BY 1, 2) p ON p.package_id = v.package_id AND p.page = v.page""",
    "approval_queue": f"SELECT m.record_id, m.unit_id, e.record_no, e.source.text_sha256 AS sha, CASE WHEN e.record_id IS NULL THEN 'record' END AS error FROM {_M} m LEFT JOIN (SELECT * FROM {_E} WHERE review_status = 'PASS') e ON e.record_id = m.record_id",
    "approval_apply": f"""
SELECT e.record_id, e.record_no, CASE WHEN d.n > 1 THEN 'REPEATED' ELSE coalesce(d.status, 'PENDING') END AS decision FROM (SELECT * FROM {_E} WHERE review_status = 'PASS') e
LEFT JOIN (SELECT record_id, count(*) AS n, min(status) AS status FROM {_M} GROUP BY 1) d ON d.record_id = e.record_id""",
    "unknown_decisions": f"SELECT unit_id, record_id FROM {_M} m WHERE NOT EXISTS (SELECT 1 FROM {_E} e WHERE e.review_status = 'PASS' AND e.record_id = m.record_id)",
    "promotion": f"SELECT unit_id, record_id, CASE WHEN failed = '' THEN 'READY' ELSE 'BLOCKED' END AS status, failed FROM (SELECT unit_id, record_id, {_UNIT_FAILED} AS failed FROM {_BOTH})",
    "release_gate": f"SELECT unit_id, {_UNIT_FAILED} AS unit_failed, {_failed(_ENTRY_CHECKS)} AS entry_failed FROM {_BOTH}",
    "released": f"SELECT unit_id, record_id, record_no FROM {_BOTH} WHERE there AND {_failed(_UNIT)} = '' AND {_failed(_ENTRY_CHECKS)} = ''",
    "release_reconcile": f"SELECT status, CASE WHEN EXISTS (SELECT 1 FROM {_E} e WHERE e.record_id = m.record_id AND review_status = 'PASS' AND evidence_status = 'READY' AND deleted_at IS NULL) THEN 'RELEASED' ELSE 'SUSPENDED' END AS now, count(*) AS n_units FROM {_M} m GROUP BY 1, 2",
    "decision_gate": f"""SELECT unit_id, CASE WHEN failed = '' THEN 'PASS' ELSE 'MANUAL' END AS gate, failed FROM (SELECT unit_id, {_failed({
        "status": "status IN ('RELEASED', 'SUSPENDED_PENDING_HUMAN_REVIEW')", "flags": "student_ready IS NOT NULL AND student_visible IS NOT NULL", "policy": "trim(release_policy) <> ''",
        "released_ready": "status <> 'RELEASED' OR student_ready", "record": "trim(record_id) <> ''"})} AS failed FROM {_M})""",
    "packet_gate": f"""
WITH c AS (SELECT record_id, count(*) AS copies, first(evidence_text ORDER BY record_no) AS t, first(source.text_sha256 ORDER BY record_no) AS told FROM evidence_records GROUP BY 1),
n AS (SELECT record_id, count(*) AS n, min(canonical_text_sha256) AS canonical FROM {_M} WHERE record_id IS NOT NULL GROUP BY 1)
SELECT record_id, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS status, failed FROM (SELECT n.record_id, CASE WHEN c.record_id IS NULL THEN 'original' ELSE {_failed({
        "once": "n.n = 1", "one_copy": "c.copies = 1", "hash_1": "c.told = sha256(c.t)", "canonical": "regexp_matches(n.canonical, '^[0-9a-f]{64}$')"})} END AS failed FROM n LEFT JOIN c ON c.record_id = n.record_id)""",
    "manifest_checks": " UNION ALL ".join((
        _once("biology_release_manifest", "unit_once", "unit_id"), _once("biology_release_manifest", "record_once", "record_id"), _once("biology_release_manifest", "path_once", "canonical_path"),
        _once("biology_release_manifest", "arrival_once", "unit_id, loaded_at"),
        _counted("biology_release_manifest", {"hash_form": "regexp_matches(canonical_text_sha256, '^[0-9a-f]{64}$')", "closed": "release_policy = 'FAIL_CLOSED'", "not_visible": "student_visible = false", "after_created": "loaded_at >= created_at"}),
    )),
    "source_checks": _counted("(SELECT source.* FROM evidence_records)", {
        "authority": "trim(authority) <> ''", "corpus_family": "trim(corpus_family) <> ''", "package_id": "trim(package_id) <> ''", "source_anchor": "trim(source_anchor) <> ''",
        "path_has_hash": "html_path IS NULL OR text_sha256 IS NOT NULL", "page_in_path": "TRY_CAST(nullif(regexp_extract(html_path, '(?:^|/)page(\\d+)\\.html$', 1), '') AS INTEGER) = page"})
    + " UNION ALL SELECT 'one_family', count(*) FILTER (WHERE n > 1), count(*) FROM (SELECT source.package_id AS p, count(DISTINCT source.corpus_family) AS n FROM evidence_records GROUP BY 1)",
    "question_gate": _gated(_Q, _QUESTION, "n_questions"),
    "solution_gate": _gated(_S, _SOLUTION, "n_solutions"),
    "relation_gate": _gated("ayt_biyoloji", _RELATION, "n_rows"),
    "topic_parts": f"""
WITH q AS (SELECT subject, topic, id FROM {_Q} WHERE topic IS NOT NULL), l AS (SELECT subject, topic FROM tyt_tarih UNION SELECT subject, topic FROM ayt_biyoloji),
a AS (SELECT subject, topic FROM q UNION SELECT * FROM l), b AS (
  SELECT a.subject, a.topic, EXISTS (SELECT 1 FROM l WHERE l.subject = a.subject AND l.topic = a.topic) AS listed, EXISTS (SELECT 1 FROM q WHERE q.subject = a.subject AND q.topic = a.topic) AS asked,
    EXISTS (SELECT 1 FROM q JOIN {_S} s ON s.question_id = q.id WHERE q.subject = a.subject AND q.topic = a.topic) AS solved FROM a)
SELECT *, CASE WHEN listed AND asked AND solved THEN 'READY' WHEN asked OR solved THEN 'NOT_READY' ELSE 'MISSING' END AS state FROM b""",
    "claim_gate": f"""
WITH q AS (SELECT * FROM {_CLAIMS}), a AS (SELECT * FROM {_roots("q", "id", "question")}), b AS (SELECT * FROM {_roots("(SELECT id, unnest(choices) AS choice FROM q)", "id", "choice")}),
shared AS (SELECT DISTINCT a.id FROM a JOIN b ON b.id = a.id AND {_alike("a.root", "b.root")})
SELECT id, {_failed({"answer_held": "choices[list_position(['A', 'B', 'C', 'D', 'E'], answer)] IS NOT NULL", "excluded_absent": "NOT contains(lower(question), lower(misconception_target))", "stem_shared": "id IN (SELECT id FROM shared)"})} AS failed FROM q""",
    "root_counts": f"SELECT root, count(DISTINCT id) AS n_topics FROM {_roots('(SELECT DISTINCT topic FROM questions WHERE topic IS NOT NULL)', 'topic', 'topic')} GROUP BY 1",
    "routed_claims": f"""
SELECT id, {", ".join(f"list_aggregate(list_filter({c}, lambda x: x IS NOT NULL), 'string_agg', '|') AS {c}_" for c in ("choices", "concepts", "tags"))} FROM {_Q}""",
    "record_documents": f"SELECT grade, count(*) AS n_records, count(*) AS n_same, count(evidence_text) AS n_texts FROM {_E} GROUP BY 1",
    "release_entries": f"""
SELECT record_id, record_no, 'FAIL_CLOSED' AS release_policy, source.text_sha256 AS sha, sha256(concat_ws(chr(31), '=' || record_id, '=FAIL_CLOSED', coalesce('=' || source.text_sha256, '-'))) AS entry_sha256
FROM {_E} WHERE verified = 'VERIFIED' AND student_visible = false""",
    "own_identity": """
SELECT * FROM (SELECT record_no, grade, theme_number, TRY_CAST(nullif(split_part(outcome_id, '.', 2), '') AS INTEGER) AS code_grade, TRY_CAST(nullif(split_part(outcome_id, '.', 3), '') AS INTEGER) AS code_theme FROM evidence_records WHERE outcome_id IS NOT NULL)
WHERE grade IS DISTINCT FROM code_grade OR theme_number IS DISTINCT FROM code_theme""",
    "nested_registry": "SELECT grade, theme_number, min(theme_name) AS theme_name, outcome_id, min(outcome_title) AS title, min(source.page) AS source_page FROM evidence_records WHERE outcome_id IS NOT NULL GROUP BY grade, theme_number, outcome_id",
    "solution_texts": f"""
SELECT id, string_agg('[[PAGE:' || n || ']]' || chr(10) || t, chr(10) ORDER BY n) AS full_text, CAST(max(n) AS INTEGER) AS last_page FROM (SELECT id, unnest(steps) AS t, generate_subscripts(steps, 1) AS n FROM {_S}) WHERE t IS NOT NULL GROUP BY 1""",
    "theme_frames": """
SELECT *, lead(starts) OVER (PARTITION BY package_id ORDER BY theme_number) AS ends FROM (SELECT source.package_id AS package_id, theme_number, min(source.page) AS starts FROM evidence_records WHERE theme_number IS NOT NULL GROUP BY 1, 2)""",
    "page_links": "SELECT record_no, CASE WHEN p > 1 THEN (p - 1) || ',' ELSE '' END || CASE WHEN p > 0 THEN p || ',' ELSE '' END || (p + 1) AS numbers, 'https://kaynak.example/kitap/page' || p || '.html' AS address FROM (SELECT record_no, source.page AS p FROM evidence_records WHERE source.page IS NOT NULL)",
    "outcome_sections": "SELECT record_no, trim(regexp_replace(regexp_extract(outcome_title || chr(10) || 'a)', '(?s)^[\\s\\x0b]*(.*?)a\\)', 1), '[\\s\\x0b]+', ' ', 'g')) AS title, trim(chr(10) || theme_name || chr(10)) AS concepts FROM evidence_records WHERE outcome_title IS NOT NULL AND theme_name IS NOT NULL",
    "expression_guard": f"SELECT doc_kind, NOT ({_HIDDEN}) AS safe, count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "json_answers": f"SELECT id, id AS fenced, id AS told FROM {_Q} WHERE answer IS NOT NULL",
    "page_text_forms": f"SELECT doc_id, sha256({_PAGE_FORM}) AS page_form, sha256({_ONE_LINE}) AS one_line FROM documents WHERE text IS NOT NULL",
    "name_forms": """
SELECT DISTINCT source.package_id AS package_id, source.html_path AS html_path, grade, lower(source.package_id) AS name, lower(regexp_extract(source.html_path, '([^/]+)\\.[^./]*$', 1)) AS stem, CAST(grade AS VARCHAR) AS grade_number FROM evidence_records""",
    "package_kinds": "SELECT source.package_id AS package_id, split_part(source.package_id, '-', 1) AS kind, split_part(source.package_id, '-', 2) AS exam, split_part(source.package_id, '-', 3) AS subject, count(*) AS n_records FROM evidence_records GROUP BY 1, 2, 3, 4",
    "review_overall": """
SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN passed > 0 AND open = 0 THEN 'PASS' WHEN passed > 0 THEN 'PASS_WITH_LIMITED_SCOPE' ELSE 'UNVERIFIED' END AS overall FROM (
  SELECT source.package_id AS package_id, count(*) FILTER (WHERE review_status = 'PASS' AND deleted_at IS NULL) AS passed, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS failed,
    count(*) FILTER (WHERE review_status <> 'PASS' AND deleted_at IS NULL) AS open FROM evidence_records GROUP BY 1)""",
    "page_terms": f"""
WITH t AS (SELECT record_no, list_concat({_words(_bare_words("outcome_title"), T.STOP_MAPPING)}, {_words(_bare_words("theme_name"), T.STOP_MAPPING)}) AS named, {_words(_bare_words("evidence_text"), T.STOP_MAPPING)} AS words FROM evidence_records)
SELECT term, count(DISTINCT record_no) AS n_pages FROM (SELECT record_no, unnest(CASE WHEN len(named) > 0 THEN named ELSE words END) AS term FROM t) GROUP BY 1""",
    "family_state": "SELECT source.corpus_family AS family, coalesce(bool_or(length(trim(evidence_text)) > 0), false) AS has_text, count(*) FILTER (WHERE length(trim(evidence_text)) > 0) AS n_ready, count(*) AS n_pages FROM evidence_records GROUP BY 1",
    "resolving_questions": f"""
WITH a AS (SELECT t.topic_no, t.topic || p.tail AS question FROM tyt_tarih t, (VALUES {", ".join(f"('{t}')" for t in TEMPLATES)}) p(tail)),
m AS (SELECT a.question, n.topic_no, rank() OVER (PARTITION BY a.question ORDER BY length({_bare_words("n.topic")}) DESC) AS r FROM a JOIN tyt_tarih n ON contains({_bare_words("a.question")}, {_bare_words("n.topic")})),
u AS (SELECT question, min(topic_no) AS found_no FROM m WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT topic_no) = 1)
SELECT a.topic_no, a.question, u.found_no FROM a LEFT JOIN u ON u.question = a.question""",
    "title_lines": f"SELECT record_no, sha256({_stripped('theme_name')} || chr(10) || {_stripped('outcome_title')}) AS sha256 FROM evidence_records WHERE NOT regexp_matches(outcome_title, '[<>&]') AND NOT regexp_matches(theme_name, '[<>&]')",
    "visible_pages": f"SELECT doc_id, sha256(trim({_SEEN})) AS sha256 FROM documents WHERE text IS NOT NULL",
}
ORACLE["routed_claims"] = f"SELECT id, coalesce(choices_, '') AS choices, coalesce(concepts_, '') AS concepts, coalesce(tags_, '') AS tags FROM ({ORACLE['routed_claims']}) WHERE choices_ IS NOT NULL OR concepts_ IS NOT NULL OR tags_ IS NOT NULL"
