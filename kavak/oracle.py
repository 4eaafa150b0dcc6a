"""DuckDB SQL that gives the same rows as the core's queries, written from their definitions."""

from __future__ import annotations

from kavak.functions import text as T
from kavak.plans.curriculum import KEYWORDS

_P1_EDGES = r"""
WITH RECURSIVE rows AS (
  SELECT plan_id, trim(regexp_replace(topic, '\s+', ' ', 'g')) AS topic, dependencies, next_topics FROM ayt_biyoloji
), topics AS (
  SELECT DISTINCT plan_id, regexp_replace(topic, '^AYT ', '') AS topic FROM rows WHERE topic <> ''
), named AS (
  SELECT plan_id, trim(regexp_replace(unnest(dependencies), '\s+', ' ', 'g')) AS parent, topic AS child FROM rows
  UNION ALL
  SELECT plan_id, topic AS parent, trim(regexp_replace(unnest(next_topics), '\s+', ' ', 'g')) AS child FROM rows
), edges AS (
  SELECT DISTINCT plan_id, regexp_replace(parent, '^AYT ', '') AS parent, regexp_replace(child, '^AYT ', '') AS child
  FROM named WHERE parent NOT LIKE 'TYT %' AND child NOT LIKE 'TYT %'
), valid AS (
  SELECT e.plan_id, e.parent, e.child FROM edges e
  SEMI JOIN topics p ON p.plan_id = e.plan_id AND p.topic = e.parent
  SEMI JOIN topics c ON c.plan_id = e.plan_id AND c.topic = e.child
), up AS (
  SELECT plan_id, parent AS ancestor, child AS topic, 1 AS steps FROM valid
  UNION
  SELECT u.plan_id, v.parent, u.topic, u.steps + 1 FROM up u JOIN valid v ON v.plan_id = u.plan_id AND v.child = u.ancestor
  WHERE u.ancestor <> u.topic AND u.steps <= 2000
    AND u.steps <= (SELECT count(*) FROM topics t WHERE t.plan_id = u.plan_id)
)
"""

# Look-alike letters of keys and the Latin letters meant.
_KEY = r"""trim(nfc_normalize(lower(translate(regexp_replace({c}, '[\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{00AD}}]', '', 'g'),
 'АВЕІКМНОРСТУХЅЈаеіорсухѕјΑΒΕΖΗΙΚΜΝΟΡΤΥΧοİIı', 'ABEiKMHOPCTYXSJaeiopcyxsjABEZHiKMNOPTYXoiii')).replace('i' || chr(775), 'i')))"""


def _key(c: str) -> str:
    return _KEY.format(c=c)


def _broken(name: str, id: str, ref: str, target: str, own: str, deleted: str) -> str:
    return f"""
SELECT DISTINCT '{name}' AS src_table, s.{id} AS src_id,
  CASE WHEN t.k IS NULL THEN 'missing' WHEN t.alive = 0 THEN 'deleted' ELSE 'late' END AS kind,
  strftime(s.created_at, '%Y-%m') AS period
FROM (SELECT *, {_key(ref)} AS k FROM {name} WHERE {deleted}) s
LEFT JOIN (
  SELECT {_key(own)} AS k, count(*) FILTER (WHERE deleted_at IS NULL) AS alive, min(created_at) FILTER (WHERE deleted_at IS NULL) AS first
  FROM {target} GROUP BY 1
) t ON t.k = s.k
WHERE s.k <> '' AND (t.k IS NULL OR t.alive = 0 OR t.first > s.created_at)"""


_P4 = " UNION ALL ".join(
    (
        _broken("questions", "id", "solution_id", "solutions", "id", "deleted_at IS NULL"),
        _broken("solutions", "id", "question_id", "questions", "id", "deleted_at IS NULL"),
        _broken("biology_release_manifest", "unit_id", "record_id", "evidence_records", "record_id", "true"),
    )
)


_P1_PLACES = """, pairs AS (SELECT plan_id, ancestor, topic, min(steps) AS steps FROM up GROUP BY ALL),
looped AS (SELECT plan_id, topic FROM pairs WHERE ancestor = topic),
stops AS (SELECT p.plan_id, p.topic, min(p.steps) AS stop FROM pairs p JOIN looped l ON l.plan_id = p.plan_id AND l.topic = p.ancestor GROUP BY ALL),
ways AS (
  SELECT p.* FROM pairs p LEFT JOIN stops s ON s.plan_id = p.plan_id AND s.topic = p.topic
  WHERE (s.stop IS NULL OR p.steps <= s.stop) AND NOT EXISTS (SELECT 1 FROM looped l WHERE l.plan_id = p.plan_id AND l.topic = p.topic)
), sizes AS (SELECT plan_id, ancestor AS topic, count(*) AS below FROM ways GROUP BY ALL),
sized AS (
  SELECT t.plan_id, t.topic, coalesce(s.below, 0) + 1 AS size, w.ancestor AS parent FROM topics t
  LEFT JOIN sizes s ON s.plan_id = t.plan_id AND s.topic = t.topic LEFT JOIN ways w ON w.plan_id = t.plan_id AND w.topic = t.topic AND w.steps = 1
), places AS (
  SELECT *, sum(size) OVER (PARTITION BY plan_id, parent ORDER BY topic ROWS UNBOUNDED PRECEDING) - size + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS step FROM sized
), above AS (
  SELECT w.plan_id, w.topic, sum(p.step) AS steps, max(w.steps) AS depth, string_agg(w.ancestor, ' > ' ORDER BY w.steps DESC) AS path, arg_max(w.ancestor, w.steps) AS root
  FROM ways w JOIN places p ON p.plan_id = w.plan_id AND p.topic = w.ancestor GROUP BY ALL
), downs AS (SELECT plan_id, ancestor AS topic, count(*) AS n FROM pairs GROUP BY ALL)
SELECT p.plan_id, p.topic, coalesce(a.path || ' > ', '') || p.topic AS path, CAST(coalesce(a.depth, 0) AS INTEGER) AS depth, coalesce(a.root, p.topic) AS root,
  CAST(p.step + coalesce(a.steps, 0) AS BIGINT) AS first, CAST(p.step + coalesce(a.steps, 0) + p.size - 1 AS BIGINT) AS last, CAST(coalesce(d.n, 0) AS BIGINT) AS descendants,
  l.topic IS NOT NULL AS looped, l.topic IS NULL AND s.stop IS NOT NULL AS below_loop
FROM places p LEFT JOIN above a ON a.plan_id = p.plan_id AND a.topic = p.topic LEFT JOIN downs d ON d.plan_id = p.plan_id AND d.topic = p.topic
LEFT JOIN looped l ON l.plan_id = p.plan_id AND l.topic = p.topic LEFT JOIN stops s ON s.plan_id = p.plan_id AND s.topic = p.topic
"""


def _composite(match: str) -> str:
    """Solutions whose (id, question) is no (solution, id) of the questions; the keys that are there decide."""
    held = "SELECT {k} AS r, count(*) FILTER (WHERE deleted_at IS NULL) AS alive, min(created_at) FILTER (WHERE deleted_at IS NULL) AS first FROM questions GROUP BY 1"
    k1, k2, both = _key("solution_id"), _key("id"), f"nullif({_key('solution_id')}, '') || '|' || nullif({_key('id')}, '')"
    kind = "CASE WHEN {t}.r IS NULL THEN 'missing' WHEN {t}.alive = 0 THEN 'deleted' WHEN {t}.first > s.created_at THEN 'late' END"
    some = {"simple": "NULL", "partial": f"CASE WHEN k1 <> '' THEN {kind.format(t='a')} WHEN k2 <> '' THEN {kind.format(t='b')} END", "full": "CASE WHEN k1 <> '' OR k2 <> '' THEN 'mixed' END"}[match]
    return f"""
SELECT DISTINCT '{match}' AS "match", id AS src_id, null_mask, kind, strftime(created_at, '%Y-%m') AS period FROM (
  SELECT s.*, CASE WHEN k1 <> '' THEN '1' ELSE '0' END || CASE WHEN k2 <> '' THEN '1' ELSE '0' END AS null_mask,
    CASE WHEN k1 <> '' AND k2 <> '' THEN {kind.format(t="c")} ELSE {some} END AS kind
  FROM (SELECT id, created_at, coalesce({_key("id")}, '') AS k1, coalesce({_key("question_id")}, '') AS k2 FROM solutions WHERE deleted_at IS NULL) s
  LEFT JOIN ({held.format(k=k1)}) a ON a.r = s.k1 LEFT JOIN ({held.format(k=k2)}) b ON b.r = s.k2 LEFT JOIN ({held.format(k=both)}) c ON c.r = s.k1 || '|' || s.k2
) WHERE kind IS NOT NULL"""


# Full-width signs and what they look like.
_WIDE = "".join(chr(0xFEE0 + o) for o in range(0x21, 0x7F))
_NARROW = "".join(chr(o) for o in range(0x21, 0x7F)).replace("'", "''")


def _small(c: str) -> str:
    return f"nfc_normalize(lower(translate({c}, '{_WIDE}', '{_NARROW}')))"


def _search(c: str) -> str:
    """The form for searching: Turkish letters stay, ı is i, other signs are blanks."""
    low = f"replace(replace({_small(f"coalesce({c}, '')")}, chr(775), ''), 'ı', 'i')"
    seen = f"regexp_replace({low}, '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({seen}, '[^a-z0-9çğıöşü\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _bare(c: str) -> str:
    """Small letters without marks."""
    return f"replace(strip_accents(replace(replace({_small(c)}, chr(775), ''), 'ß', 'ss')), 'ı', 'i')"


def _bare_words(c: str) -> str:
    return f"trim(regexp_replace({_bare(f"coalesce({c}, '')")}, '[^a-z0-9]+', ' ', 'g'))"


def _words(normal: str, stop: list[str], least: int = 3) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(string_split({normal}, ' '), lambda t: length(t) >= {least} AND t NOT IN ({listed}))"


_OUTCOMES = """(SELECT outcome_id, min(grade) AS grade, min(outcome_title) AS title, min(theme_name) AS theme, '' AS framework
  FROM evidence_records WHERE outcome_id IS NOT NULL GROUP BY 1)"""

_CROSSWALK = f"""
WITH outcomes AS {_OUTCOMES},
page_tokens AS (SELECT record_no, source.package_id AS package_id, {_words(_search("evidence_text"), T.STOP_CROSSWALK)} AS tokens FROM evidence_records),
post AS (SELECT record_no, package_id, token, count(*) AS tf FROM (SELECT record_no, package_id, unnest(tokens) AS token FROM page_tokens) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
fields AS (
  SELECT outcome_id, grade, 'title' AS field, 8.0::DOUBLE AS w, {_words(_search("title"), T.STOP_CROSSWALK)} AS tokens FROM outcomes
  UNION ALL SELECT outcome_id, grade, 'theme', 0.5::DOUBLE, {_words(_search("theme"), T.STOP_CROSSWALK)} FROM outcomes
), terms AS (SELECT DISTINCT outcome_id, grade, field, w, unnest(tokens) AS token FROM fields),
hit AS (
  SELECT t.outcome_id, t.grade, p.record_no, p.package_id, t.field,
    t.w * (ln(((SELECT count(*) FROM evidence_records) + 1)::DOUBLE / (d.df + 1)) + 1) * (1 + 0.15 * (least(p.tf, 3) - 1)) AS worth
  FROM terms t JOIN df d USING (token) JOIN post p USING (token)
), sums AS (
  SELECT outcome_id, grade, record_no, package_id, sum(worth) AS base, count(*) FILTER (WHERE field = 'title') AS title_hits
  FROM hit GROUP BY ALL HAVING count(*) FILTER (WHERE field = 'title') > 0
), title_order AS (
  SELECT outcome_id, token, row_number() OVER (PARTITION BY outcome_id ORDER BY min(i)) AS n
  FROM (SELECT outcome_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM fields WHERE field = 'title') GROUP BY outcome_id, token
), title_pairs AS (
  SELECT DISTINCT a.outcome_id, a.token AS x, b.token AS y FROM title_order a JOIN title_order b ON a.outcome_id = b.outcome_id AND b.n = a.n + 1
), page_order AS (SELECT record_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM page_tokens),
page_pairs AS (SELECT DISTINCT a.record_no, a.token AS x, b.token AS y FROM page_order a JOIN page_order b ON a.record_no = b.record_no AND b.i = a.i + 1
  WHERE (a.token, b.token) IN (SELECT (x, y) FROM title_pairs)),
bigram AS (SELECT t.outcome_id, p.record_no, count(*) AS bigram_hits FROM title_pairs t JOIN page_pairs p ON t.x = p.x AND t.y = p.y GROUP BY ALL),
scored AS (
  SELECT s.outcome_id, s.record_no, s.package_id, s.title_hits, coalesce(b.bigram_hits, 0) AS bigram_hits,
    contains(s.package_id, CASE WHEN s.grade <= 10 THEN '-TYT-' ELSE '-AYT-' END) AS affine, s.base
  FROM sums s LEFT JOIN bigram b ON b.outcome_id = s.outcome_id AND b.record_no = s.record_no
), ranked AS (
  SELECT outcome_id, record_no, package_id, title_hits, bigram_hits, coalesce(affine, false) AS affine,
    round((base + 12.0::DOUBLE * bigram_hits) * CASE WHEN affine THEN 1.2::DOUBLE ELSE 0.82::DOUBLE END
      * CASE WHEN title_hits = 1 AND bigram_hits = 0 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END * (1 + least(title_hits, 5) * 0.08::DOUBLE), 6) AS score
  FROM scored
), best AS (
  SELECT *, CAST(rank AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY outcome_id ORDER BY score DESC, package_id, record_no) AS rank FROM ranked) WHERE rank <= 8
), status AS (
  SELECT outcome_id, CASE WHEN bool_or(r = 1 AND title_hits >= 2 AND (bigram_hits >= 1 OR title_hits >= 3) AND affine)
      AND round(max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0), 6) >= 2 THEN 'STRONG_CANDIDATE' ELSE 'REVIEW_REQUIRED' END AS status,
    round(max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0), 6) AS margin
  FROM best GROUP BY 1
)
"""

_LOG = "(SELECT log_id, min(logged_at) AS logged_at, arg_min(student_id, logged_at) AS student_id, arg_min(date, logged_at) AS date, arg_min(subject, logged_at) AS subject, first(topic ORDER BY logged_at) AS topic, first(duration ORDER BY logged_at) AS duration, first(score ORDER BY logged_at) AS score FROM study_log GROUP BY log_id)"
_BAND = "CASE WHEN mean_score >= 80 THEN 'strong' WHEN mean_score >= 60 THEN 'medium' WHEN mean_score IS NOT NULL THEN 'weak' END"
_SHA = "sha256(evidence_text)"
_ERRORS = {
    "authority": "source.authority = 'OKUL-YAYIN'",
    "source": "coalesce(source.authority, '') <> '' AND coalesce(source.package_id, '') <> '' AND coalesce(source.page, 0) <> 0 AND coalesce(source.source_anchor, '') <> '' AND coalesce(source.html_path, '') <> '' AND coalesce(source.image_path, '') <> '' AND coalesce(source.text_sha256, '') <> ''",
    "hash": f"{_SHA} = source.text_sha256",
    "affinity": "contains(source.package_id, CASE WHEN grade <= 10 THEN '-TYT-' ELSE '-AYT-' END)",
    "policy": "compiler_policy = 'FAIL_CLOSED'",
    "verified": "verification.status = 'VERIFIED'",
    "checks": "list_bool_and(list_transform(map_values(verification.checks), lambda x: coalesce(x, false)))",
    "length": "length(trim(evidence_text)) >= 120",
    "title": "hits >= 3 AND hits / nullif(n, 0) >= 0.5",
}
_GATE = f"""
SELECT record_no, CASE WHEN failed = '' THEN 'PASS' ELSE 'MANUAL' END AS status, failed FROM (
  SELECT record_no, concat_ws(',', {", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _ERRORS.items())}) AS failed FROM (
    SELECT *, len(list_distinct(tt)) AS n, len(list_intersect(list_distinct(tt), list_distinct(string_split({_search("evidence_text")}, ' ')))) AS hits FROM (
      SELECT *, {_words(_search("outcome_title"), T.STOP_VERIFY)} AS tt FROM evidence_records)))"""
_CHECKS = {
    "grade_range": "grade BETWEEN 9 AND 12",
    "theme_range": "theme_number >= 1",
    "title_present": "trim(outcome_title) <> ''",
    "text_present": "trim(evidence_text) <> ''",
    "page_positive": "source.page > 0",
    "not_visible": "student_visible = false",
    "deleted_after_created": "deleted_at IS NULL OR deleted_at >= created_at",
}
_MAPPING = f"""
WITH q AS (SELECT DISTINCT subject, topic_no, unnest({_words(_bare_words("topic"), T.STOP_MAPPING)}) AS t FROM tyt_tarih),
n AS (SELECT topic_no, count(*) AS n FROM q GROUP BY 1),
p AS (SELECT DISTINCT subject, doc_id, unnest({_words(_bare_words("text"), T.STOP_MAPPING)}) AS t FROM documents WHERE text IS NOT NULL),
hits AS (SELECT q.topic_no, p.doc_id, count(*) AS h FROM q JOIN p ON q.subject = p.subject AND q.t = p.t GROUP BY ALL),
scored AS (
  SELECT d.topic_no, d.doc_id, round(coalesce(h.h, 0) / n.n, 4) AS score FROM
  (SELECT t.topic_no, d.doc_id FROM tyt_tarih t JOIN documents d ON d.subject = t.subject AND d.text IS NOT NULL) d
  JOIN n ON n.topic_no = d.topic_no LEFT JOIN hits h ON h.topic_no = d.topic_no AND h.doc_id = d.doc_id
), best AS (SELECT topic_no, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_no ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5),
named AS (SELECT *, CASE WHEN score >= 0.99 THEN 'HIGH' WHEN score >= 0.67 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS confidence FROM best)
"""
_BAND_SQL = {
    "level": "CASE WHEN score >= 85 THEN 'advanced' WHEN score >= 65 THEN 'intermediate' WHEN score >= 40 THEN 'basic' WHEN score IS NOT NULL THEN 'beginner' END",
    "mastery": "CASE WHEN score >= 90 THEN 'mastered' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'developing' WHEN score IS NOT NULL THEN 'weak' END",
    "result": "CASE WHEN score / 100 >= 0.8 THEN 'mastered' WHEN score / 100 >= 0.6 THEN 'developing' WHEN score IS NOT NULL THEN 'weak' END",
}
_TSMALL = "trim(regexp_replace(lower(translate({c}, 'İI', 'iı')), '\\s+', ' ', 'g'))"
_KEYWORDS = ", ".join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(KEYWORDS))

ORACLE: dict[str, str] = {
    "p1_found": _P1_EDGES + "SELECT plan_id, ancestor, topic, CAST(min(steps) AS INTEGER) AS steps FROM up GROUP BY ALL",
    "p1_places": _P1_EDGES + _P1_PLACES,
    "p4_found": _P4,
    "p4_composite": " UNION ALL ".join(_composite(m) for m in ("simple", "partial", "full")),
    "p4_report": f"SELECT src_table, period, kind, count(*) AS n_references FROM ({_P4}) GROUP BY ALL",
    "document_frequency": _CROSSWALK + "SELECT token, df FROM df",
    "crosswalk_topk": _CROSSWALK + "SELECT outcome_id, record_no, package_id, score, title_hits, bigram_hits, affine, r AS rank FROM best",
    "crosswalk_status": _CROSSWALK + "SELECT o.outcome_id, coalesce(s.status, 'UNRESOLVED') AS status, s.margin FROM outcomes o LEFT JOIN status s ON s.outcome_id = o.outcome_id",
    "crosswalk_status_counts": _CROSSWALK + "SELECT coalesce(s.status, 'UNRESOLVED') AS status, count(*) AS n_outcomes FROM outcomes o LEFT JOIN status s ON s.outcome_id = o.outcome_id GROUP BY 1",
    "review_gate": _GATE,
    "review_gate_counts": f"SELECT status, count(*) AS n_records FROM ({_GATE}) GROUP BY 1",
    "constraint_errors": " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failed, count(*) AS total FROM evidence_records" for n, c in _CHECKS.items()),
    "duplicate_records": "SELECT record_id, count(*) AS copies FROM evidence_records GROUP BY 1 HAVING count(*) > 1",
    "conflicting_copies": "SELECT record_id, count(*) AS copies, count(DISTINCT (coalesce(evidence_text, '~'), coalesce(source.text_sha256, '~'))) = 1 AS agree, min(record_no) AS first_record_no FROM evidence_records GROUP BY 1 HAVING count(*) > 1",
    "dedupe_last_wins": "SELECT id, topic, answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, topic DESC NULLS LAST, answer DESC NULLS LAST) AS r FROM questions) WHERE r = 1",
    "dedupe_richest": "SELECT record_id, record_no FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY length(coalesce(outcome_title, '')) + length(coalesce(evidence_text, '')) DESC, record_no) AS r FROM evidence_records) WHERE r = 1",
    "dedupe_hash_first": "SELECT d.doc_id, f.first_doc_id FROM documents d JOIN (SELECT text, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) f ON f.text = d.text WHERE d.doc_id <> f.first_doc_id",
    "manifest_one_to_one": """
WITH a AS (SELECT record_id, count(*) AS n, min(canonical_text_sha256) AS h FROM biology_release_manifest WHERE record_id IS NOT NULL GROUP BY 1),
b AS (SELECT record_id, count(*) AS n, min(source.text_sha256) AS h FROM evidence_records GROUP BY 1)
SELECT fault, count(*) AS n_records FROM (
  SELECT CASE WHEN b.record_id IS NULL THEN 'only_left' WHEN a.record_id IS NULL THEN 'only_right' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN a.h IS DISTINCT FROM b.h THEN 'differs' END AS fault
  FROM a FULL JOIN b ON a.record_id = b.record_id) WHERE fault IS NOT NULL GROUP BY 1""",
    "coverage_sets": """
SELECT 'evidence_status' AS "grouping", evidence_status, NULL::INTEGER AS grade, NULL::INTEGER AS theme_number, count(*) AS n_records FROM evidence_records GROUP BY evidence_status
UNION ALL SELECT 'grade', NULL, grade, NULL, count(*) FROM evidence_records GROUP BY grade
UNION ALL SELECT 'grade+theme_number', NULL, grade, theme_number, count(*) FROM evidence_records GROUP BY grade, theme_number
UNION ALL SELECT 'all', NULL, NULL, NULL, count(*) FROM evidence_records""",
    "coverage_rollup": """
SELECT grade, theme_number, evidence_status, count(*) AS n_records, CAST(3 - grouping(grade) - grouping(theme_number) - grouping(evidence_status) AS INTEGER) AS level
FROM evidence_records GROUP BY ROLLUP (grade, theme_number, evidence_status)""",
    "status_pivot": "SELECT grade, theme_number, count(*) FILTER (WHERE review_status = 'PASS') AS PASS, count(*) FILTER (WHERE review_status = 'MANUAL') AS MANUAL, count(*) AS total FROM evidence_records GROUP BY 1, 2",
    "referential_gaps": "SELECT DISTINCT plan_id, ref FROM (SELECT plan_id, unnest(dependencies) AS ref FROM ayt_biyoloji) r WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ayt_biyoloji t WHERE t.plan_id = r.plan_id AND t.topic = r.ref)",
    "question_solutions": "SELECT q.id, q.subject, q.topic, q.difficulty, q.solution_id, s.strategy, s.n_steps FROM (SELECT DISTINCT id, subject, topic, difficulty, solution_id FROM questions WHERE deleted_at IS NULL) q JOIN (SELECT DISTINCT id, strategy, len(steps) AS n_steps FROM solutions WHERE deleted_at IS NULL) s ON s.id = q.solution_id",
    "questions_without_solution": "SELECT subject, count(DISTINCT id) AS n_questions FROM questions q WHERE NOT EXISTS (SELECT 1 FROM solutions s WHERE s.id = q.solution_id) GROUP BY 1",
    "questions_by_difficulty": "SELECT subject, grade, CASE WHEN d IN ('basic', 'easy', 'kolay') THEN 'easy' WHEN d IN ('intermediate', 'medium', 'orta') THEN 'medium' WHEN d IN ('advanced', 'hard', 'zor') THEN 'hard' ELSE d END AS level, count(DISTINCT id) AS n_questions FROM (SELECT *, lower(difficulty) AS d FROM questions) GROUP BY ALL",
    "source_mapping_topk": _MAPPING + "SELECT topic_no, doc_id, score, rank, confidence FROM named",
    "mapping_status": _MAPPING + "SELECT coalesce(b.confidence, 'UNRESOLVED') AS confidence, count(*) AS n_topics FROM tyt_tarih t LEFT JOIN (SELECT * FROM named WHERE rank = 1) b ON b.topic_no = t.topic_no GROUP BY 1",
    "resolve_topic_longest": f"""
SELECT topic, topic_no FROM (
  SELECT l.topic, n.topic_no, row_number() OVER (PARTITION BY l.topic ORDER BY length({_TSMALL.format(c="n.topic")}) DESC, n.topic_no) AS r
  FROM (SELECT DISTINCT topic FROM study_log WHERE topic IS NOT NULL) l JOIN tyt_tarih n ON contains({_TSMALL.format(c="l.topic")}, {_TSMALL.format(c="n.topic")})) WHERE r = 1""",
    "resolve_topic_unique": f"""
WITH m AS (SELECT l.topic, n.topic_no, length({_bare_words("n.topic")}) AS s FROM (SELECT DISTINCT topic FROM study_log WHERE topic IS NOT NULL) l JOIN tyt_tarih n ON contains({_bare_words("l.topic")}, {_bare_words("n.topic")})),
b AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY s DESC) AS r FROM m)
SELECT topic, min(topic_no) AS topic_no FROM b WHERE r = 1 GROUP BY 1 HAVING count(*) = 1""",
    "keyword_subject": f"""
SELECT id, label FROM (SELECT q.id, k.label, row_number() OVER (PARTITION BY q.id ORDER BY k.place) AS r
FROM (SELECT id, min(question) AS question FROM questions WHERE question IS NOT NULL GROUP BY 1) q JOIN (VALUES {_KEYWORDS}) k(place, label, keyword) ON contains({_TSMALL.format(c="q.question")}, k.keyword)) WHERE r = 1""",
    "next_topic": "SELECT topic_no, topic, lag(topic) OVER (PARTITION BY subject ORDER BY topic_no) AS previous, lead(topic) OVER (PARTITION BY subject ORDER BY topic_no) AS next FROM tyt_tarih",
    "previous_topics": "SELECT t.topic_no, count(p.topic) AS n_before, coalesce(string_agg(p.topic, '|' ORDER BY p.topic_no), '') AS before FROM tyt_tarih t LEFT JOIN tyt_tarih p ON p.subject = t.subject AND p.topic_no < t.topic_no GROUP BY 1",
    "normal_forms": f"""
SELECT DISTINCT topic, {_search("topic")} AS searchable, {_bare("topic")} AS bare, {_bare_words("topic")} AS bare_words, {_TSMALL.format(c="topic")} AS turkish_small,
  lower(translate(topic, 'İIÇŞĞÜÖ', 'iicsguo')) AS keyword_small, trim(regexp_replace({_bare("topic")}, '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  trim(regexp_replace(lower(translate(trim(topic), 'İIı', 'iii')), '[^a-z0-9çğıöşü._-]+', '-', 'g'), '-') AS unit_slug, lower(replace(trim(topic), 'İ', 'i' || chr(775))) AS trimmed_small
FROM questions WHERE topic IS NOT NULL""",
    "document_tokens": f"SELECT token, count(*) AS n_times, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest({_words(_bare_words("text"), T.STOP_LEXICAL)}) AS token FROM documents) GROUP BY 1",
    "title_bigrams": f"""
WITH o AS {_OUTCOMES}, t AS (SELECT outcome_id, {_words(_search("title"), T.STOP_VERIFY)} AS tokens FROM o),
n AS (SELECT outcome_id, token, row_number() OVER (PARTITION BY outcome_id ORDER BY min(i)) AS n FROM (SELECT outcome_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM t) GROUP BY 1, 2)
SELECT a.token || ' ' || b.token AS bigram, count(DISTINCT a.outcome_id) AS n_outcomes FROM n a JOIN n b ON a.outcome_id = b.outcome_id AND b.n = a.n + 1 GROUP BY 1""",
    "top_terms": f"""
SELECT doc_id, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_words(_bare_words("text"), T.STOP_LEXICAL)}) AS term FROM documents) GROUP BY 1, 2)) WHERE rank <= 10""",
    "script_guard": "SELECT lang, regexp_matches(text, '[\\x{0400}-\\x{052F}\\x{0590}-\\x{05FF}\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') AS \"foreign\", count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "page_parts": """
SELECT source.package_id AS package_id, count(*) AS n_records, count(n) AS n_numbers, max(n) AS last_page, count(*) FILTER (WHERE n = source.page) AS n_same,
  count(*) FILTER (WHERE source.source_anchor IS NOT NULL) AS n_official
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(source.html_path, '(?:^|/)page(\\d+)\\.html$', 1), '') AS INTEGER) AS n FROM evidence_records) GROUP BY 1""",
    "topic_study_summary": f"SELECT *, {_BAND} AS band FROM (SELECT subject, topic, count(*) AS n_rows, sum(duration)::BIGINT AS minutes, round(avg(score), 6) AS mean_score FROM {_LOG} GROUP BY 1, 2)",
    "learner_insight": f"""
SELECT *, CASE WHEN weak_topics >= 3 THEN 'high' WHEN weak_topics > 0 THEN 'medium' ELSE 'low' END AS priority FROM (
  SELECT student_id, count(*) FILTER (WHERE band = 'weak') AS weak_topics, count(*) FILTER (WHERE band = 'strong') AS strong_topics, coalesce(sum(minutes), 0)::BIGINT AS total_minutes FROM (
    SELECT *, {_BAND} AS band FROM (SELECT student_id, topic, sum(duration) AS minutes, round(avg(score), 6) AS mean_score FROM {_LOG} WHERE topic IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)""",
    "topic_history": f"SELECT log_id, student_id, duration, score, lag(log_id) OVER w AS log_before, lead(log_id) OVER w AS log_after FROM {_LOG} WHERE subject = 'Tarih' AND topic = 'Hitit Hukuku' WINDOW w AS (PARTITION BY student_id ORDER BY log_id)",
    "distinct_subjects": "SELECT subject, count(DISTINCT topic) AS n_topics, count(DISTINCT student_id) AS n_learners FROM study_log GROUP BY 1",
    "score_bands": f"SELECT {', '.join(f'{c} AS {n}' for n, c in _BAND_SQL.items())}, count(*) AS n_rows FROM {_LOG} GROUP BY ALL",
    "study_days": f"SELECT strftime(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d.%m.%Y')), '%Y-%m') AS month, count(*) AS n_rows, coalesce(sum(duration), 0)::BIGINT AS minutes FROM {_LOG} GROUP BY 1",
    "progress_state": f"SELECT student_id, topic, count(*) AS attempts, greatest(0.0::DOUBLE, max(score)) AS best_score, first(score ORDER BY logged_at DESC, log_id DESC) AS last_score FROM {_LOG} WHERE score IS NOT NULL AND topic IS NOT NULL GROUP BY 1, 2",
    "completed_and_weak": f"SELECT student_id, count(DISTINCT topic) FILTER (WHERE score >= 80) AS n_completed, count(DISTINCT topic) FILTER (WHERE score < 80) AS n_weak FROM {_LOG} WHERE score IS NOT NULL AND topic IS NOT NULL GROUP BY 1",
    "topics_in_order": f"SELECT *, CAST(row_number() OVER (PARTITION BY student_id ORDER BY first_at, topic) AS INTEGER) AS place FROM (SELECT student_id, topic, min(log_id) AS first_at FROM {_LOG} WHERE topic IS NOT NULL GROUP BY 1, 2)",
    "last_topic": f"SELECT student_id, first(topic ORDER BY logged_at DESC, log_id DESC) AS last_topic FROM {_LOG} WHERE topic IS NOT NULL GROUP BY 1",
    "study_windows": f"SELECT strftime(make_timestamp((epoch_us(logged_at) // (7 * 86400000000)) * 7 * 86400000000), '%Y-%m-%d') AS starts, subject, count(*) AS n_rows, sum(duration)::BIGINT AS minutes FROM {_LOG} GROUP BY 1, 2",
}

# the best pages checked, and the texts' sentences -------------------------------
_VERIFIED = f"""{_CROSSWALK}, titles AS (SELECT outcome_id, list_distinct({_words(_search("title"), T.STOP_VERIFY)}) AS tt FROM outcomes),
title_words AS (SELECT outcome_id, token, row_number() OVER (PARTITION BY outcome_id ORDER BY min(i)) AS n
  FROM (SELECT outcome_id, unnest(tt) AS token, generate_subscripts(tt, 1) AS i FROM (SELECT outcome_id, {_words(_search("title"), T.STOP_VERIFY)} AS tt FROM outcomes)) GROUP BY 1, 2),
neighbours AS (SELECT DISTINCT outcome_id, token || ' ' || after AS pair FROM (SELECT outcome_id, token, lead(token) OVER (PARTITION BY outcome_id ORDER BY n) AS after FROM title_words) WHERE after IS NOT NULL),
raw AS (SELECT outcome_id, pair FROM (SELECT outcome_id, token || ' ' || after AS pair FROM (SELECT outcome_id, token, lead(token) OVER (PARTITION BY outcome_id ORDER BY i) AS after
  FROM (SELECT outcome_id, unnest(tt) AS token, generate_subscripts(tt, 1) AS i FROM (SELECT outcome_id, {_words(_search("title"), T.STOP_VERIFY)} AS tt FROM outcomes))) WHERE after IS NOT NULL) GROUP BY ALL),
three AS (SELECT b.outcome_id, b.record_no, b.score, b.affine, b.r AS rank, string_split({_search("e.evidence_text")}, ' ') AS words, ' ' || {_search("e.evidence_text")} || ' ' AS page,
    {" AND ".join(f"coalesce(CAST(e.source.{f} AS VARCHAR), '') NOT IN ('', '0')" for f in ("source_anchor", "html_path", "image_path"))} AND coalesce(trim(e.evidence_text) <> '', false) AS complete
  FROM best b JOIN evidence_records e ON e.record_no = b.record_no WHERE b.r <= 3),
checked AS (
  SELECT t.outcome_id, t.record_no, t.score, t.rank, len(list_intersect(o.tt, t.words)) AS title_hits,
    (SELECT count(*) FROM neighbours p WHERE p.outcome_id = t.outcome_id AND contains(t.page, ' ' || p.pair || ' ')) AS bigram_hits, t.complete, t.affine
  FROM three t JOIN titles o ON o.outcome_id = t.outcome_id
), verified AS (
  SELECT outcome_id, record_no, score, rank, title_hits, bigram_hits, CASE WHEN complete AND title_hits >= 3 AND affine THEN 'VERIFIED' WHEN complete AND title_hits >= 1 THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS status FROM checked
)
"""
_SENTENCES = r"""(
  SELECT record_no, line_no, piece_no, piece FROM (
    SELECT record_no, line_no, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS piece_no FROM (
      SELECT record_no, line_no, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS pieces FROM (
        SELECT record_no, line_no, trim(regexp_replace(raw, '[\s\x0b]+', ' ', 'g'), ' ') AS line FROM (
          SELECT record_no, unnest(lines) AS raw, generate_subscripts(lines, 1) AS line_no FROM (SELECT record_no, string_split(regexp_replace(evidence_text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM evidence_records WHERE evidence_text IS NOT NULL)))
      WHERE length(line) >= 20 AND NOT regexp_matches(line, '^https?://')))
  WHERE length(piece) >= 20 AND (len(string_split(piece, ' ')) < 8 OR regexp_matches(piece, '[.!?:;)\]}]$') OR contains(piece, '=')))"""


def _grounding(c: str) -> str:
    return f"list_distinct({_words(_bare_words(c), T.STOP_GROUNDING)})"


_QTOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(replace({low}, '-', ' '), '[\\s\\x0b]+', ' ', 'g')), ' '), lambda t: length(t) >= 3))"


def _question_words(c: str) -> str:
    """Small letters without marks, ı kept apart, as words."""
    low = f"replace(replace(strip_accents(replace(replace({_small(f"trim(coalesce({c}, ''))")}, chr(775), ''), 'ı', chr(1))), chr(1), 'ı'), 'ß', 'ss')"
    return _QTOKENS.format(low=low)


def _variants(rows: str) -> str:
    """(id, token) of the words and their forms without the ending."""
    return f"SELECT DISTINCT id, token FROM (SELECT id, t AS token FROM {rows} UNION ALL SELECT id, left(t, length(t) - 2) FROM {rows} WHERE length(t) >= 5 AND regexp_matches(t, 'n[iıu]$'))"


_SUBJECT = _TSMALL.format(c="subject")
ORACLE |= {
    "verify_candidates": _VERIFIED + "SELECT outcome_id, record_no, score, rank, title_hits, bigram_hits, status FROM verified",
    "verify_best": _VERIFIED + """SELECT outcome_id, record_no, score, title_hits, bigram_hits, status FROM (SELECT *, row_number() OVER (PARTITION BY outcome_id ORDER BY
  CASE status WHEN 'VERIFIED' THEN 3 WHEN 'REVIEW_REQUIRED' THEN 2 ELSE 1 END DESC, title_hits DESC, bigram_hits DESC, score DESC, record_no) AS place FROM verified) WHERE place = 1""",
    "chunk_sentences": f"""SELECT e.record_no, count(s.piece) AS n_sentences, CAST(coalesce(sum(length(s.piece)), 0) AS BIGINT) AS n_signs FROM evidence_records e LEFT JOIN {_SENTENCES} s ON s.record_no = e.record_no
WHERE e.evidence_text IS NOT NULL GROUP BY 1""",
    "resolve_unit_overlap": f"""
WITH q AS (SELECT id, min(question) AS question FROM questions WHERE question IS NOT NULL GROUP BY 1), u AS (SELECT outcome_id AS id, min(outcome_title) AS title FROM evidence_records WHERE outcome_id IS NOT NULL GROUP BY 1 HAVING min(outcome_title) IS NOT NULL),
qw AS (SELECT id, unnest({_question_words("question")}) AS t FROM q), uw AS (SELECT id, unnest({_question_words("title")}) AS t FROM u), qt AS ({_variants("qw")}), ut AS ({_variants("uw")}), n AS (SELECT id, count(*) AS n FROM ut GROUP BY 1),
o AS (SELECT qt.id, ut.id AS unit, count(*) AS h FROM qt JOIN ut USING (token) GROUP BY 1, 2),
s AS (SELECT o.id, o.unit, CAST(o.h * 100 + floor(o.h / n.n * 100) AS BIGINT) AS score FROM o JOIN n ON n.id = o.unit WHERE o.h >= 4 AND o.h / n.n >= 0.6
  UNION ALL SELECT q.id, u.id, 10000 FROM q JOIN u ON contains(lower(trim(q.question)), lower(trim(u.title))) WHERE length(trim(u.title)) >= 3),
b AS (SELECT id, unit, max(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY score DESC) AS r FROM b)
SELECT id, min(unit) AS outcome_id, min(score) AS score FROM r WHERE r = 1 GROUP BY 1 HAVING count(*) = 1""",
    "topic_pages": f"""
WITH d AS (SELECT doc_id, text, {_bare_words("text")} AS page FROM documents WHERE text IS NOT NULL AND {_SUBJECT} = 'tarih'),
t AS (SELECT topic_no, {_bare_words("topic")} AS name, list_distinct({_words(_bare_words("topic"), T.STOP_SOURCE, 4)}) AS tokens FROM tyt_tarih),
p AS (SELECT topic_no, i, {_bare_words("s")} AS phrase, list_distinct({_words(_bare_words("s"), T.STOP_SOURCE, 4)}) AS words FROM (SELECT topic_no, unnest(subtopics) AS s, generate_subscripts(subtopics, 1) AS i FROM tyt_tarih) WHERE trim(s) <> ''),
titles AS (SELECT d.doc_id, count(*) AS n FROM d JOIN t ON contains(d.page, t.name) GROUP BY 1),
own AS (SELECT t.topic_no, d.doc_id, contains(d.page, t.name) AS named, len(list_filter(t.tokens, lambda x: contains(d.page, x))) AS hits FROM t, d),
sub AS (SELECT p.topic_no, d.doc_id, contains(d.page, p.phrase) AS whole, len(list_filter(p.words, lambda x: contains(d.page, x))) AS n, len(p.words) AS of FROM p, d),
subs AS (SELECT topic_no, doc_id, sum(CASE WHEN whole THEN 45 WHEN n >= 2 AND n / of >= 0.5 THEN 18 + 4 * n ELSE 0 END) AS points, sum(CASE WHEN whole THEN 2 WHEN n >= 2 AND n / of >= 0.5 THEN 1 ELSE 0 END) AS support FROM sub GROUP BY 1, 2),
scored AS (
  SELECT o.topic_no, o.doc_id, CAST(CASE WHEN length(trim(d.text)) < 120 THEN -1000 ELSE CASE WHEN o.named THEN 140 ELSE 0 END + 10 * o.hits + coalesce(s.points, 0) + CASE WHEN contains(d.page, 'icindekiler') THEN -300 ELSE 0 END
      + CASE WHEN length(d.text) >= 700 THEN 8 ELSE 0 END + CASE WHEN i.n >= 5 THEN -220 ELSE 0 END END AS INTEGER) AS score,
    CAST(CASE WHEN length(trim(d.text)) < 120 THEN 0 ELSE CASE WHEN o.named THEN 2 ELSE 0 END + o.hits + coalesce(s.support, 0) END AS INTEGER) AS support
  FROM own o JOIN d ON d.doc_id = o.doc_id LEFT JOIN subs s ON s.topic_no = o.topic_no AND s.doc_id = o.doc_id LEFT JOIN titles i ON i.doc_id = o.doc_id)
SELECT topic_no, doc_id, score, support, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_no ORDER BY score DESC, support DESC, doc_id) AS rank FROM scored WHERE score >= 30 AND support >= 1) WHERE rank <= 3""",
}

ORACLE |= {
    "extractive_answers": f"""
WITH RECURSIVE s AS (SELECT record_no, piece, row_number() OVER (PARTITION BY record_no ORDER BY line_no, piece_no) - 1 AS place FROM {_SENTENCES}),
e AS (SELECT record_no, {_grounding("outcome_title")} AS q, {_grounding("theme_name")} AS way FROM evidence_records WHERE evidence_text IS NOT NULL AND outcome_title IS NOT NULL),
scored AS (SELECT s.record_no, s.piece, min(s.place) AS place, max(6 * len(list_intersect(e.q, {_grounding("s.piece")})) + 2 * len(list_intersect(e.way, {_grounding("s.piece")}))) AS score FROM s JOIN e ON e.record_no = s.record_no GROUP BY 1, 2),
item AS (SELECT *, length(piece) AS n, row_number() OVER (PARTITION BY record_no ORDER BY score DESC, place) AS i FROM scored),
take AS (
  SELECT record_no, i, n AS signs, 1 AS kept, true AS fits FROM item WHERE i = 1
  UNION ALL
  SELECT x.record_no, x.i, CASE WHEN t.signs + x.n <= 5200 AND t.kept < 14 THEN t.signs + x.n ELSE t.signs END, CASE WHEN t.signs + x.n <= 5200 AND t.kept < 14 THEN t.kept + 1 ELSE t.kept END, t.signs + x.n <= 5200 AND t.kept < 14
  FROM take t JOIN item x ON x.record_no = t.record_no AND x.i = t.i + 1
)
SELECT i.record_no, CAST(count(*) AS INTEGER) AS n_chunks, string_agg(i.piece, chr(10) ORDER BY i.place) AS answer FROM take t JOIN item i ON i.record_no = t.record_no AND i.i = t.i WHERE t.fits GROUP BY 1""",
    "excerpt_windows": f"""
WITH lists AS (SELECT subject, topic_no::BIGINT AS spot, topic, subtopics FROM tyt_tarih UNION ALL SELECT subject, plan_id, topic, subtopics FROM ayt_biyoloji),
first AS (SELECT subject, list_prepend(topic, subtopics) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY spot, topic, subtopics) AS r FROM lists WHERE subtopics IS NOT NULL) WHERE r = 1),
sought AS (SELECT subject, list_filter(list_transform(parts, lambda x: {_bare_words("x")}), lambda x: length(x) >= 5) AS phrases, list_distinct({_words(_bare_words("array_to_string(parts, ' ')"), T.STOP_SOURCE, 4)}) AS tokens FROM first),
d AS (SELECT doc_id, trim(text, ' ') AS t, phrases, tokens FROM documents LEFT JOIN sought USING (subject) WHERE text IS NOT NULL),
long AS (SELECT * FROM d WHERE length(t) > 6000),
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines, phrases, tokens FROM long),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, phrases, tokens FROM cut),
points AS (SELECT doc_id, i, line, CASE WHEN len(list_filter(coalesce(phrases, []), lambda p: contains({_bare_words("line")}, p))) > 0 THEN 20 ELSE 0 END + 2 * len(list_filter(coalesce(tokens, []), lambda p: contains({_bare_words("line")}, p))) AS s FROM line),
best AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS r FROM points WHERE s > 0) WHERE r <= 8),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS t FROM points p WHERE EXISTS (SELECT 1 FROM best b WHERE b.doc_id = p.doc_id AND p.i BETWEEN b.i - 4 AND b.i + 8) GROUP BY 1),
e AS (SELECT d.doc_id, CASE WHEN length(d.t) <= 6000 THEN d.t WHEN k.t IS NOT NULL THEN trim(left(k.t, 6000), ' ') ELSE left(d.t, 6000) END AS x FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id)
SELECT doc_id, length(x) AS n_signs, sha256(x) AS sha256 FROM e""",
}
