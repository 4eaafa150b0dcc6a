"""DuckDB SQL for the queries of the stores, written from their definitions."""

from __future__ import annotations

from kavak.oracle import _LOG, _TSMALL, _bare_words
from kavak.plans.store import PLACEHOLDERS

_TOPICS = """(SELECT exam, subject, topic, topic_no::BIGINT AS spot, difficulty FROM tyt_tarih
  UNION ALL SELECT exam, subject, topic, plan_id, difficulty FROM ayt_biyoloji)"""
_Q = "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS r FROM questions) WHERE r = 1)"
_S = "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS r FROM solutions) WHERE r = 1)"
_LEVEL = "CASE WHEN lower(trim(difficulty)) IN ('basic', 'easy') THEN 'easy' WHEN lower(trim(difficulty)) IN ('intermediate', 'medium') THEN 'medium' WHEN lower(trim(difficulty)) IN ('hard', 'advanced') THEN 'hard' END"
_HELD = " OR ".join(f"contains(lower(t), '{m}')" for m in PLACEHOLDERS)


def _longest(names: str, at: str) -> str:
    """The longest name in each typed topic, the first on ties."""
    return f"""SELECT topic, name FROM (SELECT l.topic, n.name, row_number() OVER (PARTITION BY l.topic ORDER BY length({_TSMALL.format(c="n.name")}) DESC, n.{at}) AS r
  FROM l JOIN {names} n ON length({_TSMALL.format(c="n.name")}) >= 3 AND contains({_TSMALL.format(c="l.topic")}, {_TSMALL.format(c="n.name")})) WHERE r = 1"""


def _first(rows: str, value: str) -> str:
    return f"(SELECT topic, first({value} ORDER BY id) AS v FROM {rows} WHERE {value} IS NOT NULL AND topic IS NOT NULL GROUP BY 1)"


ORACLE: dict[str, str] = {
    "topic_info": f"SELECT exam, subject, topic, spot, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY exam, subject, topic ORDER BY spot, difficulty NULLS FIRST) AS r FROM {_TOPICS}) WHERE r = 1",
    "subject_topics": f"""
SELECT g.grade, t.subject, t.topic, CAST(t.place AS INTEGER) AS place FROM (SELECT DISTINCT grade FROM questions WHERE grade IS NOT NULL) g
JOIN (SELECT *, row_number() OVER (PARTITION BY exam, subject ORDER BY spot, topic) AS place FROM (SELECT exam, subject, topic, min(spot) AS spot FROM {_TOPICS} GROUP BY 1, 2, 3)) t
ON t.exam = CASE WHEN g.grade <= 10 THEN 'TYT' ELSE 'AYT' END""",
    "topics_available": f"SELECT l.subject, l.topic, EXISTS (SELECT 1 FROM {_TOPICS} t WHERE t.subject = l.subject AND t.topic = l.topic) AS available FROM (SELECT DISTINCT subject, topic FROM study_log WHERE topic IS NOT NULL) l",
    "exam_topics": f"SELECT exam, subject, topic, count(*) AS n_rows, min(spot) AS first_at FROM {_TOPICS} GROUP BY 1, 2, 3",
    "units_in_form": f"SELECT {_TSMALL.format(c='subject')} AS subject_form, grade, {_TSMALL.format(c='topic')} AS topic_form, count(DISTINCT id) AS n_questions, count(DISTINCT topic) AS n_spellings, min(id) AS first_id FROM questions WHERE topic IS NOT NULL GROUP BY 1, 2, 3",
    "questions_by_level": f"SELECT subject, grade, topic, {_LEVEL} AS level, count(*) AS n_questions FROM {_Q} GROUP BY 1, 2, 3, 4",
    "question_by_id": f"SELECT id, subject, grade, topic, answer, solution_id FROM {_Q}",
    "solution_by_id": f"SELECT id, question_id, strategy, final_answer FROM {_S}",
    "learning_package": f"""
SELECT t.topic, q.v AS question, m.v AS misconception, c.v AS concept, s.v AS solution FROM (SELECT DISTINCT topic FROM {_Q} WHERE topic IS NOT NULL) t
LEFT JOIN {_first(f"(SELECT *, id AS qid FROM {_Q})", "qid")} q ON q.topic = t.topic LEFT JOIN {_first(_Q, "misconception_target")} m ON m.topic = t.topic
LEFT JOIN {_first(f"(SELECT *, concepts[1] AS concept FROM {_Q})", "concept")} c ON c.topic = t.topic
LEFT JOIN (SELECT q.topic, min(s.id) AS v FROM {_Q} q JOIN {_S} s ON s.question_id = q.id WHERE q.topic IS NOT NULL GROUP BY 1) s ON s.topic = t.topic""",
    "legacy_grade": "SELECT subject, topic, first(grade ORDER BY loaded_at, id) AS grade FROM questions WHERE topic IS NOT NULL GROUP BY 1, 2",
    "detected_topics": f"""
WITH l AS (SELECT DISTINCT topic FROM study_log WHERE topic IS NOT NULL), a AS ({_longest("(SELECT topic_no AS spot, topic AS name FROM tyt_tarih)", "spot")}),
b AS ({_longest("(SELECT topic AS name, min(id) AS spot FROM questions WHERE topic IS NOT NULL GROUP BY 1)", "spot")})
SELECT l.topic, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL THEN 'current' WHEN b.name IS NOT NULL THEN 'legacy' END AS way
FROM l LEFT JOIN a ON a.topic = l.topic LEFT JOIN b ON b.topic = l.topic""",
    "topic_siblings": f"SELECT exam, subject, topic, count(*) OVER (PARTITION BY exam, subject) - 1 AS n_siblings FROM (SELECT DISTINCT exam, subject, topic FROM {_TOPICS})",
    "sibling_title_hits": f"SELECT d.doc_id, count(DISTINCT t.title) AS n_titles FROM documents d JOIN (SELECT topic AS title FROM tyt_tarih UNION SELECT unnest(subtopics) FROM tyt_tarih) t ON contains({_bare_words('d.text')}, {_bare_words('t.title')}) WHERE length({_bare_words('t.title')}) >= 3 AND d.subject = 'Tarih' AND d.text IS NOT NULL GROUP BY 1",
    "promoted_record_ids": """
WITH r AS (SELECT source.package_id AS package_id, nfc_normalize(record_id) AS record_id, record_no, coalesce(review_status = 'READY', false) OR coalesce(evidence_status = 'READY', false) OR coalesce(verification.status = 'READY', false) AS ready
  FROM evidence_records WHERE record_id IS NOT NULL), g AS (SELECT package_id, bool_or(ready) AS some FROM r GROUP BY 1)
SELECT r.package_id, r.record_id, min(r.record_no) AS first FROM r JOIN g ON g.package_id = r.package_id WHERE r.ready OR NOT g.some GROUP BY 1, 2""",
    "source_ids": "SELECT DISTINCT source.package_id AS package_id FROM evidence_records WHERE source.package_id IS NOT NULL",
    "question_references": f"""
SELECT q.id, count(r.ref) AS n_refs, coalesce(string_agg(r.ref, '|' ORDER BY r.spot), '') AS refs FROM {_Q} q
LEFT JOIN (SELECT id, ref, min(spot) AS spot FROM (
  SELECT id, unnest(concepts) AS ref, generate_subscripts(concepts, 1) AS spot FROM {_Q} UNION ALL SELECT id, unnest(tags), 1000 + generate_subscripts(tags, 1) FROM {_Q}) WHERE ref IS NOT NULL GROUP BY 1, 2) r ON r.id = q.id
GROUP BY 1""",
    "excluded_terms": f"SELECT term, count(DISTINCT id) AS n_questions FROM (SELECT id, trim(unnest(tags)) AS term FROM {_Q}) WHERE term <> '' GROUP BY 1",
    "question_items": f"""
WITH q AS (SELECT * FROM {_Q})
SELECT * FROM (SELECT id, 'question' AS path, question AS text FROM q UNION ALL SELECT id, 'answer', answer FROM q
  UNION ALL SELECT id, 'choices[' || (generate_subscripts(choices, 1) - 1) || ']', unnest(choices) FROM q UNION ALL SELECT id, 'concepts[' || (generate_subscripts(concepts, 1) - 1) || ']', unnest(concepts) FROM q
  UNION ALL SELECT id, 'tags[' || (generate_subscripts(tags, 1) - 1) || ']', unnest(tags) FROM q) WHERE text IS NOT NULL""",
    "question_item_values": f"""
SELECT name, count(*) AS n_items, count(*) AS n_same FROM (SELECT 'question' AS name, question AS text FROM {_Q} UNION ALL SELECT 'choices', unnest(choices) FROM {_Q}) WHERE text IS NOT NULL GROUP BY 1""",
    "diagnostics": f"""
WITH m AS (SELECT student_id, NULL AS subject, 1 AS overall, round(avg(score), 6) AS mean_score FROM {_LOG} WHERE score IS NOT NULL GROUP BY 1
  UNION ALL SELECT student_id, subject, 0, round(avg(score), 6) FROM {_LOG} WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN mean_score >= 85 THEN 'advanced' WHEN mean_score >= 65 THEN 'intermediate' WHEN mean_score >= 40 THEN 'basic' ELSE 'beginner' END AS level FROM m""",
    "first_units": f"""
SELECT title_form, record_no, page, image FROM (SELECT {_bare_words("outcome_title")} AS title_form, record_no, source.html_path AS page, source.image_path AS image,
  row_number() OVER (PARTITION BY {_bare_words("outcome_title")} ORDER BY record_no) AS r FROM evidence_records WHERE outcome_title IS NOT NULL) WHERE r = 1""",
    "new_topics": f"SELECT DISTINCT subject, topic FROM {_TOPICS} t WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.subject = t.subject AND q.topic = t.topic)",
    "question_contexts": f"""
WITH q AS (SELECT id, topic, solution_id FROM {_Q} WHERE deleted_at IS NULL), s AS (SELECT id AS sid, min(question_id) AS question_id FROM solutions WHERE deleted_at IS NULL GROUP BY 1),
own AS (SELECT q.id, s.sid AS c FROM q JOIN s ON s.sid = q.solution_id), named AS (SELECT q.id, min(s.sid) AS c FROM q JOIN s ON s.question_id = q.id GROUP BY 1),
shared AS (SELECT q.topic, min(n.c) AS c FROM q JOIN named n ON n.id = q.id WHERE q.topic IS NOT NULL GROUP BY 1)
SELECT q.id, coalesce(o.c, n.c, h.c) AS context, CAST(CASE WHEN o.c IS NOT NULL THEN 0 WHEN n.c IS NOT NULL THEN 1 WHEN h.c IS NOT NULL THEN 2 END AS INTEGER) AS source_rank
FROM q LEFT JOIN own o ON o.id = q.id LEFT JOIN named n ON n.id = q.id LEFT JOIN shared h ON h.topic = q.topic""",
    "listed_pages": f"""
WITH words AS (SELECT topic_no, i, unnest(string_split({_bare_words("s")}, ' ')) AS page, generate_subscripts(string_split({_bare_words("s")}, ' '), 1) AS j FROM (
  SELECT topic_no, unnest(subtopics) AS s, generate_subscripts(subtopics, 1) AS i FROM tyt_tarih)),
tokens AS (SELECT DISTINCT unnest(string_split({_bare_words("outcome_title")}, ' ')) AS page, length(evidence_text) AS n, length(trim(evidence_text)) AS full_length, evidence_text FROM evidence_records WHERE outcome_title IS NOT NULL),
good AS (SELECT page FROM tokens GROUP BY 1 HAVING max(n) >= 0 AND arg_max(full_length, n) >= 120),
met AS (SELECT topic_no, page, min(i * 1000 + j) AS spot FROM words SEMI JOIN good USING (page) GROUP BY 1, 2)
SELECT topic_no, page, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic_no ORDER BY spot, page) AS place FROM met) WHERE place <= 3""",
    "quiz_topics": "SELECT coalesce(nullif(trim(CASE WHEN priority = 'high' THEN topic END), ''), nullif(trim(subtopics[1]), ''), 'Genel') AS quiz_topic, count(*) AS n_plans FROM ayt_biyoloji GROUP BY 1",
    "quiz_results": f"""
WITH q AS (SELECT id, concepts, choices FROM {_Q} WHERE concepts IS NOT NULL), p AS (
  SELECT id, generate_subscripts(concepts, 1) AS i, replace(unnest(concepts), '_', ' ') AS r, choices FROM q), g AS (SELECT id, r, lower(choices[i]) AS g FROM p)
SELECT q.id, CAST(len(q.concepts) AS BIGINT) AS questions, count(*) FILTER (WHERE trim(g.g) = trim(g.r)) AS correct, count(*) FILTER (WHERE g.g IS NOT NULL AND trim(g.g) <> trim(g.r)) AS wrong,
  CASE WHEN len(q.concepts) > 0 THEN 100.0::DOUBLE * count(*) FILTER (WHERE trim(g.g) = trim(g.r)) / len(q.concepts) ELSE 0.0 END AS score
FROM q LEFT JOIN g ON g.id = q.id GROUP BY q.id, q.concepts""",
    "placeholder_quizzes": f"SELECT coalesce(p.held, false) AS placeholder, count(*) AS n_questions FROM {_Q} q LEFT JOIN (SELECT id, bool_or(coalesce({_HELD}, false)) AS held FROM (SELECT id, question AS t FROM {_Q} UNION ALL SELECT id, unnest(choices) FROM {_Q}) GROUP BY 1) p ON p.id = q.id GROUP BY 1",
}
