"""Plans over the stores of topics, questions, solutions and evidence: lookups, alias filters and choices, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.functions import scalars as S
from kavak.functions import text as X
from kavak.operators import learner, lookups, matching, ranking
from kavak.sources.tables import table

# Markers of a quiz that isn't written yet.
PLACEHOLDERS = ("örnek soru", "placeholder", "todo", "lorem")


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    """Both exams' topics with a number that gives their order."""
    a = table(spark, folder, "tyt_tarih").select("exam", "subject", "topic", F.col("topic_no").cast("long").alias("spot"), "difficulty", "subtopics")
    b = table(spark, folder, "ayt_biyoloji").select("exam", "subject", "topic", F.col("plan_id").alias("spot"), "difficulty", "subtopics")
    return a.union(b)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The first arrival of each question."""
    return ranking.first_wins(table(spark, folder, "questions"), ["id"], [F.col("loaded_at")])


def topic_info(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each (exam, subject, topic), names as they stand."""
    rows = _topics(spark, folder)
    return ranking.first_wins(rows.select("exam", "subject", "topic", "spot", "difficulty"), ["exam", "subject", "topic"], [F.col("spot"), F.col("difficulty")])


def subject_topics(spark: SparkSession, folder: str) -> DataFrame:
    """For each grade of the questions the topics of its exam, numbered in order."""
    topics = _topics(spark, folder).groupBy("exam", "subject", "topic").agg(F.min("spot").alias("spot"))
    listed = topics.withColumn("place", F.row_number().over(ranking.Window.partitionBy("exam", "subject").orderBy("spot", "topic")))
    return lookups.topics_of_grades(listed, table(spark, folder, "questions")).select("grade", "subject", "topic", "place")


def topics_available(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each subject and topic of the study log stands in the topic lists."""
    log = table(spark, folder, "study_log").select("subject", "topic").filter(F.col("topic").isNotNull()).distinct()
    return lookups.with_membership(log, ["subject", "topic"], _topics(spark, folder))


def exam_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics by exam and subject as often as they stand."""
    return _topics(spark, folder).groupBy("exam", "subject", "topic").agg(F.count("*").alias("n_rows"), F.min("spot").alias("first_at"))


def units_in_form(spark: SparkSession, folder: str) -> DataFrame:
    """Question units by subject, grade and topic in one form, with their spellings."""
    rows = table(spark, folder, "questions").filter(F.col("topic").isNotNull())
    form = X.turkish_small(F.col("topic"))
    return rows.groupBy(X.turkish_small(F.col("subject")).alias("subject_form"), "grade", form.alias("topic_form")).agg(F.countDistinct("id").alias("n_questions"), F.countDistinct("topic").alias("n_spellings"), F.min("id").alias("first_id"))


def questions_by_level(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of each exact subject, grade and topic by the level their difficulty means."""
    rows = _questions(spark, folder)
    return rows.groupBy("subject", "grade", "topic", lookups.level(F.col("difficulty")).alias("level")).agg(F.count("*").alias("n_questions"))


def question_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The first arrival of each question id."""
    return _questions(spark, folder).select("id", "subject", "grade", "topic", "answer", "solution_id")


def solution_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The first arrival of each solution id."""
    rows = ranking.first_wins(table(spark, folder, "solutions").select("id", "question_id", "strategy", "final_answer", "loaded_at"), ["id"], [F.col("loaded_at")])
    return rows.select("id", "question_id", "strategy", "final_answer")


def learning_package(spark: SparkSession, folder: str) -> DataFrame:
    """For each topic its first question, misconception, example and solution, whatever subject and grade."""
    q = _questions(spark, folder)
    s = ranking.first_wins(table(spark, folder, "solutions").select("question_id", "id", "loaded_at"), ["id"], [F.col("loaded_at")])
    solved = q.select("topic", F.col("id").alias("qid")).join(s.select(F.col("question_id").alias("qid"), F.col("id").alias("sid")), "qid")
    example = q.select("topic", "id", F.get("concepts", F.lit(0)).alias("concept"))
    return lookups.by_topic({"question": (q.withColumn("qid", F.col("id")), "qid"), "misconception": (q, "misconception_target"), "concept": (example, "concept"), "solution": (solved.withColumn("id", F.col("sid")), "sid")}, "topic", "id")


def legacy_grade(spark: SparkSession, folder: str) -> DataFrame:
    """The first grade in which each subject's topic stands."""
    rows = table(spark, folder, "questions").filter(F.col("topic").isNotNull())
    return rows.groupBy("subject", "topic").agg(F.min_by("grade", F.struct("loaded_at", "id")).alias("grade"))


def detected_topics(spark: SparkSession, folder: str) -> DataFrame:
    """What each typed study topic names: the longest list topic in it, else the longest question topic, else nothing."""
    log = table(spark, folder, "study_log").filter(F.col("topic").isNotNull()).select("topic").distinct()
    now = matching.longest_contained(log, "topic", "topic", table(spark, folder, "tyt_tarih").select("topic_no", F.col("topic").alias("name")), "name", "topic_no", X.turkish_small)
    old = table(spark, folder, "questions").filter(F.col("topic").isNotNull()).groupBy(F.col("topic").alias("name")).agg(F.min("id").alias("spot"))
    legacy = matching.longest_contained(log, "topic", "topic", old, "name", "spot", X.turkish_small)
    found = lookups.preferred([now.select("topic", "name"), legacy.select("topic", "name")], ["topic"], "name")
    return log.join(found, "topic", "left").select("topic", "name", F.when(F.col("source_rank") == 0, "current").when(F.col("source_rank") == 1, "legacy").alias("way"))


def topic_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """How many other topics stand beside each one in its exam and subject."""
    return lookups.siblings(_topics(spark, folder), ["exam", "subject"], "topic")


def sibling_title_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many titles of the history list, topics and subtopics, stand in each history document."""
    docs = table(spark, folder, "documents").filter((F.col("subject") == "Tarih") & F.col("text").isNotNull()).select("doc_id", "text")
    titles = table(spark, folder, "tyt_tarih").select(F.explode(F.concat(F.array("topic"), F.coalesce("subtopics", F.array().cast("array<string>")))).alias("title")).distinct()
    return matching.contained(docs, "doc_id", "text", titles, "title", X.bare_words).groupBy("doc_id").agg(F.countDistinct("title").alias("n_titles"))


def promoted_record_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each package's record ids: of its ready records if it has any, else of all."""
    rows = table(spark, folder, "evidence_records").select("record_no", "record_id", F.col("source.package_id").alias("package_id"), "review_status", "evidence_status", F.col("verification.status").alias("verified"))
    return lookups.ready_or_all(rows, "package_id", "record_id", [F.col("review_status"), F.col("evidence_status"), F.col("verified")], "record_no")


def source_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The packages that records come from."""
    return table(spark, folder, "evidence_records").select(F.col("source.package_id").alias("package_id")).filter(F.col("package_id").isNotNull()).distinct()


def question_references(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts, then tags, of each question, each once, in order."""
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    refs = F.array_distinct(F.concat(filled(F.col("concepts")), filled(F.col("tags"))))
    return _questions(spark, folder).select("id", F.size(refs).cast("long").alias("n_refs"), F.array_join(refs, "|").alias("refs"))


def excluded_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that aren't blank, trimmed, with how many questions have them."""
    terms = F.explode(X.distinct_values(F.col("tags")))
    return _questions(spark, folder).select("id", terms.alias("term")).groupBy("term").agg(F.countDistinct("id").alias("n_questions"))


def question_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of each question with its path."""
    return lookups.unpivoted(_questions(spark, folder), "id", ["question", "answer"], ["choices", "concepts", "tags"])


def question_item_values(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of questions are found again at their paths, by name."""
    rows = _questions(spark, folder)
    back = lookups.unpivoted(rows, "id", ["question"], ["choices"]).join(rows.select("id", "question", "choices"), "id")
    same = lookups.path_value("", F.col("path"), ["question"], ["choices"]).eqNullSafe(F.col("text"))
    return back.groupBy(F.regexp_extract("path", "^([^\\[]+)", 1).alias("name")).agg(F.count("*").alias("n_items"), F.count_if(same).alias("n_same"))


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean score and level of each learner, in all and by subject."""
    log = learner.once(table(spark, folder, "study_log"), "log_id", "logged_at").filter(F.col("score").isNotNull())
    means = log.groupingSets([[F.col("student_id")], [F.col("student_id"), F.col("subject")]], F.col("student_id"), F.col("subject")).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.grouping("subject").cast("int").alias("overall"))
    return means.select("student_id", "subject", "overall", "mean_score", S.label(F.col("mean_score"), [(85, "advanced"), (65, "intermediate"), (40, "basic")], "beginner").alias("level"))


def first_units(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each outcome title in one form, with its page and the file beside it."""
    rows = table(spark, folder, "evidence_records").filter(F.col("outcome_title").isNotNull()).select("record_no", X.bare_words(F.col("outcome_title")).alias("title_form"), F.col("source.html_path").alias("page"), F.col("source.image_path").alias("image"))
    return ranking.first_wins(rows, ["title_form"], [F.col("record_no")])


def new_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of the lists without any question yet."""
    topics = _topics(spark, folder).select("subject", "topic").distinct()
    return topics.join(table(spark, folder, "questions").select("subject", "topic").distinct(), ["subject", "topic"], "left_anti")


def question_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Where each question's context comes from: its own solution, a solution that names it, or another of its topic."""
    q = _questions(spark, folder).filter(F.col("deleted_at").isNull()).select("id", "topic", "solution_id")
    s = table(spark, folder, "solutions").filter(F.col("deleted_at").isNull()).groupBy(F.col("id").alias("sid")).agg(F.min("question_id").alias("question_id"))
    own = q.join(s, q["solution_id"] == s["sid"]).select("id", F.col("sid").alias("context"))
    named = q.join(s, q["id"] == s["question_id"]).groupBy("id").agg(F.min("sid").alias("context"))
    by_topic = q.select("topic", "id").join(named, "id").groupBy("topic").agg(F.min("context").alias("context"))
    shared = q.join(by_topic, "topic").select("id", "context")
    return q.select("id").join(lookups.preferred([own, named, shared], ["id"], "context"), "id", "left").select("id", "context", F.col("source_rank").cast("int").alias("source_rank"))


def listed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """For each topic of a plan the first three documents, in the order of its listed subtopics, whose kind they are and that are long enough."""
    lists = table(spark, folder, "tyt_tarih").select("topic_no", F.transform("subtopics", X.bare_words).alias("refs"))
    pages = table(spark, folder, "evidence_records").filter(F.col("outcome_title").isNotNull()).select(F.explode(F.array_distinct(F.split(X.bare_words(F.col("outcome_title")), " "))).alias("page"), "evidence_text").groupBy("page").agg(F.max_by("evidence_text", F.length("evidence_text")).alias("evidence_text"))
    words = lists.select("topic_no", F.flatten(F.transform("refs", lambda r: F.split(r, " "))).alias("refs"))
    return lookups.in_listed_order(words, "topic_no", "refs", pages, "page", "evidence_text")


def quiz_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The topic that a quiz of each plan row takes: its own, else its first subtopic, else the general one."""
    rows = table(spark, folder, "ayt_biyoloji")
    return rows.groupBy(lookups.plan_topic(F.when(F.col("priority") == "high", F.col("topic")), F.col("subtopics"), "Genel").alias("quiz_topic")).agg(F.count("*").alias("n_plans"))


def quiz_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's choices scored as answers to its concepts, by place."""
    rows = _questions(spark, folder).select("id", F.transform("choices", F.lower).alias("given"), F.transform("concepts", lambda x: F.replace(x, F.lit("_"), F.lit(" "))).alias("right"))
    return learner.quiz_scores(rows.filter(F.col("right").isNotNull()), "id", "right", "given").select("id", F.col("questions").cast("long"), F.col("correct").cast("long"), F.col("wrong").cast("long"), "score")


def placeholder_quizzes(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with and without markers of texts that aren't written yet."""
    marked = lookups.holds_placeholder(F.concat(F.array("question"), F.coalesce("choices", F.array().cast("array<string>"))), PLACEHOLDERS)
    return _questions(spark, folder).groupBy(marked.alias("placeholder")).agg(F.count("*").alias("n_questions"))


QUERIES = (
    topic_info, subject_topics, topics_available, exam_topics, units_in_form, questions_by_level, question_by_id, solution_by_id, learning_package, legacy_grade, detected_topics, topic_siblings,
    sibling_title_hits, promoted_record_ids, source_ids, question_references, excluded_terms, question_items, question_item_values, diagnostics, first_units, new_topics, question_contexts, listed_pages,
    quiz_topics, quiz_results, placeholder_quizzes,
)
