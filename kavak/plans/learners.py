"""Plans over the study log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.functions import scalars as S
from kavak.operators import learner, ranking
from kavak.sources.tables import table


def study_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log without rows that arrived again."""
    return learner.once(table(spark, folder, "study_log"), "log_id", "logged_at")


def topic_study_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, minutes, mean score and band of each subject and topic."""
    return learner.study_summary(study_log(spark, folder), ["subject", "topic"], "duration", "score")


def learner_insight(spark: SparkSession, folder: str) -> DataFrame:
    """Weak and strong topics, minutes and priority of each learner."""
    by_topic = learner.study_summary(study_log(spark, folder).filter(F.col("topic").isNotNull()), ["student_id", "topic"], "duration", "score")
    return learner.insight(by_topic, ["student_id"])


def topic_history(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one list topic in the order of the log."""
    rows = study_log(spark, folder).filter((F.col("subject") == "Tarih") & (F.col("topic") == "Hitit Hukuku"))
    return ranking.with_neighbours(rows, ["student_id"], [F.col("log_id")], "log_id", "log_before", "log_after").select("log_id", "student_id", "duration", "score", "log_before", "log_after")


def distinct_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of the log with how many topics and learners they have."""
    return table(spark, folder, "study_log").groupBy("subject").agg(F.countDistinct("topic").alias("n_topics"), F.countDistinct("student_id").alias("n_learners"))


def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the log by level, mastery band and result band."""
    score = F.col("score")
    level = S.label(score, [(85, "advanced"), (65, "intermediate"), (40, "basic")], "beginner")
    mastery = S.label(score, [(90, "mastered"), (75, "good"), (50, "developing")], "weak")
    result = S.label(S.share_of_hundred(score), [(0.8, "mastered"), (0.6, "developing")], "weak")
    return study_log(spark, folder).groupBy(level.alias("level"), mastery.alias("mastery"), result.alias("result")).agg(F.count("*").alias("n_rows"))


def study_days(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by month of the dates in either spelling, and how many dates can't be read."""
    day = learner.study_date(F.col("date"))
    return study_log(spark, folder).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("duration"), F.lit(0)).alias("minutes"))


def progress_state(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts, best and last score of each learner and topic over scored rows."""
    rows = study_log(spark, folder).filter(F.col("score").isNotNull() & F.col("topic").isNotNull())
    return learner.progress(rows, ["student_id", "topic"], "score", ["logged_at", "log_id"])


def completed_and_weak(spark: SparkSession, folder: str) -> DataFrame:
    """How many topics each learner completed (a score of 80 or more once) and had weak once; a topic may be both."""
    rows = study_log(spark, folder).filter(F.col("score").isNotNull() & F.col("topic").isNotNull())
    return rows.groupBy("student_id").agg(
        F.countDistinct(F.when(F.col("score") >= 80, F.col("topic"))).alias("n_completed"), F.countDistinct(F.when(F.col("score") < 80, F.col("topic"))).alias("n_weak")
    )


def topics_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic of each learner once, in the order in which they came."""
    return learner.first_seen(study_log(spark, folder), "student_id", "topic", "log_id").select("student_id", "topic", "first_at", "place")


def last_topic(spark: SparkSession, folder: str) -> DataFrame:
    """The last topic of each learner."""
    rows = study_log(spark, folder).filter(F.col("topic").isNotNull())
    return rows.groupBy("student_id").agg(F.max_by("topic", F.struct("logged_at", "log_id")).alias("last_topic"))


def study_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and minutes of each subject in windows of seven days, as the stream gives them."""
    rows = study_log(spark, folder).withColumn("at", F.col("logged_at").cast("timestamp"))
    sums = rows.groupBy(F.window("at", "7 days"), "subject").agg(F.count("*").alias("n_rows"), F.sum("duration").alias("minutes"))
    return sums.select(F.date_format("window.start", "yyyy-MM-dd").alias("starts"), "subject", "n_rows", "minutes")


QUERIES = (
    topic_study_summary, learner_insight, topic_history, distinct_subjects, score_bands, study_days, progress_state, completed_and_weak, topics_in_order, last_topic, study_windows,
)
