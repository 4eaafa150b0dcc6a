"""Learner data: study summaries, quiz scores, progress state and conversation histories as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavak.functions.scalars import label


def study_date(c: Column) -> Column:
    """A date of the log, ``yyyy-MM-dd`` or ``dd.MM.yyyy``; null for others."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy"))).cast("date")


def once(log: DataFrame, key: str, arrived: str) -> DataFrame:
    """The log without rows that arrived again: the first arrival of each key."""
    rest = [c for c in log.columns if c not in (key, arrived)]
    return log.groupBy(key).agg(F.min(F.struct(arrived, *rest)).alias("_r")).select(key, f"_r.{arrived}", *(f"_r.{c}" for c in rest))


def study_summary(log: DataFrame, keys: Sequence[str], minutes: str, score: str, weak: float = 60, strong: float = 80) -> DataFrame:
    """Sums and means of each key: a null score doesn't count, its minutes do; ``band`` by the mean score (null without one)."""
    out = log.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(minutes).alias("minutes"), F.round(F.avg(score), 6).alias("mean_score"))
    return out.withColumn("band", label(F.col("mean_score"), [(strong, "strong"), (weak, "medium")], "weak"))


def insight(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weak and strong topics, total minutes and the priority of each key over its summary rows."""
    out = summary.groupBy(*keys).agg(
        F.count_if(F.col("band") == "weak").alias("weak_topics"), F.count_if(F.col("band") == "strong").alias("strong_topics"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("total_minutes")
    )
    return out.withColumn("priority", F.when(F.col("weak_topics") >= 3, "high").when(F.col("weak_topics") > 0, "medium").otherwise("low"))


def progress(results: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Attempts, best score (0 at least) and last score of each key; the order's columns break ties."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.greatest(F.lit(0.0), F.max(score)).alias("best_score"), F.max_by(score, F.struct(*order)).alias("last_score")
    )


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each value of a key once, numbered by its first place (a set that keeps the order of insertion)."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first_at"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first_at", value)))


def quiz_scores(quizzes: DataFrame, id: str, right: str, given: str) -> DataFrame:
    """Right answers by place over the number of questions, in per cent; further answers are ignored, missing ones aren't wrong ones."""
    n = F.size(F.col(right))
    pairs = F.arrays_zip(F.slice(F.col(given), F.lit(1), n).alias("g"), F.col(right).alias("r"))
    correct = F.size(F.filter(pairs, lambda x: F.trim(x["g"]) == F.trim(x["r"])))
    wrong = F.size(F.filter(pairs, lambda x: x["g"].isNotNull() & (F.trim(x["g"]) != F.trim(x["r"]))))
    return quizzes.select(id, n.alias("questions"), correct.alias("correct"), wrong.alias("wrong"), F.when(n > 0, 100.0 * correct / n).otherwise(0.0).alias("score"))


def history(messages: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """The messages of each conversation in order as one array; long conversations are one row, as the context is."""
    item = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return messages.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("messages"), F.count("*").alias("n_messages"))
