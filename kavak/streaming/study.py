"""Running summaries of the study log: windows with late data, and the latest state of each learner and topic."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "log_id bigint, student_id bigint, date string, subject string, topic string, duration int, score double, logged_at timestamp"


def study_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Study records as they are added to a Parquet folder."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(log: DataFrame, late: str = "14 days", window: str = "7 days", at: str = "logged_at") -> DataFrame:
    """Rows, minutes and mean score of each subject in tumbling windows; rows later than ``late`` are passed over.

    Repeated arrivals of a record (equal ``log_id`` within the watermark) count once.
    """
    once = log.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["log_id"])
    sums = once.groupBy(F.window(at, window), "subject").agg(F.count("*").alias("n_rows"), F.sum("duration").alias("minutes"), F.avg("score").alias("mean_score"))
    return sums.select(F.col("window.start").alias("starts"), "subject", "n_rows", "minutes", "mean_score")


def sessions(log: DataFrame, gap: str = "2 hours", late: str = "14 days", at: str = "logged_at") -> DataFrame:
    """Study sessions of each learner: records no further apart than ``gap``."""
    seen = log.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    sums = seen.groupBy("student_id", F.session_window(at, gap)).agg(F.count("*").alias("n_rows"), F.sum("duration").alias("minutes"))
    return sums.select("student_id", F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n_rows", "minutes")


def _state(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    attempts, best, last, at = state.get if state.exists else (0, 0.0, None, 0)
    for pdf in batches:
        for score, when in sorted(zip(pdf["score"], pdf["at"]), key=lambda x: x[1]):
            attempts += 1
            if score == score and score is not None:
                best = max(best, float(score))
                if when >= at:
                    last, at = float(score), int(when)
    state.update((attempts, best, last, at))
    yield pd.DataFrame([(*key, attempts, best, last)], columns=["student_id", "topic", "attempts", "best_score", "last_score"])


def progress_stream(log: DataFrame, at: str = "logged_at") -> DataFrame:
    """Attempts, best and last score of each learner and topic, a row at each change (state kept between batches)."""
    rows = log.filter(F.col("topic").isNotNull()).select("student_id", "topic", "score", F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    return rows.groupBy("student_id", "topic").applyInPandasWithState(
        _state, "student_id bigint, topic string, attempts long, best_score double, last_score double", "attempts long, best double, last double, at long", "update", GroupStateTimeout.NoTimeout
    )


def run_to_folder(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, written to a Parquet folder; the checkpoint folder makes a rerun go on where it ended."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
