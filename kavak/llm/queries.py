"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.llm import canonical, encode, languages, leaks, neardup, unlike
from kavak.sources.tables import spread, table

FIELDS = ["evidence_text", "outcome_title"]
#: Records are alike from this share of common runs of three words on.
LIKENESS = 0.45


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "evidence_records").select("record_no", *columns))


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that aren't in plain form."""
    return unlike.not_plain(_records(spark, folder, *FIELDS), "record_no", FIELDS)


def p2_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The plain form of every value."""
    return unlike.plain_forms(_records(spark, folder, *FIELDS), "record_no", FIELDS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of alike records."""
    pairs, members = neardup.alike(_records(spark, folder, "evidence_text"), "record_no", "evidence_text", LIKENESS)
    return neardup.all_pairs(pairs, members).select(F.col("a").alias("record_no_a"), F.col("b").alias("record_no_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record that takes part: its class, the class's records and the alike classes."""
    pairs, members = neardup.alike(_records(spark, folder, "evidence_text"), "record_no", "evidence_text", LIKENESS)
    return neardup.links(pairs, members).withColumnRenamed("id", "record_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The list's topic that each typed topic means."""
    typed = table(spark, folder, "study_log").filter(F.col("subject") == "Tarih")
    return canonical.mapped_values(typed, "log_id", "topic", table(spark, folder, "tyt_tarih"), "topic_no", "topic")


def p5_near(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic of the list within the limits of each typed topic, with its edits."""
    typed = table(spark, folder, "study_log").filter(F.col("subject") == "Tarih")
    return canonical.near_values(typed, "topic", table(spark, folder, "tyt_tarih").withColumnRenamed("topic", "name"), "topic_no", "name")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document."""
    return encode.encode(_documents(spark, folder), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leaks.leaks(_documents(spark, folder), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each item each of these documents holds."""
    found = leaks.containments(_documents(spark, folder), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.withColumn("containment", F.round("containment", 6))


def _model(spark: SparkSession, folder: str) -> bytes:
    return languages.fitted(table(spark, folder, "lang_samples"), "lang", "text", table(spark, folder, "documents"), "doc_id", "lang", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong or whose text mixes languages."""
    return languages.mislabelled(_documents(spark, folder, "lang"), "doc_id", "text", "lang", _model(spark, folder))


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of every document, with sentences and confidence."""
    found = languages.languages(_documents(spark, folder), "doc_id", "text", _model(spark, folder))
    return found.select("doc_id", F.explode_outer("languages").alias("x")).select("doc_id", "x.lang", "x.sentences", "x.confidence")


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of one language in every document."""
    return languages.segments(_documents(spark, folder), "doc_id", "text", _model(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_plain, p3_found, p3_groups, p5_found, p5_near, p6_ids, p7_found, p7_shares, p8_found, p8_languages, p8_segments)}
