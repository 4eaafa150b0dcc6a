"""Content and learner files as tables: JSON documents, page folders, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavak.functions.pages import archive_members, code_text
from kavak.functions.scalars import page_number, text_hash
from kavak.functions.text import file_stem, package_name
from kavak.operators.ranking import first_wins

_TOPIC = "subject string, exam string, topic string, subtopics array<string>, priority string, dependencies array<string>, next_topics array<string>, estimated_hours int, difficulty string, question_weight string"
_QUESTION = "id string, subject string, grade string, topic string, difficulty string, concepts array<string>, question string, choices array<string>, answer string, solution_id string, misconception_target string, tags array<string>"
_SOLUTION = "id string, question_id string, strategy string, steps array<string>, final_answer string, common_error string, teacher_note string"
_CONCEPT = "subject string, grade string, topic string, difficulty string, learning_objectives array<string>, summary string"
SCHEMAS = {
    "curriculum": _TOPIC,
    "questions": _QUESTION,
    "solutions": _SOLUTION,
    "concept": _CONCEPT,
    "study_log": "date string, subject string, topic string, duration int, score double",
    "progress": "topics map<string,struct<attempts:int,best_score:double,last_score:double>>",
    "memory": "last_topic string, completed_topics array<string>, weak_topics array<string>, study_history array<struct<topic:string,duration:int>>, quiz_history array<struct<topic:string,score:double>>",
    "manifest": "version string, units array<struct<unit_id:string,record_id:string,canonical_path:string,canonical_text_sha256:string,status:string,student_ready:boolean,student_visible:boolean>>",
    "sources": "sources array<struct<id:string,publisher:string,title:string,url:string,local_path:string,sha256:string>>",
    "mapping": "items array<struct<exam:string,subject:string,topic:string,family_id:string,pages:array<int>>>",
}


def json_table(spark: SparkSession, path: str, kind: str, name: str | None = None) -> DataFrame:
    """The rows of all JSON files of a kind under ``path`` (a file, a folder or a pattern).

    Objects and arrays of objects alike; a byte-order mark is passed over; a
    file that can't be parsed gives no rows, see :func:`broken_files`.  ``name``
    keeps only files so called, in any folder.  ``file`` is the file's path.
    """
    reader = spark.read.schema(T.StructType([*_schema(spark, kind), T.StructField("_broken", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", name) if name else reader).json(path)
    return rows.withColumn("file", F.input_file_name()).filter(F.col("_broken").isNull()).drop("_broken")


def _schema(spark: SparkSession, kind: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[kind])


def broken_files(spark: SparkSession, path: str, name: str = "*.json") -> DataFrame:
    """``(file)`` of the JSON files that can't be parsed."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).text(path)
    bare = F.regexp_replace("value", "^\\x{FEFF}", "")
    return texts.select(F.input_file_name().alias("file"), bare.alias("t")).filter(F.try_parse_json("t").isNull()).select("file")


def units(rows: DataFrame, column: str) -> DataFrame:
    """The elements of a document's array of objects as rows."""
    return rows.select(F.inline(column))


def progress_rows(rows: DataFrame) -> DataFrame:
    """``(topic, attempts, best_score, last_score)`` of progress maps."""
    return rows.select(F.explode("topics").alias("topic", "p")).select("topic", "p.*")


def page_folder(spark: SparkSession, root: str) -> DataFrame:
    """Page files under ``root``: package, page, text, status, hash; copies of a folder (``name (1)``) give way to the first.

    Package is the folder's name without a copy number.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "page*.html").load(root)
    folder = F.url_decode(F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    rows = files.select("path", folder.alias("folder"), package_name(folder).alias("package_id"), page_number(F.col("path")).alias("page"), F.col("content"), text_hash(F.col("content")).alias("html_sha256"))
    rows = first_wins(rows.filter(F.col("page").isNotNull()), ["package_id", "page"], [F.length("folder"), F.col("folder")])
    return rows.select("package_id", "page", "path", "html_sha256", _code(F.decode("content", "UTF-8")).alias("text")).withColumn("text_status", F.when(F.trim("text") != "", "READY").otherwise("MISSING"))


def _code(page: Column) -> Column:
    from kavak.functions.pages import page_code_text

    return page_code_text(page)


def package_summary(pages: DataFrame) -> DataFrame:
    """Pages and ready texts of each package and, with a null package, of all."""
    return pages.rollup("package_id").agg(F.count("*").alias("pages"), F.count_if(F.col("text_status") == "READY").alias("ready"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def archives(spark: SparkSession, root: str, known: list[str], development: str = "dev") -> DataFrame:
    """ZIP archives under ``root`` with status: development, unknown, duplicate (equal bytes, first name wins), empty or valid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    named = files.select("path", "content", file_stem(F.col("path")).alias("name"), text_hash(F.col("content")).alias("sha256"))
    pages = archive_members(named).groupBy("path").agg(F.count("*").alias("pages"), F.countDistinct("page").alias("numbers"))
    first = named.groupBy("sha256").agg(F.min(F.lower("path")).alias("first"))
    rows = named.drop("content").join(first, "sha256").join(pages, "path", "left")
    status = (
        F.when(F.startswith("name", F.lit(development)), "development")
        .when(~F.col("name").isin(known), "unknown")
        .when(F.lower("path") != F.col("first"), "duplicate")
        .when(F.coalesce("pages", F.lit(0)) == 0, "empty")
        .otherwise("valid")
    )
    return rows.select("path", "name", "sha256", F.coalesce("pages", F.lit(0)).alias("pages"), status.alias("status"))


def missing_numbers(pages: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, number)`` of the numbers from 1 to the greatest that a key lacks."""
    spans = pages.groupBy(key).agg(F.max(number).alias("m")).filter("m >= 1").select(key, F.explode(F.sequence(F.lit(1), F.col("m"))).alias(number))
    return spans.join(pages.select(key, number).distinct(), [key, number], "left_anti")


__all__ = ["SCHEMAS", "archives", "broken_files", "code_text", "json_table", "missing_numbers", "package_summary", "page_folder", "progress_rows", "units"]
