"""Plans over the content tables: topic hierarchies and broken references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.functions.keys import plain_key
from kavak.operators.hierarchy import ancestors, hierarchy, named_edges
from kavak.operators.references import FOUND, MATCHES, judged, orphans
from kavak.plans.lineage import written
from kavak.sources.tables import table


def _topics(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return named_edges(table(spark, folder, "ayt_biyoloji"), "plan_id", "topic", "dependencies", "next_topics")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each topic with each of its ancestors in its plan, and the steps between them."""
    found = ancestors(*_topics(spark, folder))
    return found.select(F.col("group").alias("plan_id"), "ancestor", F.col("node").alias("topic"), "steps")


def p1_places(spark: SparkSession, folder: str) -> DataFrame:
    """Each topic's path, depth, root, preorder range and descendants in its plan, and whether it is on or below a loop."""
    places = hierarchy(*_topics(spark, folder)).withColumn("path", F.array_join("path", " > "))
    return places.withColumnRenamed("group", "plan_id").withColumnRenamed("node", "topic")


def _references(spark: SparkSession, folder: str) -> list[DataFrame]:
    def read(name: str, id: str, key: str, *deleted: str) -> DataFrame:
        # keys are brought to form once, however many joins take them
        rows = table(spark, folder, name)
        gone = F.col(deleted[0]) if deleted else F.lit(None).cast("timestamp")
        return written(rows.select(F.col(id).alias("id"), plain_key(F.col(key)).alias("ref"), plain_key(F.col(id)).alias("own"), "created_at", gone.alias("deleted_at")), name)

    questions = read("questions", "id", "solution_id", "deleted_at")
    solutions = read("solutions", "id", "question_id", "deleted_at")
    manifest = read("biology_release_manifest", "unit_id", "record_id")
    evidence = written(table(spark, folder, "evidence_records").select(plain_key(F.col("record_id")).alias("own"), "created_at", "deleted_at"), "evidence")
    alive = lambda rows: rows.filter(F.col("deleted_at").isNull())
    made = ("created_at", "deleted_at")
    return [
        orphans(alive(questions), "questions", "id", ["ref"], "created_at", solutions, ["own"], *made),
        orphans(alive(solutions), "solutions", "id", ["ref"], "created_at", questions, ["own"], *made),
        orphans(manifest, "biology_release_manifest", "id", ["ref"], "created_at", evidence, ["own"], *made),
    ]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to rows that are absent, deleted or written later."""
    a, b, c = _references(spark, folder)
    return a.union(b).union(c)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references by table, month and kind."""
    return p4_found(spark, folder).groupBy("src_table", "period", "kind").agg(F.count("*").alias("n_references"))


def p4_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Solutions whose pair (own id, question) isn't a pair (solution, id) of the questions, under each match semantics.

    A composite reference with partial nulls (a solution may lack its question);
    ``null_mask`` has a 1 for each key that is there.
    """
    questions, solutions = table(spark, folder, "questions"), table(spark, folder, "solutions")
    refs = solutions.filter(F.col("deleted_at").isNull()).select("id", plain_key(F.col("id")).alias("k1"), plain_key(F.col("question_id")).alias("k2"), "created_at")
    held = questions.select(plain_key(F.col("solution_id")).alias("r1"), plain_key(F.col("id")).alias("r2"), "created_at", "deleted_at")
    out = None
    for match in MATCHES:
        rows = judged(refs, ["k1", "k2"], "created_at", held, ["r1", "r2"], "created_at", "deleted_at", match).filter(F.col("kind") != FOUND)
        mask = F.concat(F.when(F.col("k1") != "", "1").otherwise("0"), F.when(F.col("k2") != "", "1").otherwise("0"))
        part = rows.select(F.lit(match).alias("match"), F.col("id").alias("src_id"), mask.alias("null_mask"), "kind", F.date_format("created_at", "yyyy-MM").alias("period")).distinct()
        out = part if out is None else out.union(part)
    return out
