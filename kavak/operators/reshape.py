"""Nested documents to rows and back: registries, page corpora, claims by kind, texts of pages and their blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_rows(registry: DataFrame, grades: str = "grade_records") -> DataFrame:
    """``(grade, theme_number, theme_name, framework, outcome_id, title, source_page)`` of grade, theme, outcome nests; empty nests give no rows."""
    g = registry.select(F.explode(grades).alias("g")).select("g.grade", F.explode("g.themes").alias("t"))
    o = g.select("grade", "t.theme_number", "t.theme_name", F.col("t.content_framework").alias("framework"), F.explode("t.learning_outcomes").alias("o"))
    return o.select("grade", "theme_number", "theme_name", "framework", F.col("o.id").alias("outcome_id"), F.col("o.title").alias("title"), F.col("o.source_page").alias("source_page"))


def nested_outcomes(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`outcome_rows`: one row a grade, themes and outcomes in order."""
    outcome = F.struct(F.col("outcome_id").alias("id"), "title", "source_page")
    themes = rows.groupBy("grade", "theme_number", "theme_name", F.col("framework").alias("content_framework")).agg(F.array_sort(F.collect_list(outcome)).alias("learning_outcomes"))
    theme = F.struct("theme_number", "theme_name", "content_framework", "learning_outcomes")
    return themes.groupBy("grade").agg(F.array_sort(F.collect_list(theme)).alias("themes"))


def page_rows(corpus: DataFrame, packages: Sequence[str] | None = None) -> DataFrame:
    """``(package_id, page, text, source_anchor)`` of package, page nests, of the packages listed; null texts are empty."""
    p = corpus.select(F.explode("packages").alias("p"))
    if packages is not None:
        p = p.filter(F.col("p.package_id").isin(list(packages)))
    return p.select("p.package_id", F.explode("p.pages").alias("x")).select("package_id", "x.page", F.coalesce("x.text", F.lit("")).alias("text"), "x.source_anchor")


def full_text(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """``(key, full_text)``: a book's pages in order, each after its ``[[PAGE:n]]`` marker; one row a book, as the text is."""
    marked = F.concat(F.lit("[[PAGE:"), F.col(number).cast("string"), F.lit("]]\n"), F.coalesce(F.col(text), F.lit("")))
    item = F.struct(F.col(number).alias("n"), marked.alias("t"))
    return pages.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_p")).select(key, F.array_join(F.transform("_p", lambda x: x["t"]), "\n").alias("full_text"))


def blocks(texts: DataFrame, id: str, text: str, begins: str) -> DataFrame:
    """``(id, place, code, block)``: a text cut before each match of the pattern ``begins``, whose first group is the block's code."""
    parts = F.split(F.col(text), f"(?={begins})")
    rows = texts.select(F.col(id), F.posexplode(parts).alias("place", "block")).withColumn("code", F.regexp_extract("block", f"^{begins}", 1))
    return rows.filter(F.col("code") != "").select(id, "place", "code", F.trim("block").alias("block"))


def frames(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], start: str) -> DataFrame:
    """Each row with where the next one of its key starts (``ends``), null for the last."""
    return rows.withColumn("ends", F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)))


def routed(claims: DataFrame, id: str, kinds: Sequence[str], kind: str, place: str, text: str) -> DataFrame:
    """One row for each ``id`` with an ordered array of texts for each kind; other kinds are left out, absent ones empty."""
    item = F.struct(F.col(place).alias("n"), F.col(text).alias("t"))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, item))), lambda x: x["t"])
    return claims.groupBy(id).agg(*(of(k).alias(k) for k in kinds))


def without_field(rows: DataFrame, column: str, field: str) -> DataFrame:
    """``rows`` with a field dropped from each struct of an array column."""
    return rows.withColumn(column, F.transform(column, lambda x: x.dropFields(field)))
