"""Point lookups, alias filters and choices between sources over content tables.

Lookups that give "the first match" take an order, since a table has none of
its own.  Null keys match nothing; a lookup that finds nothing gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavak.operators.ranking import first_wins

# Spellings of the three levels of difficulty.
LEVELS = {"easy": ("basic", "easy"), "medium": ("intermediate", "medium"), "hard": ("hard", "advanced")}
#: Up to this grade a topic belongs to the first exam's list, above it to the second's.
LAST_BASIC_GRADE = 10


def matching(rows: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the values, exactly (12 isn't "12", case counts); a value of None is no condition."""
    return reduce(lambda d, v: d.filter(F.col(v[0]) == F.lit(v[1])), ((k, v) for k, v in values.items() if v is not None), rows)


def first_matching(rows: DataFrame, order: Sequence[Column], **values: object) -> DataFrame:
    """The first of :func:`matching`, one row at most."""
    return matching(rows, **values).orderBy(*order).limit(1)


def matching_in_form(rows: DataFrame, norm, **values: str) -> DataFrame:
    """Rows whose columns equal the values when both are put through ``norm``."""
    return reduce(lambda d, v: d.filter(norm(F.col(v[0]).cast("string")) == norm(F.lit(str(v[1])))), values.items(), rows)


def level(difficulty: Column, levels: Mapping[str, Sequence[str]] = LEVELS) -> Column:
    """The level that a spelling of difficulty means, null for none."""
    out = F.lit(None).cast("string")
    for name, spellings in levels.items():
        out = F.when(F.lower(F.trim(difficulty)).isin(*spellings), name).otherwise(out)
    return out


def questions_for(questions: DataFrame, subject: str, grade: int, topic: str, difficulty: str | None = None) -> DataFrame:
    """Questions of exactly this subject, grade and topic, of any spelling of the difficulty if one is given."""
    rows = matching(questions, subject=subject, grade=grade, topic=topic)
    return rows if difficulty is None else rows.filter(level(F.col("difficulty")) == level(F.lit(difficulty)))


def exam_of_grade(grade: Column, basic: str = "TYT", advanced: str = "AYT") -> Column:
    """The exam whose topic list a grade learns from; null for null."""
    return F.when(grade <= LAST_BASIC_GRADE, basic).when(grade > LAST_BASIC_GRADE, advanced)


def topics_of_grades(topics: DataFrame, grades: DataFrame) -> DataFrame:
    """``topics`` (with ``exam``) for each row of ``grades`` (with ``grade``) whose exam they belong to."""
    return grades.select("grade").distinct().withColumn("exam", exam_of_grade(F.col("grade"))).join(topics, "exam")


def with_membership(rows: DataFrame, keys: Sequence[str], members: DataFrame, name: str = "available") -> DataFrame:
    """``rows`` with whether their keys stand in ``members`` (null keys don't)."""
    known = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(known, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def by_topic(parts: Mapping[str, tuple[DataFrame, str]], topic: str, order: str) -> DataFrame:
    """``(topic, parts...)``: for each topic the first value of each part, whatever its subject and grade.

    A part is (rows with ``topic`` and ``order``, value column); null values
    don't count; a topic stands if any part has it.
    """
    out = None
    for name, (rows, value) in parts.items():
        first = rows.filter(F.col(value).isNotNull() & F.col(topic).isNotNull()).groupBy(topic).agg(F.min_by(value, order).alias(name))
        out = first if out is None else out.join(first, topic, "full")
    return out


def preferred(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, source_rank)``: of several sources the first that has a value for the keys."""
    ranked = [s.select(*keys, value, F.lit(i).alias("source_rank")).filter(F.col(value).isNotNull()) for i, s in enumerate(sources)]
    return first_wins(reduce(DataFrame.unionByName, ranked), keys, [F.col("source_rank"), F.col(value)])


def in_listed_order(lists: DataFrame, key: str, refs: str, pages: DataFrame, page: str, text: str, least: int = 120, k: int = 3) -> DataFrame:
    """The first ``k`` pages of each key's list, in the list's order, whose text has ``least`` signs or more."""
    flat = lists.select(key, F.posexplode(refs).alias("listed", page))
    good = pages.filter(F.length(F.trim(text)) >= least)
    held = flat.join(good.select(page, text), page).groupBy(key, page).agg(F.min("listed").alias("listed"))
    from kavak.operators.ranking import top_k

    return top_k(held, [key], [F.col("listed"), F.col(page)], k, "place").select(key, page, "place")


def siblings(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``(keys, name, n_siblings)``: how many other names stand under the same keys."""
    one = rows.select(*keys, name).distinct()
    return one.join(one.groupBy(*keys).agg((F.count("*") - 1).alias("n_siblings")), list(keys))


def ready_or_all(rows: DataFrame, group: str, id: str, statuses: Sequence[Column], order: str, ready: str = "READY") -> DataFrame:
    """``(group, id, first)``: each group's ids once, of its ready rows if it has any, else of all.

    Ready is a row with ``ready`` in any of the statuses; ids compare in
    composed letters; ``first`` is the least ``order``.
    """
    from kavak.functions.pages import composed

    is_ready = reduce(lambda a, b: a | b, (F.coalesce(s == ready, F.lit(False)) for s in statuses))
    ids = rows.filter(F.col(id).isNotNull()).groupBy(group, composed(F.col(id)).alias(id)).agg(F.min(order).alias("first"), F.min(F.when(is_ready, F.col(order))).alias("_ready"))
    any_ready = ids.groupBy(group).agg(F.count("_ready").alias("_n"))
    kept = ids.join(any_ready, group).filter((F.col("_n") == 0) | F.col("_ready").isNotNull())
    return kept.select(group, id, F.coalesce("_ready", "first").alias("first"))


def unpivoted(rows: DataFrame, id: str, scalars: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """``(id, path, text)``: every text of a nested row with its path (``name`` or ``name[i]``); null texts are left out."""
    def each(name: str) -> Column:
        of = F.transform(name, lambda x, i: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("path"), x.cast("string").alias("text")))
        return F.coalesce(of, F.array().cast("array<struct<path:string,text:string>>"))

    items = [F.array(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("text"))) for c in scalars] + [each(a) for a in arrays]
    return rows.select(id, F.explode(F.concat(*items)).alias("x")).select(id, "x.path", "x.text").filter(F.col("text").isNotNull())


def path_value(row: str, path: Column, scalars: Sequence[str], arrays: Sequence[str]) -> Column:
    """The value of ``name`` or ``name[i]`` in the columns; null where there is none."""
    name, at = F.regexp_extract(path, "^([^\\[]+)", 1), F.nullif(F.regexp_extract(path, "\\[(\\d+)\\]$", 1), F.lit("")).cast("int")
    out = F.lit(None).cast("string")
    for c in scalars:
        out = F.when((name == c) & at.isNull(), F.col(f"{row}{c}").cast("string")).otherwise(out)
    for a in arrays:
        out = F.when((name == a) & at.isNotNull(), F.get(F.col(f"{row}{a}"), at).cast("string")).otherwise(out)
    return out


def plan_topic(topic: Column, topics: Column, other: str) -> Column:
    """A plan's topic: its own, else the first listed, else ``other``; blank ones don't count."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(topic), filled(F.get(topics, F.lit(0))), F.lit(other))


def holds_placeholder(texts: Column, markers: Sequence[str]) -> Column:
    """Whether any text of an array holds one of the markers, whatever the case."""
    low = F.transform(F.coalesce(texts, F.array().cast("array<string>")), F.lower)
    return F.exists(low, lambda t: reduce(lambda a, b: a | b, (F.coalesce(F.contains(t, F.lit(m)), F.lit(False)) for m in markers)))
