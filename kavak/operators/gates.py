"""Constraint checks that fail closed: each row gets the names of the checks it fails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(check: Column) -> Column:
    """Strictly true; null counts as failed."""
    return F.coalesce(check, F.lit(False))


def errors(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that don't hold, in the order given; empty if all do."""
    return F.filter(F.array(*(F.when(~holds(c), F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())


def gated(rows: DataFrame, checks: Mapping[str, Column], passed: str = "PASS", failed: str = "MANUAL", status: str = "status") -> DataFrame:
    """``rows`` with ``errors`` and ``status``."""
    return rows.withColumn("errors", errors(checks)).withColumn(status, F.when(F.size("errors") == 0, passed).otherwise(failed))


def complete(source: str | Column, fields: Sequence[str]) -> Column:
    """Whether all fields of a struct are there and not empty (0 counts as empty)."""
    s = F.col(source) if isinstance(source, str) else source
    out = F.lit(True)
    for f in fields:
        out = out & ~F.coalesce(s[f].cast("string"), F.lit("")).isin("", "0")
    return out


def unchanged(a: Column, b: Column, fields: Sequence[str]) -> Column:
    """Field-wise equality of two structs; two nulls are equal."""
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, copies)`` of keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def void_if_repeated(rows: DataFrame, key: str) -> DataFrame:
    """All rows, or none at all if any key repeats (one repeated id voids an index)."""
    most = rows.groupBy(key).agg(F.count("*").alias("c")).agg(F.max("c").alias("most"))
    return rows.join(F.broadcast(most.filter("most > 1")), F.lit(True), "left_anti")  # one row at most


def one_to_one(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """``(key, fault)`` wherever two tables don't match one to one with equal columns: only left, only right, differs, repeated."""
    a = left.groupBy(key).agg(F.count("*").alias("na"), F.min(F.struct(*same)).alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("nb"), F.min(F.struct(*same)).alias("b"))
    both = a.join(b, key, "full")
    fault = (
        F.when(F.col("nb").isNull(), "only_left").when(F.col("na").isNull(), "only_right").when((F.col("na") > 1) | (F.col("nb") > 1), "repeated").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    )
    return both.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select(key, "fault")


def table_checks(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``(check, failed, total)`` of each check over a table, in one pass; an empty table has zeros."""
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(~holds(c)).alias(name) for name, c in checks.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failed")) for n in checks)))
    return counts.select(pairs.alias("x"), "total").select("x.check", "x.failed", "total")


def unresolved(children: DataFrame, refs: Column, parents: DataFrame, parent: str, id: str) -> DataFrame:
    """``(id, ref)`` of array references that no parent has; null arrays and null elements refer to nothing."""
    flat = children.select(F.col(id).alias(id), F.explode(refs).alias("ref")).filter(F.col("ref").isNotNull()).distinct()
    return flat.join(parents.select(F.col(parent).alias("ref")).distinct(), "ref", "left_anti").select(id, "ref")


def numbered_copies(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "copy") -> DataFrame:
    """``rows`` with the number of each among those of equal keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
