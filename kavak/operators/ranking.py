"""Ranking with explicit tie rules: top-k, unique best, first, last and richest of repeated keys, neighbours in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in a total ``order``, numbered from 1.

    Spark keeps only ``k`` rows of a key before the shuffle (WindowGroupLimit),
    so a hot key is cut down where it lies.  Empty tables give no rows.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def unique_best(rows: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The row of the highest score of each key; none where several rows share it.  Null scores don't take part."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    best = rows.filter(F.col(score).isNotNull()).withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1)
    return best.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") == 1).drop("_r", "_n")


def _by_struct(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))
    best = (F.max if last else F.min)(pick)
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._row.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order`` (then the least of the other columns).

    An aggregate with a partial step: a key with very many rows is reduced before the shuffle.
    """
    return _by_struct(rows, keys, order, last=False)


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in ``order`` (then the greatest of the other columns)."""
    return _by_struct(rows, keys, order, last=True)


def richest_wins(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, that with the longest texts together; the first in ``order`` on ties."""
    size = sum(F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts)
    return _by_struct(rows, keys, [-size, *order], last=False)


def with_neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, before: str = "before", after: str = "after") -> DataFrame:
    """The value of the row before and after in each key's order; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w))


def with_predecessors(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str = "predecessors") -> DataFrame:
    """All values before each row in its key's order; empty for the first.  Null values are passed over."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.collect_list(value).over(w))


def agreeing_copies(rows: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first copy of each key with ``copies`` and whether all copies agree on ``columns`` (nulls are equal)."""
    rest = [c for c in rows.columns if c != key]
    same = F.struct(*columns)
    agg = rows.groupBy(key).agg(
        F.count("*").alias("copies"),
        (F.min(same).eqNullSafe(F.max(same))).alias("agree"),
        F.min(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))).alias("_b"),
    )
    return agg.select(key, "copies", "agree", "_b._row.*")
