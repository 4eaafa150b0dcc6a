"""Coverage reports: counts over several groupings at once, rollups and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, sets: Sequence[Sequence[str]], name: str = "n") -> DataFrame:
    """Counts over each of the grouping sets in one pass; ``grouping`` names the set, other columns are null there."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    bits = F.grouping_id()
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.count("*").alias(name), bits.alias("_g"))
    tag = F.lit(None).cast("string")
    for s in sets:
        code = sum(0 if c in s else 1 << (len(columns) - 1 - i) for i, c in enumerate(columns))
        tag = F.when(F.col("_g") == code, F.lit("+".join(s) or "all")).otherwise(tag)
    return out.select(tag.alias("grouping"), *columns, name)


def rolled_up(rows: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Counts by the columns and each shorter beginning of them; ``level`` is the number of columns held."""
    return rows.rollup(*columns).agg(F.count("*").alias(name), F.grouping_id().alias("_g")).select(*columns, name, (F.lit(len(columns)) - F.bit_count("_g")).cast("int").alias("level"))


def pivoted(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """For each key the rows of each value (0 where none) and, as ``total``, of all values."""
    sums = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*sums, F.count("*").alias("total"))
