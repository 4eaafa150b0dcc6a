"""Texts that read the same and are made of other characters: find them, and give their one plain form.

The rules are in :mod:`kavak.llm.plain`.  A class of characters that are plain
wherever they stand is tested in the query engine, so only values that hold
another character cross to Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kavak.llm.plain import UNSAFE, plain_many


def _in_steps(values: pd.Series) -> list[str | None]:
    texts = values.tolist()
    out: list[str | None] = []
    for k in range(0, len(texts), 500):  # bounds the memory of one step
        out += plain_many([t if isinstance(t, str) else None for t in texts[k : k + 500]])
    return out


def _plain(values: pd.Series) -> pd.Series:
    return pd.Series(_in_steps(values), dtype=object)


def _differs(values: pd.Series) -> pd.Series:
    return pd.Series([t is not None and t != p for t, p in zip(values.tolist(), _in_steps(values))])


def plain_column(text: str | Column) -> Column:
    """The plain form of a string column; null stays null, empty stays empty."""
    c = F.col(text) if isinstance(text, str) else text
    # the UDF sees null where it has nothing to do
    return F.coalesce(pandas_udf(_plain, T.StringType())(F.when(c.rlike(UNSAFE), c)), c)


def _long(records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    return records.select(F.col(id).alias("_id"), F.explode(F.array(*pairs)).alias("p")).select("_id", "p.field", "p.value")


def not_plain(records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """``(id, field)`` of each non-null value that isn't in plain form.

    One row for each row and field concerned, so repeated rows repeat.  Null
    and empty values never appear; an empty table gives no rows.
    """
    suspects = _long(records, id, fields).filter(F.col("value").rlike(UNSAFE))
    return suspects.filter(pandas_udf(_differs, T.BooleanType())("value")).select(F.col("_id").alias(id), "field")


def plain_forms(records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """``(id, field, plain)`` of every non-null value."""
    values = _long(records, id, fields).filter(F.col("value").isNotNull())
    return values.select(F.col("_id").alias(id), "field", plain_column("value").alias("plain"))
