"""Writing tables: overwrite, append, refuse, keep what is there, and documents by unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.operators.ranking import first_wins
from kavak.plans.lineage import written

MODES = {"replace": "overwrite", "append": "append", "refuse": "errorifexists", "keep": "ignore"}


def write(rows: DataFrame, path: str, mode: str = "refuse", by: Sequence[str] = (), kind: str = "parquet") -> None:
    """``rows`` as a Parquet or JSON folder; ``mode``: replace, append, refuse (if it exists) or keep (what exists)."""
    writer = rows.write.mode(MODES[mode]).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def append_record(spark: SparkSession, path: str, subject: str, topic: str, duration: int, score: float | None = None, on: Column | None = None) -> None:
    """One study record appended, dated today unless ``on`` says otherwise."""
    row = spark.createDataFrame([(subject, topic, duration, score)], "subject string, topic string, duration int, score double")
    write(row.select(F.coalesce(on if on is not None else F.lit(None).cast("date"), F.current_date()).cast("string").alias("date"), "*"), path, "append")


def append_new(rows: DataFrame, path: str, key: str, order: Sequence[Column] = ()) -> int:
    """Rows whose key the folder lacks are appended, the first of each in ``order`` (then the least of the other columns); how many.

    Null keys are one key.  What is appended is fixed before it is written, so
    a lost executor can't change it between the count and the write.
    """
    spark = rows.sparkSession
    fresh = first_wins(rows, [key], order)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.parquet(path).select(F.col(key).alias("_held")).distinct()
        fresh = fresh.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
    fresh = written(fresh.select(*rows.columns), "appended")
    n = fresh.count()
    if n:
        write(fresh, path, "append")
    return n


def write_units(rows: DataFrame, path: str, unit: str, ready: Column) -> DataFrame:
    """Ready rows written one folder a unit, replacing all; the manifest ``(unit, written, error)`` comes back."""
    told = rows.withColumn("written", F.coalesce(ready, F.lit(False)))
    write(told.filter("written").drop("written"), path, "replace", [unit], "json")
    return told.select(unit, "written", F.when(~F.col("written"), "not ready").alias("error"))


def patched(rows: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """``rows`` with columns replaced, never verified."""
    return rows.withColumns(changes | {"verified": F.lit(False)})
