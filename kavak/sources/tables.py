"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, a file or a directory of files, as it lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows read from a table, dealt out to all cores if they lie in fewer pieces than there are cores.

    For work that takes longer than moving the few columns it needs; to be
    called on a scan after its projection.  Tables of many pieces stay as they
    lie, so nothing is moved on a cluster.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
