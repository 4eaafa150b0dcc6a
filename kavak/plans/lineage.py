"""Tables written between stages, so that a lost executor costs one stage and no more.

The folder is the one the cluster names in ``spark.checkpoint.dir``; all
executors share it.  Where the setting is absent a local session (one process,
as in tests) gets a folder of its own; a cluster is an error, since no folder
of one machine is seen by all.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ours: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _ours:
        _ours.append(tempfile.mkdtemp(prefix="kavak-"))
        atexit.register(shutil.rmtree, _ours[0], ignore_errors=True)
    return _ours[0]


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends here.

    The copy is removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kavak/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    # the session may be stopped before the process ends, so the file system is asked through the path itself
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(hadoop).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
