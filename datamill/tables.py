"""Reading the input tables and cutting lineage.

Every reader goes through Spark's own data sources, so a table may be in any
store that Spark can open.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK_DIR: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves a session on one machine; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _FALLBACK_DIR:
        _FALLBACK_DIR.append(tempfile.mkdtemp(prefix="datamill-"))
    return _FALLBACK_DIR[0]


def written_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/datamill/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read of a file, not the work that
    led to it, and Spark knows the size of what it reads when it picks a join.
    The files stay until ``remove_written``, since results read them.
    """
    spark = df.sparkSession
    path = f"{written_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whole texts in a record batch that a Python worker gets; Spark's own number is ten times that.
ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get whole texts by ``ROWS_PER_BATCH`` at most; a smaller number stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Remove a folder of whatever store Spark can write to. Was it there?"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(spark: SparkSession) -> bool:
    """Remove the intermediate tables of this application, when its results are used or written elsewhere."""
    return remove_folder(spark, written_dir(spark))
