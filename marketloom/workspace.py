"""The shared folder that holds intermediate tables.

Executors can be lost at any time, so an intermediate result that must be stable (a row
numbering, one round of an iteration) is written as Parquet to the folder the cluster names in
``spark.checkpoint.dir`` and read back. Only a local session without that setting gets a folder
of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Root folder for intermediate tables, reachable from every executor."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} is not set; point it at a folder all executors share")
    folder = tempfile.mkdtemp(prefix="marketloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/marketloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the run folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.

    Results are read from them, so call it when the results are stored. Tables of other applications
    in the same shared folder stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
