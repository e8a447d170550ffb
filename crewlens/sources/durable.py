"""Tables that end a lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process (master local), a temporary one set once.

    A cluster's executors don't share the driver's folders, so that it must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crewlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; others may use the same one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there and outlives any executor."""
    path = f"{own_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file in any file system; none there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` returned and that no one reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def clear_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Call it when no result is read any more."""
    delete_path(spark, own_folder(spark))
