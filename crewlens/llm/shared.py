"""Helpers of the operators: durable intermediate tables and columns taken from callers' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.sources.durable import delete_path, drop_stored, own_folder, shared_folder, stored

__all__ = ["WORD", "as_bytes", "clear_shared", "drop_stored", "fresh", "row_key", "shared_folder", "stored", "write_shared"]

#: A word, as all operators of this subpackage count it.
WORD = r"[^\x20\x09-\x0D]+"


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Some bytes as a file in the shared folder; its full path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own_folder(spark)}/files/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(data))
    out.close()
    return system.makeQualified(path).toString()


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables and files that this application left in the shared folder. Call it when no result is read any more."""
    delete_path(spark, own_folder(spark))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """32 bytes that tell rows apart by the values of some columns, nulls included: SHA-256 of the values with their lengths."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))
