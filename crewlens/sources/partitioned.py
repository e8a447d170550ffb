"""Tables changed in place: only touched partitions are rewritten, staged first and then swapped in.

A change is read, merged and stored in the shared folder; then Spark's dynamic
overwrite swaps the partitions that it touches. Merging is idempotent by key: a
run that dies between the two steps, or after them, can be repeated. Batch ids of
finished changes are kept beside the table, so that a replay does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crewlens.operators.windows import first_per_key
from crewlens.sources.durable import delete_path, drop_stored, stored

BUCKET = "bucket"


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table of a folder, empty where the folder isn't there yet. Partition columns are part of the schema."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def bucket_of(scope: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


def swap_partitions(staged: DataFrame, path: str, by: str, touched: list) -> None:
    """Partitions of the table become those of ``staged``; touched ones that have no row left are deleted."""
    left = {r[0] for r in staged.select(by).distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in touched:
        if value not in left:
            delete_path(staged.sparkSession, f"{path}/{by}={value}")


def is_done(spark: SparkSession, path: str, batch: int) -> bool:
    return read_table(spark, f"{path}-batches", "batch long").where(F.col("batch") == batch).count() > 0


def mark_done(spark: SparkSession, path: str, batch: int) -> None:
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{path}-batches")


def replace_scopes(spark: SparkSession, path: str, scopes: DataFrame, rows: DataFrame, scope: str, key: str, order: str, buckets: int = 64, batch: int | None = None) -> bool:
    """All rows of the given scopes replaced by ``rows``, of equal keys the last by ``order``; False where the batch was done before.

    The table lies in ``buckets`` partitions by the scope's hash; a key belongs to one
    scope. At most ``buckets`` numbers pass the driver. scopes: ``scope``; rows: the table's columns and ``order``.
    """
    if batch is not None and is_done(spark, path, batch):
        return False
    names = [c for c in rows.columns if c != order]
    fresh = first_per_key(rows.join(scopes.select(scope).distinct(), scope, "left_semi"), [key], [F.desc(order)]).select(*names).withColumn(BUCKET, bucket_of(F.col(scope), buckets))
    touched = sorted(r[0] for r in scopes.select(bucket_of(F.col(scope), buckets)).distinct().collect())
    old = read_table(spark, path, fresh.schema).where(F.col(BUCKET).isin(*touched) if touched else F.lit(False))
    staged = stored(old.join(scopes.select(scope).distinct(), scope, "left_anti").select(*fresh.columns).unionByName(fresh), "staged")
    swap_partitions(staged, path, BUCKET, touched)
    drop_stored(staged)
    if batch is not None:
        mark_done(spark, path, batch)
    return True


def upsert_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: str | None = None, buckets: int = 64, batch: int | None = None) -> bool:
    """Rows laid over those of equal keys (the last by ``order``); others stay. Buckets are those of the first key."""
    if batch is not None and is_done(spark, path, batch):
        return False
    last = first_per_key(rows, keys, [F.desc(order)]).drop(order) if order else rows
    last = stored(last.withColumn(BUCKET, bucket_of(F.col(keys[0]), buckets)), "changes")
    touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())
    old = read_table(spark, path, last.schema).where(F.col(BUCKET).isin(*touched) if touched else F.lit(False))
    staged = stored(old.join(last.select(*keys), keys, "left_anti").select(*last.columns).unionByName(last), "staged")
    swap_partitions(staged, path, BUCKET, touched)
    drop_stored(staged)
    drop_stored(last)
    if batch is not None:
        mark_done(spark, path, batch)
    return True
