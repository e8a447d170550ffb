"""Reading and writing tables, files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.functions.text import match_key
from crewlens.operators.windows import first_per_key


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def load_jdbc(spark: SparkSession, url: str, name: str, column: str, parts: int, where: str | None = None, **options: str) -> DataFrame:
    """A table of a live database, read in ``parts`` ranges of an integer or date column between its least and greatest value.

    The two values are asked for first; ``where``, a condition in the database's SQL, and
    Spark's own filters and column choices are evaluated there. A table without rows
    is read in one part; rows whose column is null belong to the first range.
    """
    source = f"(select * from {name} where {where}) t" if where else name
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    condition = f" where {where}" if where else ""
    low, high = spark.read.jdbc(url, f"(select min({quoted}) as low, max({quoted}) as high from {name}{condition}) b", properties=options).first()
    if low is None:
        return spark.read.jdbc(url, source, properties=options)
    return spark.read.jdbc(url, source, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def scan_profile_metadata(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """metadata.json files below the roots by two keys, the folder's name and the name inside; of equal keys the later path wins.

    Files that aren't JSON are skipped.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(roots, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("doc"))
    rows = rows.where("doc is not null and doc._corrupt is null")
    folder = match_key(F.element_at(F.split("path", "/"), -2))
    keyed = rows.select(F.explode(F.array_distinct(F.array(folder, match_key(F.col("doc.name"))))).alias("profile_key"), "path", F.col("doc").dropFields("_corrupt").alias("doc"))
    return first_per_key(keyed.where("profile_key <> ''"), ["profile_key"], [F.desc("path")])


#: Types of file that are let in.
MIME_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "image/jpeg")


def scan_binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with path, length, content and the type that their ending tells."""
    end = F.lower(F.element_at(F.split("path", r"\."), -1))
    mime = F.when(end == "pdf", MIME_TYPES[0]).when(end == "docx", MIME_TYPES[1]).when(end == "png", MIME_TYPES[2]).when(end.isin("jpg", "jpeg"), MIME_TYPES[3]).otherwise("unknown")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("mime", mime)


def admit_files(files: DataFrame, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files by type and size, with the reason where one is turned away."""
    reason = F.when(~F.col("mime").isin(*MIME_TYPES), "type not allowed").when(F.col("length") > max_bytes, "too large").when(F.col("length") == 0, "empty").otherwise("ok")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def profile_documents(people: DataFrame, sections: dict[str, DataFrame], key: str = "profile_id") -> DataFrame:
    """A JSON document for each profile: its own fields, and each section's rows in order of their ``pos``."""
    out = people
    for name, rows in sections.items():
        fields = ["pos", *(c for c in rows.columns if c not in (key, "pos"))]
        nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(nested, key, "left")
    return out.select(key, F.to_json(F.struct(*(c for c in out.columns if c != key))).alias("doc"))


def upsert_by_key(target: DataFrame, changes: DataFrame, scope: str, key: str, order: str) -> DataFrame:
    """The target with the changed scopes' rows replaced: of equal keys the last change wins."""
    last = first_per_key(changes, [key], [F.desc(order)]).drop(order)
    kept = target.join(changes.select(scope).distinct(), scope, "left_anti").join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*kept.columns)).select(*target.columns)


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def append_query_log(df: DataFrame, path: str) -> None:
    """Appends searches (asked_at, query, entities, results, elapsed_ms) to a log partitioned by day."""
    df.withColumn("day", F.to_date("asked_at")).write.mode("append").partitionBy("day").parquet(path)


def overlay(old: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Documents with the parsed fields laid over them where those aren't null; other fields stay, new documents are added."""
    fields = [c for c in parsed.columns if c != key]
    right = parsed.select(key, *(F.col(c).alias(f"new {c}") for c in fields))
    both = old.join(right, key, "full_outer")
    return both.select(key, *((F.coalesce(F.col(f"new {c}"), F.col(c)) if c in fields else F.col(c)).alias(c) for c in old.columns if c != key))
