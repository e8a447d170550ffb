"""Workforce tables read from the star schema: the roles that its tables play, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-09-02"

#: The same tables as common table expressions.
SQL = {
    "profiles": "profiles as (select c_custkey as profile_id, c_nationkey as team_id, c_name as full_name, c_acctbal as balance, c_mktsegment as segment from customer)",
    "participations": """participations as (select o_orderkey as participation_id, o_custkey as profile_id,
        concat(o_orderpriority, ' ', cast(year(o_orderdate) as varchar)) as project_name,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority = '3-MEDIUM' then 'medium' else 'low' end as complexity,
        cast(o_orderdate as date) as start_date, case when o_orderstatus = 'P' then null else o_orderkey % 7 end as assigned_by,
        case when o_orderpriority = '5-LOW' then 'external' else 'internal' end as assignment_type,
        case when o_orderstatus = 'F' then 'scored' else 'pending' end as evaluation_status from orders)""",
    "records": """records as (select l_orderkey * 10 + l_linenumber as record_id, o_custkey as profile_id,
        concat(o_orderpriority, ' ', cast(year(l_shipdate) as varchar)) as project_name,
        case when l_returnflag = 'N' then null else l_quantity end as score, l_linestatus = 'F' as verified,
        cast(l_shipdate as date) as completion_date, case when l_tax > 0.04 then null when l_discount > 0.05 then 'high' else 'low' end as complexity
        from lineitem join orders on l_orderkey = o_orderkey)""",
    "certs": """certs as (select l_orderkey * 10 + l_linenumber as cert_id, o_custkey as profile_id, p_name as cert_name, p_brand as issuer,
        cast(o_orderdate as date) as issue_date, case when l_returnflag = 'R' then null else cast(l_shipdate as date) end as expiration_date,
        l_linestatus = 'F' as is_uploaded from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("team_id"), F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def participations(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("participation_id"),
        F.col("o_custkey").alias("profile_id"),
        F.concat(priority, F.lit(" "), F.year("o_orderdate").cast("string")).alias("project_name"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "high").when(priority == "3-MEDIUM", "medium").otherwise("low").alias("complexity"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 7).alias("assigned_by"),
        F.when(priority == "5-LOW", "external").otherwise("internal").alias("assignment_type"),
        F.when(F.col("o_orderstatus") == "F", "scored").otherwise("pending").alias("evaluation_status"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.col("o_custkey").alias("profile_id"),
        F.concat("o_orderpriority", F.lit(" "), F.year("l_shipdate").cast("string")).alias("project_name"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("score"),
        (F.col("l_linestatus") == "F").alias("verified"),
        F.col("l_shipdate").cast("date").alias("completion_date"),
        F.when(F.col("l_tax") > 0.04, None).when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("complexity"),
    )


def certs(spark: SparkSession, sf_dir: str, row: bool = False) -> DataFrame:
    """With ``row``, also the place of each one's line in its table: file and row of the file."""
    line = table(spark, sf_dir, "lineitem")
    if row:
        line = line.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    both = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cert_id"),
        F.col("o_custkey").alias("profile_id"),
        F.col("p_name").alias("cert_name"),
        F.col("p_brand").alias("issuer"),
        F.col("o_orderdate").cast("date").alias("issue_date"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("date")).alias("expiration_date"),
        (F.col("l_linestatus") == "F").alias("is_uploaded"),
        *(["row"] if row else []),
    )


def ctes(*names: str) -> str:
    return ", ".join(SQL[n] for n in names)
