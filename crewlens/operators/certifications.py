"""Certification tracking: status counts, matching of uploads, merging of duplicates, alerts that go out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.functions.dates import cert_status
from crewlens.functions.similarity import overlap_of_shorter
from crewlens.functions.text import match_key
from crewlens.operators.windows import first_per_key


def cert_stats(certs: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """Uploaded certifications by status, and those that end after today up to the end of the month."""
    status, end = cert_status(F.col("expiration_date"), as_of), F.col("expiration_date")
    return certs.where("is_uploaded").groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "expiring_soon").alias("expiring_soon"),
        F.count_if(status == "expired").alias("expired"),
        F.count_if((end > as_of) & (end <= F.last_day(as_of))).alias("expiring_this_month"),
    )


def issuer_word(issuer: Column) -> Column:
    return F.coalesce(F.nullif(F.get(F.split(F.trim(issuer), r"\s+"), F.lit(0)), F.lit("")), F.lit("Other"))


def top_issuers(certs: DataFrame, n: int) -> DataFrame:
    counted = certs.groupBy(issuer_word(F.col("issuer")).alias("issuer")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "issuer").limit(n)


def order_certs(certs: DataFrame, as_of: Column) -> DataFrame:
    """Expiring ones first, then active, then expired; the nearest end first, no end last."""
    status = cert_status(F.col("expiration_date"), as_of)
    priority = F.when(status == "expiring_soon", 0).when(status == "active", 1).otherwise(2)
    return certs.withColumn("priority", priority).orderBy("priority", F.asc_nulls_last("expiration_date"), "cert_id")


def attach_latest_cert(trainings: DataFrame, certs: DataFrame) -> DataFrame:
    """For each training, the newest uploaded certification of the same person and name; one without a date counts as newest."""
    newest = certs.where("is_uploaded").groupBy(F.col("profile_id").alias("of"), F.lower("cert_name").alias("named"))
    newest = newest.agg(F.max_by("cert_id", F.struct(F.col("issue_date").isNull().alias("none"), "issue_date", "cert_id")).alias("cert_id"))
    return trainings.join(newest, (F.col("profile_id") == F.col("of")) & (F.lower("title") == F.col("named")), "left").drop("of", "named")


def match_certs(uploads: DataFrame, existing: DataFrame, least: float = 0.6) -> DataFrame:
    """The best existing certification of the same person for each upload: equal name, else lenient and unverified, else lenient.

    Lenient: one name holds the other, or they share ``least`` of the shorter's words. The join is blocked by person.
    """
    keyed = lambda df, name, p: df.withColumn(f"{p} key", match_key(F.col(name))).withColumn(f"{p} words", F.filter(F.split(f"{p} key", " "), lambda w: w != ""))
    # Keys and words are made once for each row, before the join.
    pairs = keyed(uploads, "name", "a").join(keyed(existing, "other_name", "b"), "profile_id")
    a, b = F.col("a key"), F.col("b key")
    lenient = F.contains(a, b) | F.contains(b, a) | (overlap_of_shorter(F.col("a words"), F.col("b words")) >= least)
    pairs = pairs.withColumn("equal", a == b).where(F.col("equal") | ((a != "") & (b != "") & lenient))
    priority = F.when(F.col("equal"), 0).when(~F.col("verified"), 1).otherwise(2)
    return first_per_key(pairs.withColumn("priority", priority).select("upload_id", "cert_id", "priority"), ["upload_id"], ["priority", "cert_id"])


def coalesce_dups(df: DataFrame, key: list[str], order: str, fields: list[str], flags: list[str]) -> DataFrame:
    """Rows of a key become one: of each field the first value in order, of each flag whether any is set."""
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return df.groupBy(*key).agg(*firsts, *(F.bool_or(f).alias(f) for f in flags))


def verified_certs(merged: DataFrame, as_of: Column) -> DataFrame:
    """Only uploaded ones leave the merge; expired ones are marked."""
    return merged.where("is_uploaded").withColumn("is_expired", F.coalesce(F.col("expiration_date") < as_of, F.lit(False)))


def progress(df: DataFrame) -> DataFrame:
    """Verified share and share of the target in %, the latter at most 100."""
    verified = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("n_verified") / F.col("n") * 100, 2))
    target = F.least(F.lit(100.0), F.round(F.col("n_verified") / F.greatest("target", F.lit(1)) * 100, 2))
    return df.withColumn("verified_pct", verified).withColumn("target_pct", target).withColumn("target_met", F.col("n_verified") >= F.col("target"))


def new_unverified(parsed: DataFrame, verified: DataFrame) -> DataFrame:
    """Parsed certifications whose name the person has not verified yet."""
    key = lambda df: df.withColumn("cert_key", match_key(F.col("cert_name")))
    return key(parsed).join(key(verified).select("profile_id", "cert_key").distinct(), ["profile_id", "cert_key"], "left_anti").drop("cert_key")


def expiry_alerts(certs: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts due today that have not gone out: a 30-day one (priority 3 up to 7 days ahead, else 2), or an expired one (3) up to 7 days back."""
    days = F.datediff("expiration_date", as_of)
    kind = F.when((days > 0) & (days <= 30), "expiring_30_days").when((days > -7) & (days <= 0), "expired")
    due = certs.withColumn("days", days).withColumn("alert_type", kind).where("alert_type is not null")
    due = due.withColumn("priority", F.when((F.col("alert_type") == "expiring_30_days") & (F.col("days") > 7), 2).otherwise(3))
    return due.join(alerts.select("cert_id", "alert_type").distinct(), ["cert_id", "alert_type"], "left_anti").select("cert_id", "profile_id", "alert_type", "days", "priority")


def merge_cert_arrays(docs: DataFrame, certs: DataFrame) -> DataFrame:
    """Verified certifications laid into the documents' arrays: equal names overlaid where not null, is_uploaded or-ed, others appended.

    docs: doc_id, certs array<struct<name, issuer, is_uploaded>>; certs: doc_id, name, issuer, is_uploaded.
    """
    old = docs.select("doc_id", F.posexplode("certs").alias("pos", "c")).select("doc_id", "pos", "c.*").withColumn("key", F.lower(F.trim("name")))
    new = certs.select("doc_id", *(F.col(c).alias(f"new_{c}") for c in ("name", "issuer", "is_uploaded")), F.lower(F.trim("name")).alias("key"))
    new = new.groupBy("doc_id", "key").agg(F.max_by("new_name", F.struct("new_issuer", "new_name")).alias("new_name"), F.max("new_issuer").alias("new_issuer"), F.bool_or("new_is_uploaded").alias("new_is_uploaded"))
    both = old.join(new, ["doc_id", "key"], "full_outer")
    item = F.struct(F.coalesce("pos", F.lit(2**31 - 1)).alias("pos"), F.coalesce("name", "new_name").alias("name"), F.coalesce("new_issuer", "issuer").alias("issuer"), (F.coalesce("is_uploaded", F.lit(False)) | F.coalesce("new_is_uploaded", F.lit(False))).alias("is_uploaded"))
    merged = both.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("certs"))
    rest = docs.join(merged.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.expr("cast(array() as array<struct<pos:int,name:string,issuer:string,is_uploaded:boolean>>)").alias("certs"))
    return merged.union(rest).select("doc_id", F.transform("certs", lambda c: c.dropFields("pos")).alias("certs"))
