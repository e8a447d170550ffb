"""Filters, predicates and row rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, q: str, columns: list[str], status: tuple[str, str] | None = None, date: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows with q in any column, without case, of a status, and in a date range; rows without a date pass the range."""
    hit = reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(q.lower()) for c in columns))
    out = df.where(hit)
    if status:
        out = out.where(F.col(status[0]) == status[1])
    if date_from:
        out = out.where(F.col(date).isNull() | (F.col(date) >= F.lit(date_from).cast("date")))
    if date_to:
        out = out.where(F.col(date).isNull() | (F.col(date) <= F.lit(date_to).cast("date")))
    return out


def visible(df: DataFrame, as_of: Column, scheduled: str = "scheduled_at") -> DataFrame:
    return df.where(F.col(scheduled).isNull() | (F.col(scheduled) <= as_of))


def json_field(text: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


#: Names that stand for no project.
PLACEHOLDERS = ("unknown project", "untitled project", "n/a", "projet inconnu")


def drop_placeholders(df: DataFrame, name: str, unless: list[str] | None = None) -> DataFrame:
    """Rows with a real name; with ``unless``, placeholders stay if any of those columns says something."""
    placeholder = F.coalesce(F.lower(F.trim(F.col(name))), F.lit("")).isin("", *PLACEHOLDERS)
    empty = reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in unless or []), F.lit(True))
    return df.where(~(placeholder & empty))


def check_constraints(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """Rows that break rules, with the names of those they break; null counts as kept. Repeated keys break ``unique``."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items())), lambda n: n.isNotNull())
    out = df.withColumn("broken", broken)
    if unique:
        repeated = df.groupBy(*unique).agg(F.count("*").alias("times")).where("times > 1")
        keys = [F.col(k).alias(f"{k} twice") for k in unique]
        again = repeated.select(*keys, F.lit(True).alias("twice"))
        out = out.join(again, [F.col(k).eqNullSafe(F.col(f"{k} twice")) for k in unique], "left")
        out = out.withColumn("broken", F.when(F.col("twice"), F.concat("broken", F.array(F.lit("unique")))).otherwise(F.col("broken")))
    return out.where(F.size("broken") > 0).select(*df.columns, "broken")


def pending_evaluations(records: DataFrame, members: DataFrame, kind: str) -> DataFrame:
    """External: pending ones of a home manager. Internal: pending, unscored, internal ones of the manager's team. Newest first."""
    if kind == "external":
        found = records.where("evaluation_status = 'pending' and assignment_type = 'external'")
    else:
        found = records.where("evaluation_status = 'pending' and score is null and assignment_type = 'internal'")
    return found.join(members, "profile_id").orderBy(F.desc("date"), "record_id")


def check_uploads(uploads: DataFrame, participants: DataFrame, projects: DataFrame) -> DataFrame:
    """The first rule that each upload breaks, or ok."""
    # Dealt by project as the uploads are, so that these move once for both joins.
    part = participants.select("project_id", "profile_id").repartition("project_id").distinct().withColumn("takes_part", F.lit(True))
    rows = uploads.join(projects, "project_id", "left").join(part, ["project_id", "profile_id"], "left")
    reason = (
        F.when(F.col("takes_part").isNull(), "not a participant")
        .when(~F.col("is_manager") & (F.col("owner_id") != F.col("profile_id")), "not the owner")
        .when(F.col("score").isNotNull() & ~F.col("is_manager"), "score by a non-manager")
        .when((F.col("assignment_type") == "external") & (F.coalesce(F.trim("contribution"), F.lit("")) == ""), "no contribution text")
        .otherwise("ok")
    )
    return rows.withColumn("outcome", reason)
