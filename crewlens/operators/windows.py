"""Ranks, firsts and runs. Windows are per key; ranks go in two passes, whatever the size of a group."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.sources.durable import stored


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = fresh(df, "row of key")
    return df.withColumn(row, F.row_number().over(w)).where(F.col(row) == 1).drop(row)


def top_k_per_key(df: DataFrame, keys: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    """The first k rows of each key and their places; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def keep_first(df: DataFrame, key: Column | list, order: list) -> DataFrame:
    """The first row of every value of a normalised key; rows keep their columns."""
    name = fresh(df, "key of row")
    return first_per_key(df.withColumn(name, key), [name], order).drop(name)


def with_index(df: DataFrame, keys: list[str], order: list, name: str = "idx") -> DataFrame:
    """0-based position in the key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def percentile(rank: Column, n: Column, places: int = 2) -> Column:
    """(n - rank) / n in percent; the only one is at 100."""
    scale = 10**places
    return F.when(n == 1, 100.0).otherwise(F.floor((n - rank) / n * 100 * scale + 0.5) / scale)


def places(df: DataFrame, by: list[str], order: list, name: str = "place", size: str | None = None, partitions: int | None = None) -> DataFrame:
    """Places 1..n of the rows in each group (``by``, null is one), and the group's size, without a task that sees a group whole.

    Two passes: rows are dealt to ranges of (group, order), so that a large group
    has many; each range numbers its rows, and what earlier ranges hold of a group
    is a sum over one number for each range and group. ``order`` is total, or equal rows
    fall as they will. The numbered rows are stored, as ranges are drawn anew on a retry.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, start, of, total = (fresh(df, c) for c in ("row of range", "range of row", "start of range", "range", "rows of group"))
    keys = {c: fresh(df, f"group by {c}") for c in by}
    dealt = df.repartitionByRange(n, *by, *order) if n > 1 else df.coalesce(1)
    rows = dealt.sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id())
    rows = stored(rows.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)), "places")
    group = Window.partitionBy(*by)
    held = rows.groupBy(part, *by).agg(F.count("*").alias(total), F.min(at).alias(start))
    before = F.coalesce(F.sum(total).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col(part).alias(of), *(F.col(c).alias(k) for c, k in keys.items()), (before - F.col(start) + 1).alias(start), F.sum(total).over(group).alias(total))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()), F.col(part) == F.col(of))
    found = rows.join(held, same).withColumn(name, F.col(at) + F.col(start))
    return found.withColumn(size, F.col(total)).select(*df.columns, name, size) if size else found.select(*df.columns, name)


def rank_scores(scores: DataFrame, by: list[str], score: str = "final_score", tie: str = "profile_id", name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Distinct ranks 1..n by falling score in each group, with the percentile, in two passes."""
    size = fresh(scores, "size of group")
    ranked = places(scores, by, [F.desc(score), F.asc(tie)], name, size, partitions)
    return ranked.withColumn(name, F.col(name).cast("int")).withColumn(f"{name}_percentile", percentile(F.col(name), F.col(size))).drop(size)


def rank_all(scores: DataFrame, score: str = "final_score", tie: str = "profile_id", name: str = "rank", partitions: int | None = None) -> DataFrame:
    """The same rank over all rows."""
    return rank_scores(scores, [], score, tie, name, partitions)


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key joined: gaps and islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def experience_years(jobs: DataFrame, as_of: Column, key: str = "profile_id") -> DataFrame:
    """Whole years of work: intervals put in order, running ones end at as_of, open ones have no length; below half a year 0; undated null."""
    end = F.when(F.col("is_current"), as_of).otherwise(F.coalesce("end_date", "start_date"))
    dated = jobs.select(key, "start_date", end.alias("end")).where("start_date is not null")
    dated = dated.select(key, F.least("start_date", "end").alias("a"), F.greatest("start_date", "end").alias("b"))
    years = merge_intervals(dated, key, "a", "b").groupBy(key).agg((F.sum(F.datediff("b", "a")) / 365.25).alias("years"))
    whole = F.when(F.col("years") < 0.5, 0).otherwise(F.floor(F.col("years") + 0.5)).cast("int")
    return jobs.select(key).distinct().join(years, key, "left").select(key, whole.alias("experience_years"))


def merge_fragments(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Dangling names (3 characters or fewer, only digits, or one word without digit or slash) glued to the name before."""
    text = F.trim(name)
    dangling = (F.length(text) <= 3) | text.rlike(r"^[0-9]+$") | text.rlike(r"^[^\s0-9/]+$")
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("head", F.when(dangling & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda s: s["t"]), " ")
    return rows.groupBy(key, "part").agg(F.min(order).alias(order), glued.alias(name)).drop("part")


def flag_current(jobs: DataFrame, house: list[str], key: str = "profile_id", tie: str = "job_id") -> DataFrame:
    """The latest job becomes current, without an end, where its employer is the house firm."""
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(F.coalesce("end_date", "start_date")), tie)) == 1
    current = latest & F.lower(F.trim("company_name")).isin(*house)
    return jobs.withColumn("is_current", current).withColumn("end_date", F.when(F.col("is_current"), None).otherwise(F.col("end_date")))


def recover_dates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A leading day on the next row's name belongs to this row if month and year agree: it moves here."""
    w = Window.partitionBy(key).orderBy(order)
    day = lambda c: F.regexp_extract(c, r"^([0-9]{1,2})\s+\S", 1)
    following = F.lead("name").over(w)
    same = F.lead("month").over(w).eqNullSafe(F.col("month")) & F.col("month").isNotNull()
    moved = F.when(same & (day(following) != ""), day(following))
    taken = F.lag("month").over(w).eqNullSafe(F.col("month")) & F.col("month").isNotNull() & (day(F.col("name")) != "")
    clean = F.when(taken, F.regexp_replace("name", r"^[0-9]{1,2}\s+", "")).otherwise(F.col("name"))
    return rows.select(key, order, clean.alias("name"), "month", moved.cast("int").alias("day"))
