"""Counts, lists and merged sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.functions.text import match_key
from crewlens.operators.windows import keep_first, top_k_per_key


def count_by(keys: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per key, 0 where there are none."""
    return keys.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def list_distinct(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Distinct values that aren't blank, sorted, joined by a comma."""
    value = F.trim(F.col(column))
    return df.where(value != "").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias(name))


def nested(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Distinct rows of a key as a sorted array of structs."""
    return df.select(key, F.struct(*columns).alias("item")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("item")).alias(name))


def company_index(df: DataFrame, company: str, person: str) -> DataFrame:
    """Per normalised company, the spelling that comes first by person and spelling, and its people in order."""
    rows = df.select(match_key(F.col(company)).alias("company_key"), F.col(company).alias("company"), F.col(person).alias("person")).where("company_key <> ''")
    return rows.groupBy("company_key").agg(F.min(F.struct("person", "company"))["company"].alias("company"), F.array_sort(F.collect_set("person")).alias("people"))


def people_facts(chunks: DataFrame, person: str, kind: str, entity: str, items: int = 50, chars: int = 500) -> DataFrame:
    """Per person and type of chunk, how many distinct entities there are, and the first of them in order, cut for display only."""
    rows = chunks.select(person, kind, F.col(entity).alias("entity")).distinct()
    counts = rows.groupBy(person, kind).agg(F.count("*").alias("n"))
    # Cut before anything is collected.
    first = top_k_per_key(rows, [person, kind], ["entity"], items).groupBy(person, kind)
    shown = F.transform(F.array_sort(F.collect_list("entity")), lambda e: F.substring(e, F.lit(1), F.lit(chars)))
    return counts.join(first.agg(shown.alias("entities")), [person, kind])


def counters(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Rows per key, in all and of each value."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def entity_sets(results: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Distinct entities of each query's results, sorted."""
    return results.groupBy(query).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def chunk_profile(chunks: DataFrame, person: str, kind: str) -> DataFrame:
    return chunks.groupBy(kind).agg(F.count("*").alias("rows"), F.count_distinct(person).alias("people"))


def merge_sources(primary: DataFrame, secondary: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """Rows of both sources with the same columns; of equal keys the first in order, the primary's before the other's."""
    both = primary.withColumn("from", F.lit(0)).unionByName(secondary.withColumn("from", F.lit(1)))
    return keep_first(both, F.struct(*key), ["from", *order]).drop("from")


def set_diff(a: Column, b: Column) -> Column:
    """What two lists share, what b misses, what it has more, and whether they are the same bag."""
    return F.struct(
        F.array_sort(F.array_intersect(a, b)).alias("common"),
        F.array_sort(F.array_except(a, b)).alias("missing"),
        F.array_sort(F.array_except(b, a)).alias("extra"),
        (F.array_sort(a) == F.array_sort(b)).alias("same_bag"),
    )


def result_entities(results: DataFrame, query: str) -> DataFrame:
    """Distinct people, certifications, projects and companies of each query's results, sorted.

    results: name, certification_name, certifications (a list), project_name,
    company_name, client_name, which counts only where there is no company_name, and
    employees (name, companies), the directory's. Blank ones don't count; a query without any stays.
    """
    none = F.expr("cast(array() as array<string>)")
    ones = {"people": F.col("name"), "certifications": F.col("certification_name"), "projects": F.col("project_name"), "companies": F.coalesce("company_name", "client_name")}
    staff = F.flatten(F.transform("employees.companies", lambda c: F.coalesce(c, none)))
    lists = {"people": F.col("employees.name"), "certifications": F.col("certifications"), "companies": staff}
    # Sets, so that repeats of a large result don't gather; rows meet once.
    sets = [F.collect_set(F.nullif(F.trim(c), F.lit(""))).alias(f"one {k}") for k, c in ones.items()]
    sets += [F.collect_set(F.when(F.size(c) > 0, c)).alias(f"list {k}") for k, c in lists.items()]
    found = results.groupBy(query).agg(*sets)
    listed = lambda k: F.filter(F.transform(F.flatten(f"list {k}"), lambda x: F.trim(x)), lambda x: x != "")
    all_ = lambda k: F.array_distinct(F.concat(f"one {k}", listed(k))) if k in lists else F.col(f"one {k}")
    return found.select(query, *(F.array_sort(all_(k)).alias(k) for k in ones))


#: Fields of the entries that facts list, and those of them that name an entry.
PROJECT_FIELDS = ("project_name", "client_name", "project_year", "description")
EXPERIENCE_FIELDS = ("company", "role", "start_date", "end_date", "description")


def _entries(rows: DataFrame, fields: tuple[str, ...], name: str, items: int, chars: int) -> DataFrame:
    """Per person how many distinct entries there are, and the first of them, descriptions cut."""
    plain = rows.select("name", "pos", *(F.trim(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields))
    once = plain.groupBy("name", *fields).agg(F.min("pos").alias("pos"))
    counts = once.groupBy("name").agg(F.count("*").alias(f"n_{name}"))
    short = F.when(F.length("description") > chars, F.concat(F.substring("description", 1, chars), F.lit("…"))).otherwise(F.col("description"))
    first = top_k_per_key(once, ["name"], ["pos", *fields], items).withColumn("description", short)
    lists = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias(name))
    return counts.join(lists, "name")


def employee_facts(directory: DataFrame, projects: DataFrame, experience: DataFrame, named: DataFrame, items: int = 50, chars: int = 500) -> DataFrame:
    """A row for each person: how many projects and jobs, years, companies, certifications, education, and the first ``items`` projects and jobs.

    The directory's numbers, of its last row, go before counted ones.
    directory: name, pos, project_count, experience_count, experience_years, companies;
    projects, experience: name, pos and their fields; named: name, kind (certification or education), entity.
    """
    last = directory.where(F.trim("name") != "").groupBy("name").agg(*(F.max_by(c, "pos").alias(c) for c in ("project_count", "experience_count")), F.max_by("experience_years", F.when(F.col("experience_years").isNotNull(), F.col("pos"))).alias("experience_years"))
    firms = directory.select("name", F.explode("companies").alias("entity")).union(experience.select("name", F.col("company").alias("entity")))
    sets = named.select("name", "kind", "entity").union(firms.select("name", F.lit("company"), "entity")).withColumn("entity", F.trim("entity")).where("entity <> '' and trim(name) <> ''").distinct()
    # Companies by their letters, the others by key.
    pick = lambda kind, order: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(order.alias("order"), "entity")))), lambda x: x["entity"])
    key = match_key(F.col("entity"))
    lists = sets.groupBy("name").agg(pick("company", F.col("entity")).alias("companies"), pick("certification", key).alias("certifications"), pick("education", key).alias("education"))
    out = last
    for other in (_entries(projects.where("trim(name) <> ''"), PROJECT_FIELDS, "projects", items, chars), _entries(experience.where("trim(name) <> ''"), EXPERIENCE_FIELDS, "experience", items, chars), lists):
        out = out.join(other, "name", "full_outer")
    counted = lambda c, n: F.coalesce(c, n, F.lit(0)).cast("long").alias(c)
    empty = F.expr("cast(array() as array<string>)")
    return out.select("name", counted("project_count", "n_projects"), counted("experience_count", "n_experience"), "experience_years", *(F.coalesce(c, empty).alias(c) for c in ("companies", "certifications", "education")), "projects", "experience")
