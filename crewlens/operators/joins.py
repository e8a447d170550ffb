"""Joins of people, teams and records. Lookups are left joins; existence is a semi or anti join; OR joins are unions of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.functions.similarity import seq_ratio, window_sim
from crewlens.functions.text import match_key
from crewlens.operators.windows import first_per_key


def team_profiles(profiles: DataFrame, teams: DataFrame) -> DataFrame:
    """Profiles with their team and its manager."""
    return profiles.join(teams, "team_id")


def lookup(df: DataFrame, names: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """``name`` from a dimension with a default where the key is unknown."""
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the greatest in order, without a sort (max_by)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("latest")).select(key, "latest.*")


def match_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose natural key is in b, null keys equal to null ones; a hash join, as <=> is an equi-condition."""
    right = b.select(*(F.col(k).alias(f"{k} of b") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"{k} of b")) for k in keys]
    return a.join(right, on, how)


def resolve_project_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming record: ``duplicate`` or ``update`` on an equal key, ``fill_date`` where the known one has no date, else ``insert``.

    Keys are (profile_id, name); exact matches agree on the date as well.
    """
    known = existing.select("profile_id", "name", F.col("date").alias("known_date"), F.col("score").alias("known_score"))
    exact = first_per_key(known.where("known_date is not null"), ["profile_id", "name", "known_date"], ["known_score"])
    open_ = known.where("known_date is null").select("profile_id", "name").distinct().withColumn("open", F.lit(True))
    rows = incoming.join(exact, (incoming.profile_id == exact.profile_id) & (incoming.name == exact.name) & (incoming.date == exact.known_date), "left").select(incoming["*"], "known_date", "known_score")
    rows = rows.join(open_, ["profile_id", "name"], "left")
    status = F.when(F.col("known_date").isNotNull(), F.when(F.col("score").eqNullSafe(F.col("known_score")), "duplicate").otherwise("update")).when(F.col("open"), "fill_date").otherwise("insert")
    return rows.withColumn("status", status).drop("known_date", "known_score", "open")


def other_teams(teams: DataFrame, manager: Column) -> DataFrame:
    """Teams of other managers."""
    return teams.where(F.col("manager_id") != manager)


def not_in_team(assignees: DataFrame, members: DataFrame) -> DataFrame:
    return assignees.join(members.select("team_id", "profile_id"), ["team_id", "profile_id"], "left_anti")


def name_tokens_key(name: Column) -> Column:
    """Accent-free words of a name in sorted order: equal for the same words in any order."""
    return F.array_join(F.array_sort(F.filter(F.split(match_key(name), " "), lambda w: w != "")), " ")


def match_names(a: DataFrame, b: DataFrame, left: str = "name", right: str = "full_name") -> DataFrame:
    """Rows of a and b whose names have the same words."""
    return a.withColumn("name key", name_tokens_key(F.col(left))).join(b.withColumn("name key", name_tokens_key(F.col(right))), "name key").drop("name key")


def verify_owner(docs: DataFrame, threshold: float = 0.82, key: Column | None = None) -> DataFrame:
    """Whether each text holds its owner's name: 1 where it stands there in either order, else the best Levenshtein similarity of either order over windows of n-1 to n+1 words.

    docs: text and name, and any more columns. ``key`` is the text's ``match_key``, where docs have it; then they need no text.
    """
    rows = docs.withColumn("key of text", match_key(F.col("text")) if key is None else key).withColumn("key of name", match_key(F.col("name")))
    turned = F.array_join(F.reverse(F.split("key of name", " ")), " ")
    rows = rows.withColumn("stands in text", F.contains("key of text", F.col("key of name")) | F.contains("key of text", turned))
    # Texts that hold the name are compared no more.
    similar = window_sim(F.when(~F.col("stands in text"), F.col("key of text")), F.col("key of name"))
    rows = rows.withColumn("name_score", F.when(F.col("stands in text"), 1.0).otherwise(similar))
    return rows.withColumn("verified", F.col("name_score") >= threshold).drop("key of text", "key of name", "stands in text")


def verify_owner_by_ratio(docs: DataFrame, key: str, least: float = 0.75) -> DataFrame:
    """``key`` and verified: whether a text names its owner. docs: ``key`` (one row for each), text, first, last.

    True where both names stand anywhere in the text, or where one of them is blank;
    else where a window of n-1 to n+1 of its words has a sequence ratio above ``least`` with
    the name in either order. Only windows whose length and letters allow the ratio
    are compared; texts that already pass have none.
    """
    low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    rows = docs.select(key, low("text").alias("text"), low("first").alias("a"), low("last").alias("b"))
    rows = rows.withColumn("sure", (F.col("a") == "") | (F.col("b") == "") | (F.contains("text", F.col("a")) & F.contains("text", F.col("b"))))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rest = rows.where(~F.col("sure")).select(key, F.concat_ws(" ", "a", "b").alias("name"), F.concat_ws(" ", "b", "a").alias("turned"), words.alias("words"))
    n = F.size(F.split("name", r"\s+"))
    sizes = F.array_distinct(F.array(F.greatest(n - 1, F.lit(1)), n, n + 1))
    spots = rest.select("*", F.explode(sizes).alias("size")).where(F.size("words") >= F.col("size"))
    spots = spots.select(key, "name", "turned", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.array_join(F.slice("words", i, F.col("size")), " "))).alias("window")).distinct()
    # ratio = 2 m / (a + b), m at most the shorter text and at most the letters that both have in any order.
    total = F.length("window") + F.length("name")
    spots = spots.where(2 * F.least(F.length("window"), F.length("name")) > least * total)
    times = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x))
    shared = F.aggregate(F.array_distinct(F.split("name", "")), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(times("name", x), times("window", x))))
    near = spots.where(2 * shared > least * total).where((seq_ratio("window", "name") > least) | (seq_ratio("window", "turned") > least)).select(key).distinct().withColumn("near", F.lit(True))
    return rows.join(near, key, "left").select(key, (F.col("sure") | F.coalesce("near", F.lit(False))).alias("verified"))


def resolve_person(queries: DataFrame, people: DataFrame, least: float = 0.84, near: float = 0.02) -> DataFrame:
    """People whose name words come close to a query's words: blocked by the lengths and the letters in a row that the ratio makes them share.

    All within ``near`` of the best stay; one is a match, several are ambiguous.
    """
    asked = queries.select("query_id", F.explode(F.split(match_key(F.col("query")), " ")).alias("word")).where(F.length("word") >= 4).distinct()
    # Questions with the same words are one, ``like``.
    sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    alike = sets.groupBy("words").agg(F.min("query_id").alias("like"))
    terms = alike.select("like", F.explode("words").alias("word"))
    names = people.select("profile_id", F.explode(F.split(match_key(F.col("full_name")), " ")).alias("name")).where(F.length("name") >= 3).distinct()
    # ratio = 2 m / (a + b) with m <= min(a, b), so that b is at most a (2 - r) / r and at least a r / (2 - r).
    a, most = F.length("word"), (2 - least) / least
    lengths = F.sequence(F.ceil(a / most - 1e-9).cast("int"), F.floor(a * most + 1e-9).cast("int"))
    # The m letters are cut by the u = a + b - 2 m others into u + 1 runs at most. As a + b is 7 or more, one run has two letters if r is 0.77 or more.
    run = 2 if least >= 0.77 else 1
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - run + 1), lambda i: F.substring(F.col(c), i, F.lit(run))))).alias("run")
    words = asked.select("word").distinct().select("word", F.explode(lengths).alias("n")).select("word", "n", runs("word"))
    pairs = words.join(names.select("name").distinct().select("name", F.length("name").alias("n"), runs("name")), ["n", "run"]).select("word", "name").distinct()
    # m is at most the letters that both have in any order.
    times = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x))
    shared = F.aggregate(F.array_distinct(F.split("word", "")), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(times("word", x), times("name", x))))
    pairs = pairs.where(2 * shared >= least * (a + F.length("name")) - 1e-9)
    scored = pairs.withColumn("ratio", seq_ratio("word", "name")).where(F.col("ratio") >= least)
    hits = terms.join(scored, "word").join(names, "name").groupBy("like", "profile_id").agg(F.max("ratio").alias("ratio"))
    top = hits.groupBy("like").agg(F.max("ratio").alias("top"))
    kept = hits.join(top, "like").where(F.col("ratio") >= F.col("top") - near)
    n = kept.groupBy("like").agg(F.count("*").alias("n"))
    found = kept.join(n, "like")
    return sets.join(alike, "words").select("query_id", "like").join(found, "like").select("query_id", "profile_id", "ratio", F.when(F.col("n") == 1, "match").otherwise("ambiguous").alias("outcome"))


def backfill_dates(projects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Projects without a date take that of the first listed project of the same client."""
    first = metadata.withColumn("client_key", match_key(F.col("client"))).groupBy("profile_id", "client_key").agg(F.min_by("date", "pos").alias("found"))
    rows = projects.withColumn("client_key", match_key(F.col("client"))).join(first, ["profile_id", "client_key"], "left")
    return rows.withColumn("date", F.coalesce("date", "found")).drop("found", "client_key")


def project_overview(assigned: DataFrame, records: DataFrame) -> DataFrame:
    """Assignments and records merged on (profile_id, name): the assignment's fields win, evidence is or-ed."""
    both = assigned.join(records.withColumnRenamed("complexity", "record_complexity"), ["profile_id", "name"], "full_outer")
    return both.select("profile_id", "name", F.coalesce("complexity", "record_complexity").alias("complexity"), (F.coalesce("has_pv", F.lit(False)) | F.coalesce("record_pv", F.lit(False))).alias("has_pv"), "evidence_date")


def employee_wide(profiles: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """Profiles with aggregates that were grouped before the join."""
    for found in aggregates:
        profiles = profiles.join(found, "profile_id", "left")
    return profiles


def visible_users(users: DataFrame, invited: DataFrame, members: DataFrame) -> DataFrame:
    """Users that a manager invited or has in a team: two equi-joins and a union, where an OR would be a nested loop."""
    return users.join(invited, "user_id").union(users.join(members, "user_id")).distinct()


def assemble(table_rows: DataFrame, document_rows: DataFrame, key: str, fallback: DataFrame | None = None) -> DataFrame:
    """A section's rows from the tables if there are any, else from the document, else from its other spelling."""
    out = table_rows
    for rows in [document_rows, *([fallback] if fallback is not None else [])]:
        out = out.unionByName(rows.join(out.select(key).distinct(), key, "left_anti"))
    return out


def new_values(incoming: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Values that a dimension doesn't have yet, compared without case; the least spelling of each."""
    key = F.lower(F.trim(F.col(name)))
    fresh = incoming.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min(name).alias(name))
    return fresh.join(known.select(key.alias("key")).distinct(), "key", "left_anti").select(name)
