"""Annual scoring: the best record of each project, pillars, the final score, and the weighted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.operators.windows import first_per_key

#: Fixed values of the scoring rules.
CEILING = {"low": 45, "medium": 65, "high": 85}
BANDS = ((85, "excellent"), (65, "strong"), (40, "developing"))
COMPLEXITY = {"low": 1.0, "medium": 2.0, "high": 3.5}
ROLE = {"contributor": 1.0, "technical_lead": 1.3, "project_lead": 1.5}
WEIGHTS = (0.35, 0.25, 0.20, 0.20)


def two_places(x: Column) -> Column:
    """Half up on the double, as Math.round(x * 100) / 100."""
    return F.floor(x * 100 + 0.5) / 100


def project_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def best_record(records: DataFrame) -> DataFrame:
    """One record for each (profile_id, project key): verified first, then the latest completion, then the least record_id."""
    keyed = records.withColumn("project_key", project_key(F.col("project_name")))
    return first_per_key(keyed, ["profile_id", "project_key"], [F.desc("verified"), F.desc_nulls_last("completion_date"), "record_id", F.desc_nulls_last("score"), F.asc_nulls_last("complexity")])


def scored_projects(participations: DataFrame, records: DataFrame) -> DataFrame:
    """Assigned participations with their best record, and records of no participation as projects of their own.

    External participations without a record are dropped. Date and complexity fall back from record to project.
    """
    best = best_record(records).select("profile_id", "project_key", "score", "verified", "completion_date", F.col("complexity").alias("record_complexity"), "record_id")
    assigned = participations.where(F.col("assigned_by").isNotNull()).withColumn("project_key", project_key(F.col("project_name")))
    matched = assigned.join(best, ["profile_id", "project_key"], "left")
    matched = matched.where(~((F.col("assignment_type") == "external") & F.col("record_id").isNull()))
    matched = matched.select("profile_id", "project_key", "assignment_type", "evaluation_status", "score", F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("completion_date", "start_date").alias("date"), F.coalesce("record_complexity", "complexity", F.lit("medium")).alias("complexity"))
    extra = best.join(assigned.select("profile_id", "project_key").distinct(), ["profile_id", "project_key"], "left_anti")
    extra = extra.select("profile_id", "project_key", F.lit("internal").alias("assignment_type"), F.lit("scored").alias("evaluation_status"), "score", "verified", F.col("completion_date").alias("date"), F.coalesce("record_complexity", F.lit("medium")).alias("complexity"))
    return matched.unionByName(extra)


def item_score(score: Column, complexity: Column, external: Column, pending: Column) -> Column:
    """Score out of 20 against the complexity's ceiling; above 20 it is an old score out of 100; none or pending external ones count 0."""
    ceiling = F.when(F.lower(complexity) == "low", CEILING["low"]).when(F.lower(complexity) == "high", CEILING["high"]).otherwise(CEILING["medium"])
    fresh = two_places(F.greatest(score, F.lit(0.0)) / 20 * ceiling)
    return F.when(score.isNull() | F.isnan(score) | (external & pending), 0.0).when(score > 20, two_places(F.least(score, F.lit(100.0)))).otherwise(fresh)


def project_items(projects: DataFrame) -> DataFrame:
    external, pending = F.col("assignment_type") == "external", F.col("evaluation_status") == "pending"
    return projects.select("profile_id", F.year("date").alias("score_year"), "project_key", item_score(F.col("score"), F.col("complexity"), external, pending).alias("item_score"), (external & pending).alias("pending_external"))


def project_pillar(projects: DataFrame) -> DataFrame:
    items = project_items(projects).groupBy("profile_id", "score_year")
    return items.agg(two_places(F.sum("item_score")).alias("project_score"), F.count("*").alias("n_projects"), F.count_if("pending_external").alias("n_pending"))


def certification_pillar(certs: DataFrame, targets: DataFrame | None = None, default: int = 2) -> DataFrame:
    """Active uploaded certifications by year of issue, or of upload where there is no date of issue, against the target: at most 100."""
    year = F.year(F.coalesce("issue_date", "uploaded_at"))
    counted = certs.where("is_uploaded and status = 'active'").groupBy("profile_id", year.alias("score_year")).agg(F.count("*").alias("n_certs"))
    target = F.lit(default)
    if targets is not None:
        counted = counted.join(targets.select("profile_id", F.col("target_year").alias("score_year"), "certification_target"), ["profile_id", "score_year"], "left")
        target = F.coalesce("certification_target", F.lit(default))
    return counted.select("profile_id", "score_year", "n_certs", two_places(F.least(F.lit(100.0), F.col("n_certs") / F.greatest(target, F.lit(1)) * 100)).alias("certification_score"))


def dated_pillar(rows: DataFrame, key: str, dates: list[str], points: int, period=F.year, name: str = "score") -> DataFrame:
    """points for each row in every distinct period among its dates."""
    periods = F.array_distinct(F.filter(F.array(*(period(F.col(d)) for d in dates)), lambda p: p.isNotNull()))
    return rows.select(key, F.explode(periods).alias("period")).groupBy(key, "period").agg(F.count("*").alias("n"), (F.count("*") * points).alias(name))


def annual_score(pillars: list[DataFrame], names: list[str], counts: list[str] | None = None) -> DataFrame:
    """A row for each (profile_id, score_year) of any pillar: the mean of the four pillars, missing ones 0, to two places.

    ``counts`` names a further column of each pillar, what it counted, to go along.
    """
    both = [[n] if counts is None else [n, c] for n, c in zip(names, counts or names, strict=True)]
    out = pillars[0].select("profile_id", "score_year", *both[0])
    for pillar, columns in zip(pillars[1:], both[1:], strict=True):
        out = out.join(pillar.select("profile_id", "score_year", *columns), ["profile_id", "score_year"], "full_outer")
    filled = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    total = sum(filled[1:], filled[0])
    more = [F.coalesce(c, F.lit(0)).alias(c) for c in counts or []]
    return out.select("profile_id", "score_year", *(f.alias(n) for f, n in zip(filled, names, strict=True)), *more, two_places(total / 4).alias("final_score"))


def score_band(score: Column) -> Column:
    band = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        band = band.when(score >= least, name)
    return band.otherwise("starting")


#: Trainings and formations that fill their pillars.
FULL_TRAININGS, FULL_FORMATIONS = 5, 4


def next_actions(pending_external: Column, certifications: Column, target: Column, trainings: Column, formations: Column, projects: Column) -> Column:
    """What would raise a score, in order of mention."""
    steps = F.array(
        F.when(pending_external > 0, "external projects await review"),
        F.when(certifications < target, "add a certification"),
        F.when(trainings < FULL_TRAININGS, "complete a training"),
        F.when(formations < FULL_FORMATIONS, "deliver a formation"),
        F.when(projects == 0, "no project counts in the year"),
    )
    return F.filter(steps, lambda s: s.isNotNull())


def weighted_score(projects: DataFrame, counts: DataFrame, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """The alternative model: 10 x complexity x role x 1.25 if verified, summed; certifications in % of the target; 10 points else; weighed."""
    by = lambda c, table, default: sum((F.when(F.col(c) == k, v).otherwise(0.0) for k, v in table.items()), F.when(F.col(c).isin(*table), 0.0).otherwise(default))
    points = 10 * by("complexity", COMPLEXITY, 1.0) * by("role", ROLE, 1.0) * F.when(F.col("verified"), 1.25).otherwise(1.0)
    sums = projects.select("profile_id", points.alias("points")).groupBy("profile_id").agg(F.sum("points").alias("raw_projects"))
    both = counts.join(sums, "profile_id", "left").select(
        "profile_id",
        F.bround(F.coalesce("raw_projects", F.lit(0.0)), 2).alias("project_score"),
        F.bround(F.col("n_certs") / F.greatest("target", F.lit(1)) * 100, 2).alias("certification_score"),
        (F.col("n_trainings") * 10).cast("double").alias("training_score"),
        (F.col("n_formations") * 10).cast("double").alias("formation_score"),
    )
    final = sum((F.col(c) * w for c, w in zip(("certification_score", "training_score", "formation_score"), weights[1:], strict=True)), F.col("project_score") * weights[0])
    return both.withColumn("weighted_score", F.bround(final, 2))


def leaderboard_with_unscored(board: DataFrame, members: DataFrame) -> DataFrame:
    """Ranked rows, and members without a score as zeros of rank 0."""
    rest = members.join(board, "profile_id", "left_anti").select("profile_id", "team_id", F.lit(0.0).alias("final_score"), F.lit(0).alias("rank"))
    return board.select("profile_id", "team_id", "final_score", "rank").unionByName(rest)


def team_summary(scores: DataFrame) -> DataFrame:
    """Per team: the mean of scores above 0, how many are, the best profile, and how many are not."""
    scored = F.when(F.col("final_score") > 0, F.col("final_score"))
    return scores.groupBy("team_id").agg(
        F.round(F.avg(scored), 6).alias("mean_score"),
        F.count(scored).alias("n_scored"),
        F.max_by("profile_id", F.struct("final_score", (-F.col("profile_id")).alias("tie"))).alias("top_profile"),
        F.count_if(F.col("final_score") <= 0).alias("n_pending"),
    )
