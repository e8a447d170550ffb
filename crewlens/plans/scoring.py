"""Queries on annual scoring, ranks and sorted reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.operators import scoring as S
from crewlens.operators import windows as W
from crewlens.functions.dates import cert_status
from crewlens.plans.standins import AS_OF, ctes, lines, participations, profiles, records, table

_PROJECTS = f"""with {ctes("participations", "records", "profiles")},
 best as (select *, lower(trim(project_name)) as project_key from records qualify row_number() over (partition by profile_id, lower(trim(project_name)) order by verified desc, completion_date desc nulls last, record_id, score desc nulls last, complexity nulls last) = 1),
 assigned as (select *, lower(trim(project_name)) as project_key from participations where assigned_by is not null),
 projects as (
  select a.profile_id, a.project_key, a.assignment_type, a.evaluation_status, b.score, coalesce(b.verified, false) as verified, coalesce(b.completion_date, a.start_date) as date, coalesce(b.complexity, a.complexity, 'medium') as complexity
  from assigned a left join best b on a.profile_id = b.profile_id and a.project_key = b.project_key where not (a.assignment_type = 'external' and b.record_id is null)
  union all
  select profile_id, project_key, 'internal', 'scored', score, verified, completion_date, coalesce(complexity, 'medium') from best b
  where not exists (select 1 from assigned a where a.profile_id = b.profile_id and a.project_key = b.project_key)),
 items as (select profile_id, year(date) as score_year, project_key,
  case when score is null or (assignment_type = 'external' and evaluation_status = 'pending') then 0.0
   when score > 20 then floor(least(score, 100.0) * 100 + 0.5) / 100
   else floor(greatest(score, 0.0) / 20 * (case complexity when 'low' then 45 when 'high' then 85 else 65 end) * 100 + 0.5) / 100 end as item_score, assignment_type = 'external' and evaluation_status = 'pending' as pending_external from projects),
 pillar as (select profile_id, score_year, floor(sum(item_score) * 100 + 0.5) / 100 as project_score, count(*) as n_projects, count(case when pending_external then 1 end) as n_pending from items group by 1, 2)"""

# Certifications without a date of issue count by their upload, only active ones; a training counts in each year of its dates, a formation by its end.
_CERTS = f""" lo as (select l_orderkey * 10 + l_linenumber as cert_id, o_custkey as profile_id, cast(o_orderdate as date) as d, cast(l_shipdate as date) as e, l_linestatus = 'F' as is_uploaded, l_returnflag as flag, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey),
 certs as (select *, case when cert_id % 5 > 0 then d end as issue_date, d + 40 as uploaded_at, case when flag = 'R' then null else e + 1000 end as expiration_date from lo),
 cert_pillar as (select profile_id, year(coalesce(issue_date, uploaded_at)) as score_year, count(*) as n_certs, floor(least(100.0, count(*) / 2.0 * 100) * 100 + 0.5) / 100 as certification_score from certs
  where is_uploaded and (expiration_date is null or expiration_date - date '{AS_OF}' > 30) group by 1, 2),
 sessions as (select profile_id, unnest(list_distinct([year(d), year(e)])) as score_year from lo where flag = 'R'),
 training_pillar as (select profile_id, score_year, count(*) as n_trainings, count(*) * 20 as training_score from sessions group by 1, 2),
 formation_pillar as (select profile_id, year(e) as score_year, count(*) as n_formations, count(*) * 25 as formation_score from lo where flag = 'A' and line = 1 group by 1, 2)"""

_ANNUAL = f"""{_PROJECTS}, {_CERTS}, years as (select profile_id, score_year from pillar union select profile_id, score_year from cert_pillar union select profile_id, score_year from training_pillar union select profile_id, score_year from formation_pillar),
 four as (select y.profile_id, y.score_year, coalesce(project_score, 0.0) as project_score, coalesce(certification_score, 0.0) as certification_score, coalesce(training_score, 0)::double as training_score, coalesce(formation_score, 0)::double as formation_score,
  coalesce(n_projects, 0) as n_projects, coalesce(n_certs, 0) as n_certs, coalesce(n_trainings, 0) as n_trainings, coalesce(n_formations, 0) as n_formations, coalesce(n_pending, 0) as n_pending
  from years y left join pillar p using (profile_id, score_year) left join cert_pillar c using (profile_id, score_year) left join training_pillar t using (profile_id, score_year) left join formation_pillar f using (profile_id, score_year)),
 annual as (select profile_id, score_year, project_score, certification_score, training_score, formation_score, floor((project_score + certification_score + training_score + formation_score) / 4 * 100 + 0.5) / 100 as final_score from four)"""

PILLARS = ["project_score", "certification_score", "training_score", "formation_score"]
COUNTS = ["n_projects", "n_certs", "n_trainings", "n_formations"]


def _certs(spark, sf_dir):
    key, d = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("o_orderdate").cast("date")
    ends = F.when(F.col("l_returnflag") != "R", F.date_add(F.col("l_shipdate").cast("date"), 1000))
    return lines(spark, sf_dir).select(F.col("o_custkey").alias("profile_id"), F.when(key % 5 > 0, d).alias("issue_date"), F.date_add(d, 40).alias("uploaded_at"), (F.col("l_linestatus") == "F").alias("is_uploaded"), cert_status(ends, F.lit(AS_OF).cast("date")).alias("status"))


def _dated(spark, sf_dir, where, dates, points, name, count):
    rows = lines(spark, sf_dir).where(where).select(F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").cast("date").alias("start"), F.col("l_shipdate").cast("date").alias("end"))
    return S.dated_pillar(rows, "profile_id", dates, points, name=name).withColumnsRenamed({"period": "score_year", "n": count})


def _pillars(spark, sf_dir):
    trainings = _dated(spark, sf_dir, "l_returnflag = 'R'", ["end", "start"], 20, "training_score", "n_trainings")
    formations = _dated(spark, sf_dir, "l_returnflag = 'A' and l_linenumber = 1", ["end"], 25, "formation_score", "n_formations")
    return [S.project_pillar(_projects(spark, sf_dir)), S.certification_pillar(_certs(spark, sf_dir)), trainings, formations]


def _projects(spark, sf_dir):
    return S.scored_projects(participations(spark, sf_dir), records(spark, sf_dir))


def _annual(spark, sf_dir):
    return S.annual_score(_pillars(spark, sf_dir), PILLARS)


def _ranked(spark, sf_dir, year=None):
    """Ranks of one year, or of all; a year is chosen before it is ranked."""
    annual = _annual(spark, sf_dir)
    scores = (annual if year is None else annual.where(F.col("score_year") == year)).join(profiles(spark, sf_dir).select("profile_id", "team_id"), "profile_id")
    ranked = W.rank_scores(scores, ["score_year"])
    return W.rank_scores(ranked, ["score_year", "team_id"], name="team_rank")


_RANKED = f"""{_ANNUAL}, ranked as (select a.*, f.team_id,
  row_number() over (partition by score_year order by final_score desc, profile_id) as rank,
  row_number() over (partition by score_year, team_id order by final_score desc, profile_id) as team_rank,
  count(*) over (partition by score_year) as n, count(*) over (partition by score_year, team_id) as team_n
  from annual a join profiles f using (profile_id))"""


@query(f"{_RANKED} select profile_id, final_score, cast(rank as integer) as rank, cast(team_rank as integer) as team_rank, team_id from ranked where score_year = 1998 order by rank limit 100")
def leaderboard(spark, sf_dir):
    """The flagship: best scores of 1998 with global and team ranks."""
    board = _ranked(spark, sf_dir, 1998).orderBy("rank").limit(100)
    return board.select("profile_id", "final_score", "rank", "team_rank", "team_id")


@query(f"{_PROJECTS} select profile_id, project_key, assignment_type, evaluation_status, score, verified, date, complexity from projects")
def scored_projects(spark, sf_dir):
    return _projects(spark, sf_dir)


@query(f"{_PROJECTS} select profile_id, project_key, record_id, verified, completion_date from best")
def best_record(spark, sf_dir):
    return S.best_record(records(spark, sf_dir)).select("profile_id", "project_key", "record_id", "verified", "completion_date")


@query(f"{_PROJECTS} select * from pillar")
def project_pillar(spark, sf_dir):
    return S.project_pillar(_projects(spark, sf_dir))


@query(f"with {_CERTS} select * from cert_pillar")
def certification_pillar(spark, sf_dir):
    return S.certification_pillar(_certs(spark, sf_dir))


@query("""with s as (select user_id, cast(ts as date) as d, cast(ts as date) + 9 as due from events where event_type = 'signup'),
 p as (select distinct user_id, d, due, m, i from (select row_number() over () as i, user_id, d, due from s) t, lateral (select unnest([month(d), month(due)]) as m) u)
 select user_id, cast(m as integer) as period, count(*) as n, count(*) * 20 as training_score from p group by 1, 2""")
def training_pillar(spark, sf_dir):
    """A training counts in every month that one of its dates falls in."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("ts").cast("date").alias("end"), F.date_add(F.col("ts").cast("date"), 9).alias("due"))
    return S.dated_pillar(rows, "user_id", ["end", "due"], 20, F.month, "training_score")


@query("select user_id, cast(month(ts) as integer) as period, count(*) as n, count(*) * 25 as formation_score from events where event_type = 'purchase' group by 1, 2")
def formation_pillar(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("end"))
    return S.dated_pillar(rows, "user_id", ["end"], 25, F.month, "formation_score")


@query(f"{_ANNUAL} select * from annual")
def annual_score(spark, sf_dir):
    return _annual(spark, sf_dir)


@query(f"""{_ANNUAL} select profile_id, score_year, case when final_score >= 85 then 'excellent' when final_score >= 65 then 'strong' when final_score >= 40 then 'developing' else 'starting' end as band,
 concat_ws('; ', case when n_pending > 0 then 'external projects await review' end, case when n_certs < 2 then 'add a certification' end, case when n_trainings < 5 then 'complete a training' end, case when n_formations < 4 then 'deliver a formation' end, case when n_projects = 0 then 'no project counts in the year' end) as actions from annual join four using (profile_id, score_year)""")
def score_bands(spark, sf_dir):
    pillars = _pillars(spark, sf_dir)
    scores = S.annual_score(pillars, PILLARS, COUNTS).join(pillars[0].select("profile_id", "score_year", "n_pending"), ["profile_id", "score_year"], "left")
    actions = S.next_actions(F.coalesce("n_pending", F.lit(0)), F.col("n_certs"), F.lit(2), F.col("n_trainings"), F.col("n_formations"), F.col("n_projects"))
    return scores.select("profile_id", "score_year", S.score_band(F.col("final_score")).alias("band"), F.array_join(actions, "; ").alias("actions"))


@query(f"""{_PROJECTS} select profile_id, score_year, string_agg(project_key || '=' || cast(cast(item_score as decimal(12,2)) as varchar), ',' order by project_key, item_score) as items from items group by 1, 2""")
def score_breakdown(spark, sf_dir):
    """Per profile and year, the items behind the pillar, nested and then as text."""
    items = S.project_items(_projects(spark, sf_dir)).groupBy("profile_id", "score_year").agg(F.array_sort(F.collect_list(F.struct("project_key", "item_score"))).alias("items"))
    text = F.transform("items", lambda i: F.concat(i["project_key"], F.lit("="), i["item_score"].cast("decimal(12,2)").cast("string")))
    return items.select("profile_id", "score_year", F.array_join(text, ",").alias("items"))


@query(f"""with {ctes("participations", "profiles")}, raw as (select profile_id, sum(10 * (case complexity when 'low' then 1.0 when 'medium' then 2.0 else 3.5 end) * (case participation_id % 3 when 0 then 1.0 when 1 then 1.3 else 1.5 end) * (case when evaluation_status = 'scored' then 1.25 else 1.0 end)) as raw, count(*) as n from participations group by 1)
 select p.profile_id, cast(round_even(cast(coalesce(raw, 0.0) as decimal(18,6)), 2) as double) as project_score, cast(coalesce(n, 0) * 50 as double) as certification_score, cast(coalesce(n, 0) % 5 * 10 as double) as training_score from profiles p left join raw using (profile_id)""")
def weighted_score(spark, sf_dir):
    """The weighted model; its final sum is tested on hand-made rows."""
    parts = participations(spark, sf_dir)
    role = F.when(F.col("participation_id") % 3 == 0, "contributor").when(F.col("participation_id") % 3 == 1, "technical_lead").otherwise("project_lead")
    projects = parts.select("profile_id", "complexity", role.alias("role"), (F.col("evaluation_status") == "scored").alias("verified"))
    n = parts.groupBy("profile_id").agg(F.count("*").alias("n"))
    counts = profiles(spark, sf_dir).join(n, "profile_id", "left").select("profile_id", F.coalesce("n", F.lit(0)).alias("n_certs"), F.lit(2).alias("target"), (F.coalesce("n", F.lit(0)) % 5).alias("n_trainings"), F.lit(0).alias("n_formations"))
    return S.weighted_score(projects, counts).select("profile_id", "project_score", "certification_score", "training_score")


@query(f"""{_RANKED} select profile_id, score_year, cast(rank as integer) as rank, case when n = 1 then 100.0 else floor((n - rank) / n * 100 * 100 + 0.5) / 100 end as rank_percentile,
 cast(team_rank as integer) as team_rank, case when team_n = 1 then 100.0 else floor((team_n - team_rank) / team_n * 100 * 100 + 0.5) / 100 end as team_rank_percentile from ranked""")
def ranks(spark, sf_dir):
    return _ranked(spark, sf_dir).select("profile_id", "score_year", "rank", "rank_percentile", "team_rank", "team_rank_percentile")


@query("select c_custkey as profile_id, c_acctbal as final_score, cast(row_number() over (order by c_acctbal desc, c_custkey) as integer) as rank, floor((count(*) over () - row_number() over (order by c_acctbal desc, c_custkey)) / count(*) over () * 100 * 100 + 0.5) / 100 as rank_percentile from customer")
def rank_in_two_passes(spark, sf_dir):
    return W.rank_all(profiles(spark, sf_dir).select("profile_id", F.col("balance").alias("final_score")))


@query(f"{_RANKED} select team_id, round(avg(case when final_score > 0 then final_score end), 6) as mean_score, count(case when final_score > 0 then 1 end) as n_scored, arg_max(profile_id, (final_score, -profile_id)) as top_profile, count(case when final_score <= 0 then 1 end) as n_pending from ranked where score_year = 1997 group by 1")
def team_summary(spark, sf_dir):
    return S.team_summary(_ranked(spark, sf_dir, 1997))


@query(f"{_RANKED} select profile_id, team_id, final_score, cast(rank as integer) as rank from ranked where score_year = 2001 union all select profile_id, team_id, 0.0, 0 from profiles where profile_id not in (select profile_id from ranked where score_year = 2001)")
def leaderboard_with_unscored(spark, sf_dir):
    return S.leaderboard_with_unscored(_ranked(spark, sf_dir, 2001), profiles(spark, sf_dir))


@query(f"{_ANNUAL} select profile_id, score_year, final_score, cast(row_number() over (partition by profile_id order by score_year desc) as integer) as place from annual qualify place <= 3")
def score_history(spark, sf_dir):
    return W.top_k_per_key(_annual(spark, sf_dir).select("profile_id", "score_year", "final_score"), ["profile_id"], [F.desc("score_year")], 3)


@query("select event_id, user_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as integer) as place from events qualify place <= 50")
def newest_notifications(spark, sf_dir):
    return W.top_k_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "place")


@query("select event_id, user_id, cast(row_number() over (partition by user_id order by case when event_type = 'error' then 0 else 1 end, ts desc, event_id) as integer) as place from events qualify place <= 4")
def unread_first(spark, sf_dir):
    unread = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return W.top_k_per_key(table(spark, sf_dir, "events"), ["user_id"], [unread, F.desc("ts"), "event_id"], 4).select("event_id", "user_id", "place")


@query("select s_suppkey, case when s_nationkey < 8 then null else s_acctbal end as used from supplier")
def nulls_last_order(spark, sf_dir):
    used = F.when(F.col("s_nationkey") >= 8, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", used.alias("used")).orderBy(F.desc_nulls_last("used"), F.desc("s_suppkey"))


@query(f"""with jobs as (select o_custkey as profile_id, cast(o_orderdate as date) as a0, cast(max(l_shipdate) as date) as b0 from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate),
 j as (select profile_id, least(a0, b0) as a, greatest(a0, b0) as b from jobs),
 n as (select *, case when a <= max(b) over (partition by profile_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from j),
 i as (select *, sum(new) over (partition by profile_id order by a, b rows unbounded preceding) as island from n),
 m as (select profile_id, island, min(a) as a, max(b) as b from i group by 1, 2), y as (select profile_id, sum(b - a) / 365.25 as years from m group by 1)
 select profile_id, cast(case when years < 0.5 then 0 else floor(years + 0.5) end as integer) as experience_years from y""")
def experience_years(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    jobs = lines.groupBy("o_orderkey", F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").cast("date").alias("start_date")).agg(F.max("l_shipdate").cast("date").alias("end_date"))
    return W.experience_years(jobs.withColumn("is_current", F.lit(False)), F.lit(AS_OF).cast("date"))
