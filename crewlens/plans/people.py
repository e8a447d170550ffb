"""Queries on people, teams and records: filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.functions.text import display_name, match_key
from crewlens.operators import aggregates as A
from crewlens.operators import filters as B
from crewlens.operators import joins as J
from crewlens.operators import windows as W
from crewlens.plans.standins import AS_OF, ctes, participations, profiles, records, table

_D = f"date '{AS_OF}'"


def _teams(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), F.col("n_regionkey").alias("manager_id"))


# Projections, filters, predicates


@query("select c_custkey, case when c_nationkey < 5 then coalesce(nullif(trim(c_mktsegment), ''), '') || ' ' || c_name when c_nationkey < 10 then c_name || '@example.com' else 'Colleague' end as name from customer")
def display_names(spark, sf_dir):
    team = F.col("c_nationkey")
    first, last = F.when(team < 5, F.col("c_mktsegment")), F.when(team < 5, F.col("c_name"))
    email = F.when((team >= 5) & (team < 10), F.concat("c_name", F.lit("@example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", display_name(first, last, email, "Colleague").alias("name"))


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 0")
def role_status_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("select o_orderkey from (select *, case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end as d from orders) t where (contains(lower(o_orderpriority), 'high') or contains(lower(o_orderstatus), 'high')) and (d is null or d >= date '1996-01-01') and (d is null or d <= date '1998-12-31')")
def multi_field_search(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")))
    return B.search(rows, "HIGH", ["o_orderpriority", "o_orderstatus"], date="d", date_from="1996-01-01", date_to="1998-12-31").select("o_orderkey")


@query("select event_id from events where event_type = 'error' or ts <= timestamp '2024-01-15 00:00:00'")
def visible_notifications(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("scheduled_at", F.when(F.col("event_type") != "error", F.col("ts")))
    return B.visible(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '0') as k, coalesce(json_extract_string(props, '$.kind'), 'internal') as kind from events")
def json_path_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", B.json_field(F.col("props"), "$.k", "0").alias("k"), B.json_field(F.col("props"), "$.kind", "internal").alias("kind")).where("kind = 'internal'")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag <> 'N' or l_discount > 0.05")
def placeholder_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("name", F.when(F.col("l_returnflag") == "N", "Unknown Project").otherwise("real")).withColumn("client", F.when(F.col("l_discount") > 0.05, "someone").otherwise(""))
    return B.drop_placeholders(rows, "name", ["client"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with k as (select *, count(*) over (partition by l_orderkey, l_linenumber) as times from lineitem)
 select l_orderkey, l_linenumber, l_partkey, concat_ws(',', case when l_quantity > 45 then 'quantity' end, case when l_discount > 0.09 then 'discount' end, case when times > 1 then 'unique' end) as broken from k where l_quantity > 45 or l_discount > 0.09 or times > 1""")
def constraint_check(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.09}
    found = B.check_constraints(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("broken", ",").alias("broken"))


_EVALUATIONS = f"""with {ctes("participations", "profiles")}, r as (select participation_id as record_id, profile_id, start_date as date, evaluation_status, assignment_type, case when participation_id % 2 = 0 then 1.0 end as score from participations)"""


def _evaluations(spark, sf_dir):
    return participations(spark, sf_dir).select(F.col("participation_id").alias("record_id"), "profile_id", F.col("start_date").alias("date"), "evaluation_status", "assignment_type", F.when(F.col("participation_id") % 2 == 0, 1.0).alias("score"))


@query(f"{_EVALUATIONS} select record_id, profile_id, team_id, 'external' as kind from r join profiles using (profile_id) where evaluation_status = 'pending' and assignment_type = 'external' union all select record_id, profile_id, team_id, 'internal' from r join profiles using (profile_id) where evaluation_status = 'pending' and assignment_type = 'internal' and score is null")
def pending_evaluations(spark, sf_dir):
    rows, members = _evaluations(spark, sf_dir), profiles(spark, sf_dir).select("profile_id", "team_id")
    out = [B.pending_evaluations(rows, members, k).select("record_id", "profile_id", "team_id", F.lit(k).alias("kind")) for k in ("external", "internal")]
    return out[0].union(out[1])


@query("""select l_orderkey as project_id, l_partkey as upload_id, case when o_custkey is null then 'not a participant' when l_linestatus <> 'F' and o_orderkey % 1500 <> o_custkey then 'not the owner' when l_returnflag = 'A' and l_linestatus <> 'F' then 'score by a non-manager' when o_orderpriority = '5-LOW' and l_discount < 0.03 then 'no contribution text' else 'ok' end as outcome
 from lineitem left join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P'""")
def upload_rules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    uploads = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("project_id"), F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("upload_id"), (F.col("l_linestatus") == "F").alias("is_manager"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("score"), F.when(F.col("l_discount") >= 0.03, "did things").alias("contribution"))
    part = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("profile_id"))
    owners = orders.select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 1500).alias("owner_id"), F.when(F.col("o_orderpriority") == "5-LOW", "external").otherwise("internal").alias("assignment_type"))
    return B.check_uploads(uploads, part, owners).select("project_id", "upload_id", "outcome")


# Joins


@query("select c_custkey as profile_id, c_nationkey as team_id, n_name as team_name, n_regionkey as manager_id from customer join nation on c_nationkey = n_nationkey")
def membership_join(spark, sf_dir):
    return J.team_profiles(profiles(spark, sf_dir).select("profile_id", "team_id"), _teams(spark, sf_dir))


@query("select s_suppkey, s_nationkey as team_id, coalesce(n_name, 'Team') as team_name from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 2")
def lookup_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team_id"))
    return J.lookup(rows, _teams(spark, sf_dir).where("manager_id <> 2"), "team_id", "team_name", "Team")


@query("select o_custkey as profile_id, o_orderkey as snapshot_id, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderstatus = 'F' desc, o_orderdate desc, o_orderkey desc) = 1")
def lateral_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("snapshot_id"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("is_current"), "o_orderdate")
    return J.latest_per_key(rows, "profile_id", ["is_current", "o_orderdate", "snapshot_id"], ["snapshot_id", "o_totalprice"])


_NATURAL = "select *, case when l_discount > 0.05 then null else l_quantity end as q from lineitem"


@query(f"with k as ({_NATURAL}) select count(*) as n from k a where exists (select 1 from k b where b.l_returnflag = 'R' and a.l_partkey = b.l_partkey and a.q is not distinct from b.q) and a.l_returnflag <> 'R'")
def null_safe_key_match(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_discount") <= 0.05, F.col("l_quantity")))
    return J.match_null_safe(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), ["l_partkey", "q"]).agg(F.count("*").alias("n"))


@query(f"""with {ctes("records", "participations")}, known as (select profile_id, project_name as name, case when verified then completion_date end as date, score from records),
 inc as (select participation_id as record_id, profile_id, project_name as name, start_date as date from participations), ex as (select profile_id, name, date, bool_or(score is null) as has_null from known where date is not null group by 1, 2, 3),
 op as (select distinct profile_id, name from known where date is null)
 select i.record_id, i.profile_id, i.name, case when e.date is not null then case when e.has_null then 'duplicate' else 'update' end when o.name is not null then 'fill_date' else 'insert' end as status
 from inc i left join ex e on i.profile_id = e.profile_id and i.name = e.name and i.date = e.date left join op o on i.profile_id = o.profile_id and i.name = o.name""")
def three_way_upsert_match(spark, sf_dir):
    known = records(spark, sf_dir).select("profile_id", F.col("project_name").alias("name"), F.when(F.col("verified"), F.col("completion_date")).alias("date"), "score")
    incoming = participations(spark, sf_dir).select(F.col("participation_id").alias("record_id"), "profile_id", F.col("project_name").alias("name"), F.col("start_date").alias("date"), F.lit(None).cast("double").alias("score"))
    return J.resolve_project_records(known, incoming).select("record_id", "profile_id", "name", "status")


@query("select n_nationkey as team_id from nation where n_regionkey <> 1")
def not_equal_join(spark, sf_dir):
    return J.other_teams(_teams(spark, sf_dir), F.lit(1)).select("team_id")


@query("select o_orderkey, o_custkey as profile_id, s_nationkey as team_id from orders join supplier on s_suppkey = o_orderkey % 100 where not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = s_nationkey)")
def not_in_team(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 100)
    return J.not_in_team(asked.select("o_orderkey", F.col("o_custkey").alias("profile_id"), F.col("s_nationkey").alias("team_id")), profiles(spark, sf_dir)).select("o_orderkey", "profile_id", "team_id")


@query("select s_suppkey, c_custkey as profile_id from supplier join customer on right(s_name, 9) = right(c_name, 9)")
def name_token_join(spark, sf_dir):
    trainers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.substring("s_name", -9, 9), F.lit(" Trainér")).alias("name"))
    people = profiles(spark, sf_dir).select("profile_id", F.concat(F.lit("trainer, "), F.substring("full_name", -9, 9)).alias("full_name"))
    return J.match_names(trainers, people).select("s_suppkey", "profile_id")


_KEY = "trim(regexp_replace(lower(replace(strip_accents({0}), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"
_SIM = "greatest(1 - levenshtein({0}, name) / greatest(length({0}), length(name)), 1 - levenshtein({0}, turned) / greatest(length({0}), length(turned)))"
_WINDOWS = "list_max(list_transform(generate_series(1, len(w) - {0} + 1), lambda i: " + _SIM.format("array_to_string(w[i:i + {0} - 1], ' ')") + "))"


@query(f"""with d as (select doc_id, {_KEY.format("text")} as t, string_split({_KEY.format("text")}, ' ') as w from documents),
 a as (select doc_id, t, w, coalesce(w[2], 'ann') as first, coalesce(w[3], 'lee') as last from d),
 n as (select *, case doc_id % 4 when 0 then first || ' ' || last when 1 then last || ' ' || first when 2 then last || 'x ' || first else 'durant christophe' end as name, case doc_id % 4 when 0 then last || ' ' || first when 1 then first || ' ' || last when 2 then first || ' ' || last || 'x' else 'christophe durant' end as turned from a),
 s as (select doc_id, case when contains(t, name) or contains(t, turned) then 1.0 else greatest(coalesce({_WINDOWS.format(1)}, 0.0), coalesce({_WINDOWS.format(2)}, 0.0), coalesce({_WINDOWS.format(3)}, 0.0)) end as score from n)
 select doc_id, round(score, 9) as name_score, score >= 0.82 as verified from s""")
def owner_in_document(spark, sf_dir):
    """Names from the texts themselves, in order, turned, misspelt, and one that no text has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", match_key(F.col("text")).alias("key"))
    docs = docs.select("doc_id", "key", F.split("key", " ", 4).alias("words"))
    w = F.col("words")
    first, last, n = F.coalesce(F.get(w, F.lit(1)), F.lit("ann")), F.coalesce(F.get(w, F.lit(2)), F.lit("lee")), F.col("doc_id") % 4
    name = F.when(n == 0, F.concat_ws(" ", first, last)).when(n == 1, F.concat_ws(" ", last, first)).when(n == 2, F.concat(last, F.lit("x "), first)).otherwise("durant christophe")
    return J.verify_owner(docs.select("doc_id", "key", name.alias("name")), key=F.col("key")).select("doc_id", F.round("name_score", 9).alias("name_score"), "verified")


@query()
def owner_by_ratio(spark, sf_dir):
    """Texts that hold a part's two names, with letters dropped, in either order, apart or not at all. A sequence ratio has no SQL form; held against a loop in the tests."""
    n, words = F.col("p_partkey") % 5, F.split("p_name", " ")
    first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    short = F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(" "), last)
    text = F.when(n == 0, F.concat_ws(" ", last, "p_type", first)).when(n == 1, F.concat_ws(" ", "p_type", short)).when(n == 2, F.concat_ws(" ", last, short)).when(n == 3, F.col("p_type")).otherwise(F.concat_ws(" ", "p_brand", F.reverse(first), last))
    return J.verify_owner_by_ratio(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), first.alias("first"), last.alias("last")), "p_partkey")


@query()
def fuzzy_query_person(spark, sf_dir):
    """Names of parts, misspelt by one letter, against the names of parts."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.substring(F.get(F.split("p_name", " "), F.lit(1)), 1, 20), F.lit("x")).alias("query"))
    people = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("profile_id")).select("profile_id", F.col("p_name").alias("full_name"))
    return J.resolve_person(asked, people)


@query("""with p as (select o_orderkey, o_custkey as profile_id, o_orderpriority as client, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as date from orders), f as (select profile_id, client, arg_min(date, o_orderkey) as d from p where date is not null group by 1, 2)
 select o_orderkey, coalesce(date, d) as date from p left join f using (profile_id, client)""")
def client_date_backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("client"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("date"))
    listed = rows.where("date is not null").select("profile_id", F.col("client"), "date", F.col("o_orderkey").alias("pos"))
    return J.backfill_dates(rows, listed).select("o_orderkey", "date")


@query(f"""with {ctes("participations", "records")}, a as (select profile_id, project_name as name, min(complexity) as complexity, bool_or(evaluation_status = 'scored') as has_pv from participations group by 1, 2),
 r as (select profile_id, project_name as name, min(complexity) as c, bool_or(verified) as pv, max(completion_date) as evidence_date from records group by 1, 2)
 select coalesce(a.profile_id, r.profile_id) as profile_id, coalesce(a.name, r.name) as name, coalesce(complexity, c) as complexity, coalesce(has_pv, false) or coalesce(pv, false) as has_pv, evidence_date from a full outer join r on a.profile_id = r.profile_id and a.name = r.name""")
def project_overview_merge(spark, sf_dir):
    assigned = participations(spark, sf_dir).groupBy("profile_id", F.col("project_name").alias("name")).agg(F.min("complexity").alias("complexity"), F.bool_or(F.col("evaluation_status") == "scored").alias("has_pv"))
    found = records(spark, sf_dir).groupBy("profile_id", F.col("project_name").alias("name")).agg(F.min("complexity").alias("complexity"), F.bool_or("verified").alias("record_pv"), F.max("completion_date").alias("evidence_date"))
    return J.project_overview(assigned, found)


@query(f"with {ctes('profiles', 'participations', 'records')}, p as (select profile_id, count(*) as n_projects from participations group by 1), r as (select profile_id, count(*) as n_records, max(completion_date) as last_record from records group by 1) select profile_id, team_id, n_projects, n_records, last_record from profiles left join p using (profile_id) left join r using (profile_id)")
def entity_dimension_join(spark, sf_dir):
    n_projects = participations(spark, sf_dir).groupBy("profile_id").agg(F.count("*").alias("n_projects"))
    n_records = records(spark, sf_dir).groupBy("profile_id").agg(F.count("*").alias("n_records"), F.max("completion_date").alias("last_record"))
    return J.employee_wide(profiles(spark, sf_dir).select("profile_id", "team_id"), n_projects, n_records)


@query("select distinct c_custkey as user_id, n_regionkey as manager_id from customer join nation on c_nationkey = n_nationkey or c_custkey % 25 = n_nationkey")
def or_scope_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    teams = _teams(spark, sf_dir)
    people = table(spark, sf_dir, "customer")
    invited = people.join(teams, F.col("c_custkey") % 25 == F.col("team_id")).select(F.col("c_custkey").alias("user_id"), "manager_id")
    members = people.join(teams, F.col("c_nationkey") == F.col("team_id")).select(F.col("c_custkey").alias("user_id"), "manager_id")
    return J.visible_users(users, invited, members)


@query(f"with {ctes('participations', 'records')}, o as (select profile_id, project_name as entry, 'table' as origin from participations where evaluation_status = 'scored' and complexity = 'high'), d as (select profile_id, project_name as entry, 'document' as origin from records where verified) select * from o union all select * from d where profile_id not in (select profile_id from o)")
def profile_assembly(spark, sf_dir):
    own = participations(spark, sf_dir).where("evaluation_status = 'scored' and complexity = 'high'").select("profile_id", F.col("project_name").alias("entry"), F.lit("table").alias("origin"))
    rest = records(spark, sf_dir).where("verified").select("profile_id", F.col("project_name").alias("entry"), F.lit("document").alias("origin"))
    return J.assemble(own, rest, "profile_id")


@query("select min(p_name || ' ' || p_type) as skill from part where lower(p_name || ' ' || p_type) not in (select lower(p_name || ' ' || p_type) from part where p_size < 10) group by lower(p_name || ' ' || p_type)")
def new_dimension_values(spark, sf_dir):
    skills = table(spark, sf_dir, "part").select("p_size", F.concat_ws(" ", "p_name", "p_type").alias("skill"))
    return J.new_values(skills, skills.where("p_size < 10").select(F.upper("skill").alias("skill")), "skill")


# Aggregates


@query(f"with {ctes('profiles', 'participations')} select profile_id, count(participation_id) as n from profiles left join participations using (profile_id) group by 1")
def count_by_key(spark, sf_dir):
    return A.count_by(profiles(spark, sf_dir).select("profile_id"), participations(spark, sf_dir), "profile_id")


@query(f"with {ctes('participations')} select profile_id, string_agg(distinct project_name, ', ' order by project_name) as companies from participations group by 1")
def distinct_ordered_list(spark, sf_dir):
    return A.list_distinct(participations(spark, sf_dir), "profile_id", "project_name", "companies")


@query(f"with {ctes('participations')} select project_name, list_sort(list(distinct profile_id))::varchar as people from participations group by 1")
def nested_collect(spark, sf_dir):
    found = A.nested(participations(spark, sf_dir), "project_name", ["profile_id"], "people")
    return found.select("project_name", F.concat(F.lit("["), F.array_join(F.transform("people", lambda p: p["profile_id"].cast("string")), ", "), F.lit("]")).alias("people"))


@query("with p as (select p_brand, case when p_partkey % 3 = 0 then upper(p_type) when p_partkey % 3 = 1 then p_type || '.' else p_type end as company, lower(p_type) as company_key from part) select company_key, arg_min(company, (p_brand, company)) as company, array_to_string(list_sort(list(distinct p_brand)), ',') as people from p group by 1")
def company_to_people(spark, sf_dir):
    n = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_brand", F.when(n == 0, F.upper("p_type")).when(n == 1, F.concat("p_type", F.lit("."))).otherwise(F.col("p_type")).alias("company"))
    return A.company_index(rows, "company", "p_brand").withColumn("people", F.array_join("people", ","))


@query(f"with {ctes('certs')}, d as (select distinct profile_id, issuer, cert_name as e from certs) select profile_id, issuer, count(*) as n, array_to_string(list_sort(list(e))[1:50], '|') as entities from d group by 1, 2")
def people_facts(spark, sf_dir):
    from crewlens.plans.standins import certs

    return A.people_facts(certs(spark, sf_dir), "profile_id", "issuer", "cert_name").withColumn("entities", F.array_join("entities", "|"))


@query("select user_id, count(*) as total, count(case when event_type = 'error' then 1 end) as error, count(case when event_type = 'signup' then 1 end) as signup from events group by 1")
def simple_counters(spark, sf_dir):
    return A.counters(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["error", "signup"])


@query("select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags, array_to_string(list_sort(list(distinct l_linestatus)), ',') as statuses from lineitem group by 1")
def entity_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flags"), F.col("l_linestatus").alias("statuses"))
    return A.entity_sets(rows, "l_orderkey", ["flags", "statuses"]).select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join("statuses", ",").alias("statuses"))


_ENTITIES = """r as (select l_orderkey as query_id, case l_linenumber % 4 when 0 then 'P' || (l_partkey % 9)::varchar when 1 then ' ' end as name, case when l_linenumber % 3 = 0 then 'Cert ' || l_returnflag end as certification_name, ['Cert ' || l_linestatus, ''] as certifications,
  case when l_linenumber % 2 = 0 then ' Net ' || (l_suppkey % 7)::varchar end as project_name, case when l_linenumber = 2 then 'Firm ' || l_returnflag when l_linenumber = 3 then '' end as company_name, 'Client ' || (l_suppkey % 5)::varchar as client_name, l_linenumber = 1 as listed from lineitem),
 e as (select query_id, 'people' as kind, trim(name) as entity from r union all select query_id, 'people', 'Dir' from r where listed union all select query_id, 'certifications', certification_name from r union all select query_id, 'certifications', unnest(certifications) from r union all select query_id, 'projects', trim(project_name) from r
  union all select query_id, 'companies', coalesce(company_name, client_name) from r union all select query_id, 'companies', 'House' from r where listed), d as (select distinct * from e where entity <> '')"""


@query(f"with {_ENTITIES} select query_id, coalesce(string_agg(entity, ',' order by entity) filter (where kind = 'people'), '') as people, coalesce(string_agg(entity, ',' order by entity) filter (where kind = 'certifications'), '') as certifications, coalesce(string_agg(entity, ',' order by entity) filter (where kind = 'projects'), '') as projects, coalesce(string_agg(entity, ',' order by entity) filter (where kind = 'companies'), '') as companies from d group by 1")
def result_entities(spark, sf_dir):
    """What the results of each order name; its first line is a page of the directory."""
    n, of = F.col("l_linenumber"), lambda word, c: F.concat(F.lit(word), c.cast("string"))
    firm = F.when(n == 2, of("Firm ", F.col("l_returnflag"))).when(n == 3, "")
    staff = F.when(n == 1, F.array(F.struct(F.lit("Dir").alias("name"), F.array(F.lit("House"), F.lit(" ")).alias("companies"))))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.when(n % 4 == 0, of("P", F.col("l_partkey") % 9)).when(n % 4 == 1, " ").alias("name"),
        F.when(n % 3 == 0, of("Cert ", F.col("l_returnflag"))).alias("certification_name"),
        F.array(of("Cert ", F.col("l_linestatus")), F.lit("")).alias("certifications"),
        F.when(n % 2 == 0, of(" Net ", F.col("l_suppkey") % 7)).alias("project_name"),
        firm.alias("company_name"),
        of("Client ", F.col("l_suppkey") % 5).alias("client_name"),
        staff.alias("employees"),
    )
    found = A.result_entities(rows, "query_id")
    return found.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("people", "certifications", "projects", "companies")))


_FACTS = """o as (select 'c' || o_custkey::varchar as name, o_orderkey as pos, o_orderpriority as project_name, o_orderstatus as client_name, year(o_orderdate)::varchar as project_year, repeat(o_orderpriority, (o_orderkey % 90)::integer) as description from orders),
 x as (select 'c' || o_custkey::varchar as name, l_orderkey * 10 + l_linenumber as pos, 'Firm ' || l_linenumber::varchar as company, l_returnflag as role, l_linestatus, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey),
 d as (select 'c' || c_custkey::varchar as name, c_custkey % 11 as project_count, c_custkey % 5 as experience_count, case when c_custkey % 2 = 0 then c_custkey % 30 end as experience_years, c_mktsegment from customer where c_custkey % 3 = 0),
 p1 as (select name, project_name, client_name, project_year, description, min(pos) as pos from o group by all), p2 as (select *, row_number() over (partition by name order by pos) as place, count(*) over (partition by name) as n from p1),
 p as (select name, any_value(n) as n, string_agg(project_name || '/' || client_name || '/' || project_year || '/' || case when length(description) > 500 then description[1:500] || '…' else description end, ';' order by place) filter (where place <= 50) as projects from p2 group by 1),
 x1 as (select name, company, role, min(pos) as pos from x group by all), x2 as (select *, row_number() over (partition by name order by pos, company, role) as place, count(*) over (partition by name) as n from x1),
 j as (select name, any_value(n) as n, string_agg(company || '/' || role, ';' order by place) filter (where place <= 50) as experience from x2 group by 1),
 f as (select name, string_agg(entity, ',' order by entity) as companies from (select name, company as entity from x union select name, c_mktsegment from d) group by 1),
 c as (select name, string_agg(distinct 'Cert ' || l_linestatus, ',' order by 'Cert ' || l_linestatus) as certifications, string_agg(distinct 'School ' || o_orderstatus, ',' order by 'School ' || o_orderstatus) as education from x group by 1), names as (select name from d union select name from o union select name from x)"""


@query(f"with {_FACTS} select name, coalesce(project_count, p.n, 0)::bigint as project_count, coalesce(experience_count, j.n, 0)::bigint as experience_count, experience_years, coalesce(companies, '') as companies, coalesce(certifications, '') as certifications, coalesce(education, '') as education, sha256(coalesce(projects, '')) as projects, sha256(coalesce(experience, '')) as experience from names left join d using (name) left join p using (name) left join j using (name) left join f using (name) left join c using (name)")
def employee_facts(spark, sf_dir):
    """Facts of the customers as people: every third is in the directory, orders are projects, lines are jobs."""
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("name")
    key = F.col("c_custkey")
    directory = table(spark, sf_dir, "customer").where(key % 3 == 0).select(name("c_custkey"), key.alias("pos"), (key % 11).alias("project_count"), (key % 5).alias("experience_count"), F.when(key % 2 == 0, key % 30).alias("experience_years"), F.array("c_mktsegment").alias("companies"))
    orders = table(spark, sf_dir, "orders")
    projects = orders.select(name("o_custkey"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("project_name"), F.col("o_orderstatus").alias("client_name"), F.year("o_orderdate").cast("string").alias("project_year"), F.expr("repeat(o_orderpriority, cast(o_orderkey % 90 as int))").alias("description"))
    jobs = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    experience = jobs.select(name("o_custkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("Firm "), F.col("l_linenumber").cast("string")).alias("company"), F.col("l_returnflag").alias("role"), *(none.alias(c) for c in ("start_date", "end_date", "description")))
    both = F.array(F.struct(F.lit("certification").alias("kind"), F.concat(F.lit("Cert "), "l_linestatus").alias("entity")), F.struct(F.lit("education").alias("kind"), F.concat(F.lit("School "), "o_orderstatus").alias("entity")))
    named = jobs.select(name("o_custkey"), F.explode(both).alias("e")).select("name", "e.*")
    facts = A.employee_facts(directory, projects, experience, named)
    text = lambda c, *parts: F.sha2(F.coalesce(F.array_join(F.transform(c, lambda p: F.concat_ws("/", *(p[x] for x in parts))), ";"), F.lit("")), 256).alias(c)
    return facts.select("name", "project_count", "experience_count", "experience_years", *(F.array_join(c, ",").alias(c) for c in ("companies", "certifications", "education")), text("projects", *A.PROJECT_FIELDS), text("experience", "company", "role"))


@query("select source, count(*) as rows, count(distinct lang) as people from documents group by 1")
def chunk_profile(spark, sf_dir):
    return A.chunk_profile(table(spark, sf_dir, "documents"), "lang", "source")


# Windows and sets


@query("select doc_id, text from documents qualify row_number() over (partition by lower(trim(text)) order by doc_id) = 1")
def keep_first(spark, sf_dir):
    return W.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), F.lower(F.trim("text")), ["doc_id"])


@query("select event_id, user_id, cast(row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as integer) as idx from events")
def entry_index(spark, sf_dir):
    return W.with_index(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "idx")


@query("""with j as (select o_orderkey as job_id, o_custkey as profile_id, o_orderpriority as company_name, cast(o_orderdate as date) as d from orders), k as (select *, row_number() over (partition by profile_id order by d desc, job_id) = 1 and lower(company_name) = '1-urgent' as is_current from j)
 select job_id, is_current, case when is_current then null else d end as end_date from k""")
def current_employer_flag(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("company_name"), F.col("o_orderdate").cast("date").alias("start_date"), F.col("o_orderdate").cast("date").alias("end_date"))
    return W.flag_current(jobs, ["1-urgent"]).select("job_id", "is_current", "end_date")


@query("""with n as (select l_orderkey, l_linenumber * 10000 + l_partkey as pos, case when l_returnflag = 'N' then l_returnflag when l_linestatus = 'F' then 'troubleshooting' else 'Exam ' || cast(l_suppkey as varchar) end as name from lineitem),
 u as (select l_orderkey, pos, min(name) as name from n group by 1, 2), h as (select *, case when (length(name) <= 3 or name = 'troubleshooting') and row_number() over (partition by l_orderkey order by pos) > 1 then 0 else 1 end as head from u),
 g as (select *, sum(head) over (partition by l_orderkey order by pos) as part from h) select l_orderkey, min(pos) as pos, string_agg(name, ' ' order by pos) as name from g group by l_orderkey, part""")
def fragment_merge(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "N", F.col("l_returnflag")).when(F.col("l_linestatus") == "F", "troubleshooting").otherwise(F.concat(F.lit("Exam "), F.col("l_suppkey").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("pos"), name.alias("name")).groupBy("l_orderkey", "pos").agg(F.min("name").alias("name"))
    return W.merge_fragments(rows, "l_orderkey", "pos", "name")


@query("""with r as (select user_id, event_id, cast(month(ts) * 100 + day(ts) as integer) as month, case when event_type = 'click' then cast(day(ts) as varchar) || ' Course' else 'Course' end as name from events),
 w as (select *, lead(month) over (partition by user_id order by event_id) as next_month, lead(name) over (partition by user_id order by event_id) as next_name, lag(month) over (partition by user_id order by event_id) as before from r)
 select user_id, event_id, case when before = month and name <> 'Course' then 'Course' else name end as name, month, case when next_month = month and next_name <> 'Course' then cast(split_part(next_name, ' ', 1) as integer) end as day from w""")
def neighbour_date_recovery(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", F.concat(F.day("ts").cast("string"), F.lit(" Course"))).otherwise("Course")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.month("ts") * 100 + F.day("ts")).alias("month"), name.alias("name"))
    return W.recover_dates(rows, "user_id", "event_id")


@query("""with a as (select c_custkey as id, c_mktsegment as k, 0 as f from customer union all select s_suppkey, 'machinery', 1 from supplier) select lower(k) as key, f as origin, id from a qualify row_number() over (partition by lower(k), id order by f) = 1""")
def union_dedupe_sources(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("k"), F.lit(0).alias("origin"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("machinery").alias("k"), F.lit(1).alias("origin"))
    return A.merge_sources(first, second, [F.lower("k"), F.col("id")], ["id"]).select(F.lower("k").alias("key"), "origin", "id")


@query("""with o as (select l_orderkey, list(l_returnflag) as a, list(l_linestatus || '') as b0, list(case when l_tax > 0.04 then l_returnflag else 'X' end) as b from lineitem group by 1)
 select l_orderkey, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') as common, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))), ',') as missing, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: not list_contains(a, x)))), ',') as extra, list_sort(a) = list_sort(b) as same_bag from o""")
def array_set_ops(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).otherwise("X")).alias("b"))
    d = lists.select("l_orderkey", A.set_diff(F.col("a"), F.col("b")).alias("d"))
    return d.select("l_orderkey", *(F.array_join(f"d.{c}", ",").alias(c) for c in ("common", "missing", "extra")), "d.same_bag")
