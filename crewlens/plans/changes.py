"""Queries on changes: the batch forms over events and orders. Streams are tested against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.operators import records as D
from crewlens.operators.windows import rank_scores
from crewlens.plans.standins import table
from crewlens.sources import tables as S
from crewlens.streaming import changes as C


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("profile_id"), F.year("o_orderdate").alias("score_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("final_score"))


@query("""with s as (select o_custkey as profile_id, year(o_orderdate) as score_year, round(sum(o_totalprice), 2) as final_score from orders group by 1, 2)
 select profile_id, score_year::integer as score_year, final_score, row_number() over (partition by score_year order by final_score desc, profile_id)::integer as rank from s""")
def impacted_rescore(spark, sf_dir):
    """Old scores without the open orders, rescored where those orders fall: the same as scoring all at once."""
    orders = table(spark, sf_dir, "orders")
    full = _scores(spark, sf_dir)
    old = orders.where("o_orderstatus <> 'O'").groupBy(F.col("o_custkey").alias("profile_id"), F.year("o_orderdate").alias("score_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("final_score"))
    events = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("date"))
    keys = C.impacted_keys(events, F.lit(2001))
    return C.rescore(rank_scores(old, ["score_year"]), full, keys).select("profile_id", "score_year", "final_score", "rank")


@query("select c_custkey as user_id, case when c_acctbal < 0 then 'new' else 'old' end as content from customer")
def chunk_refresh(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    chunks = users.select("user_id", F.lit("old").alias("content"))
    return C.refresh_chunks(chunks, users.where("c_acctbal < 0"), users.select("user_id", F.lit("new").alias("content")))


@query("select sha256(text) as file_hash, min(doc_id) as doc_id from documents where sha256(text) not in (select sha256(text) from documents where lang = 'de') group by 1")
def first_hash_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("file_hash"))
    return C.admit_once(rows, rows.where("lang = 'de'"), ["doc_id"]).select("file_hash", "doc_id")


@query("select event_id as notification_id from events e where event_type <> 'click' and (event_type = 'error' or ts <= timestamp '2024-01-20 00:00:00') order by ts, event_id limit 200")
def email_outbox(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("notification_id"), "event_type", F.col("ts").alias("created_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("scheduled_at"))
    acknowledged = rows.where("event_type = 'click'")
    return C.outbox(rows, acknowledged, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("notification_id")


_STATUS = "case event_type when 'signup' then 'assigned' when 'view' then 'in_progress' else 'completed' end"


@query(f"""with e as (select user_id as training_id, {_STATUS} as status, ts, event_id from events) select training_id, arg_max(status, (ts, case status when 'assigned' then 1 when 'in_progress' then 2 else 3 end)) as status, min(case when status = 'in_progress' then ts end) as start, max(case when status = 'completed' then ts end) as "end" from e group by 1""")
def status_fold(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "assigned").when(F.col("event_type") == "view", "in_progress").otherwise("completed")
    return C.fold_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("training_id"), status.alias("status"), "ts"))


@query("""with p as (select user_id as record_id, min(ts) as pending_at from events where event_type = 'signup' group by 1), s as (select user_id as record_id, arg_min(value, ts) as score, min(ts) as scored_at from events join p on user_id = record_id where event_type = 'purchase' and ts >= pending_at group by 1)
 select record_id, score, case when scored_at is null then 'pending' else 'scored' end as status from p left join s using (record_id)""")
def evaluation_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "scored").alias("status"), F.col("value").alias("score"), "ts")
    return C.fold_evaluation(events).select("record_id", "score", "status")


@query("select o_orderkey as snapshot_id, lead(o_orderdate) over w as valid_to, lead(o_orderdate) over w is null as is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def snapshot_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return C.snapshot_versions(rows).select("snapshot_id", "valid_to", "is_current")


@query("""with e as (select user_id as answer_id, event_id as seq, case event_type when 'error' then 'replace' when 'signup' then 'context' when 'purchase' then 'done' else 'token' end as kind, left(event_type, 2) as text from events),
 c as (select answer_id, max(case when kind = 'replace' then seq end) as cut, bool_or(kind = 'done') as done from e group by 1)
 select c.answer_id, coalesce(string_agg(text, '' order by seq) filter (where kind in ('token', 'replace') and (cut is null or seq >= cut)), '') as answer, done from c left join e on c.answer_id = e.answer_id group by 1, 3""")
def answer_assembly(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "replace").when(F.col("event_type") == "signup", "context").when(F.col("event_type") == "purchase", "done").otherwise("token")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.substring("event_type", 1, 2).alias("text"))
    return C.assemble_answers(events).select("answer_id", "answer", "done")


@query("select o_orderkey as event_id, case o_orderstatus when 'F' then 'score' when 'O' then 'requested' else 'approved' end as event_type, case o_orderstatus when 'F' then o_custkey when 'O' then o_orderkey % 7 else o_custkey + 1 end as user_id, case o_orderstatus when 'O' then 2 else 1 end as priority from orders")
def request_notifications(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "score").when(F.col("o_orderstatus") == "O", "requested").otherwise("approved")
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), kind.alias("event_type"), F.col("o_custkey").alias("assignee"), (F.col("o_orderkey") % 7).alias("manager"), (F.col("o_custkey") + 1).alias("requester"))
    return C.notifications_for(events)


@query("select user_id, md5(event_type) as file_hash, count(*) as uses, max(ts) as last_used from events group by 1, 2")
def usage_counter(spark, sf_dir):
    return C.template_usage(table(spark, sf_dir, "events").select("user_id", F.md5("event_type").alias("file_hash"), "ts"))


# Sources and sinks


@query("select r_name, count(*) as customers from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey group by 1")
def load_tables(spark, sf_dir):
    t = S.load_tables(spark, sf_dir, ["region", "nation", "customer"])
    return t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey")).join(t["customer"], F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"))


@query("select page_id, strlen(html) <= 8000 as accepted, case when strlen(html) > 8000 then 'too large' else 'ok' end as reason from pages")
def admit_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.lit("image/png").alias("mime"), F.octet_length("html").alias("length"))
    return S.admit_files(files, 8000).select("page_id", "accepted", "reason")


@query("select o_custkey as profile_id, count(*) as n_projects, sha256(string_agg(o_orderpriority, ',' order by o_orderkey)) as names from orders group by 1")
def profile_documents(spark, sf_dir):
    """Nested documents of the tables, read back out of their JSON."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("name"))
    projects = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("project_name"))
    docs = S.profile_documents(people, {"projects": projects})
    entries = F.from_json("doc", "name string, projects array<struct<pos: bigint, project_name: string>>")["projects"]
    return docs.select("profile_id", entries.alias("p")).where("size(p) > 0").select("profile_id", F.size("p").cast("long").alias("n_projects"), F.sha2(F.array_join(F.transform("p", lambda x: x["project_name"]), ","), 256).alias("names"))


@query("select c_custkey as user_id, 'c' || c_custkey::varchar as chunk_id, 'base' as content from customer where c_nationkey >= 5 union all select c_custkey, 'c' || c_custkey::varchar, 'last' from customer where c_nationkey < 5")
def upsert_chunks(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_id"), F.lit("base").alias("content"), "c_nationkey")
    fresh = base.where("c_nationkey < 5").drop("c_nationkey", "content")
    changes = fresh.select("*", F.lit("first").alias("content"), F.lit(1).alias("seq")).union(fresh.select("*", F.lit("last").alias("content"), F.lit(2).alias("seq")))
    return S.upsert_by_key(base.drop("c_nationkey"), changes, "user_id", "chunk_id", "seq")


@query("select c_custkey as user_id from customer where c_nationkey >= 5")
def delete_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return S.delete_by_key(rows.select("user_id"), rows.where("c_nationkey < 5"), "user_id")


@query("""with o as (select o_custkey as profile_id, o_orderkey as pos, case when o_orderkey % 2 = 0 then 'Été ' else 'ÉTÉ ' end || o_orderpriority as name, case when o_orderkey % 3 = 0 then 'issuer ' || (o_orderkey % 5)::varchar end as issuer, case when o_orderkey % 4 > 0 then strftime(o_orderdate, '%Y') end as issued, strftime(o_orderdate, '%m/%Y') as obtained, o_orderkey % 5 > 0 as up, o_orderstatus from orders),
 e as (select *, 0 as source from o where o_orderstatus = 'F' and up and profile_id in (select c_custkey from customer where c_nationkey < 20) union all select *, 1 from o where o_orderstatus <> 'F' and profile_id in (select c_custkey from customer where c_nationkey < 20)),
 f as (select *, lower(strip_accents(name)) as same, coalesce(issued, obtained) as got, case when issued is not null then obtained end as later from e),
 m as (select profile_id, same, arg_min(name, (source, pos)) as name, arg_min(issuer, (source, pos)) filter (where issuer is not null) as issuer, arg_min(got, (source, pos)) as got, arg_min(later, (source, pos)) filter (where later is not null) as later, bool_or(source = 0) as up, min((source, pos)) as first from f group by 1, 2),
 n as (select profile_id, string_agg(name || '|' || coalesce(issuer, '') || '|' || got || '|' || coalesce(later, '') || '|' || up::varchar, ';' order by first) as certs from m group by 1),
 k as (select profile_id, string_agg(name || '|' || coalesce(issuer, '') || '|' || coalesce(issued, '') || '|' || obtained || '|' || up::varchar, ';' order by pos) as certs from o where o_orderstatus = 'F' group by 1)
 select c_custkey as profile_id, case when c_nationkey < 20 then case when c_custkey % 3 = 0 then 'Unknown' else c_name end else 'old name' end as name, case when c_nationkey < 20 then c_mktsegment || ',SQL' else 'old' end as skills,
  case when c_nationkey < 20 then n.certs else k.certs end as certs, case when c_nationkey < 20 then coalesce(case when c_custkey % 2 = 0 then c_nationkey end, 0) else case when c_custkey % 2 = 0 then c_nationkey end end::double as experience_years, 'kept' as other from customer left join n on n.profile_id = c_custkey left join k on k.profile_id = c_custkey""")
def save_profile_document(spark, sf_dir):
    """A parse of most people over their documents: proven certifications of old and new ones under names that differ by case and accents."""
    order, people = F.col("o_orderkey"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "profile_id")
    cert = F.struct(
        F.concat(F.when(order % 2 == 0, "Été ").otherwise("ÉTÉ "), "o_orderpriority").alias("name"), F.when(order % 3 == 0, F.concat(F.lit("issuer "), (order % 5).cast("string"))).alias("issuer"), F.when(order % 4 > 0, F.date_format("o_orderdate", "yyyy")).alias("issue_date"),
        F.date_format("o_orderdate", "MM/yyyy").alias("date_obtained"), F.lit(None).cast("string").alias("expiration"), F.lit(" ").alias("credential_id"), (order % 5 > 0).alias("is_uploaded"),
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "profile_id")
    certs = lambda rows: rows.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cert.alias("c")))), lambda x: x["c"]).alias("certifications"))
    old = people.join(certs(orders.where("o_orderstatus = 'F'")), "profile_id", "left").select("profile_id", F.lit("old name").alias("name"), F.array(F.lit("old")).alias("skills"), "certifications", F.when(F.col("profile_id") % 2 == 0, F.col("c_nationkey")).cast("double").alias("experience_years"), F.lit("kept").alias("other"))
    skills = F.array("c_mktsegment", F.lit(" SQL "), F.lit("sql"), F.lower("c_mktsegment"))
    parsed = people.where("c_nationkey < 20").join(certs(orders.where("o_orderstatus <> 'F'")), "profile_id", "left").select("profile_id", F.when(F.col("profile_id") % 3 > 0, F.col("c_name")).alias("first_name"), F.lit(" ").alias("last_name"), skills.alias("skills"), "certifications")
    told = lambda c: F.concat_ws("|", *(F.coalesce(c[f].cast("string"), F.lit("")) for f in ("name", "issuer", "issue_date", "date_obtained", "is_uploaded")))
    docs = D.save_documents(old, parsed, "profile_id")
    return docs.select("profile_id", "name", F.array_join("skills", ",").alias("skills"), F.when(F.size("certifications") > 0, F.array_join(F.transform("certifications", told), ";")).alias("certs"), "experience_years", "other")


@query("select c_custkey as profile_id, case when c_acctbal > 0 then 'new' else 'old' end as summary, 'kept' as other from customer")
def overlay_documents(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    old = people.select(F.col("c_custkey").alias("profile_id"), F.lit("old").alias("summary"), F.lit("kept").alias("other"))
    parsed = people.where("c_nationkey < 30").select(F.col("c_custkey").alias("profile_id"), F.when(F.col("c_acctbal") > 0, "new").alias("summary"))
    return S.overlay(old, parsed, "profile_id")
