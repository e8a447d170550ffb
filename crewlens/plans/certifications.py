"""Queries on certification tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.functions.dates import cert_status
from crewlens.operators import certifications as C
from crewlens.plans.standins import AS_OF, certs, ctes, table


def _day():
    return F.lit(AS_OF).cast("date")


_D = f"date '{AS_OF}'"
_STATUS = f"case when expiration_date is null then 'active' when expiration_date - {_D} < 0 then 'expired' when expiration_date - {_D} <= 30 then 'expiring_soon' else 'active' end"
_STATS = f"""count(*) as total, count(case when {_STATUS} = 'active' then 1 end) as active, count(case when {_STATUS} = 'expiring_soon' then 1 end) as expiring_soon, count(case when {_STATUS} = 'expired' then 1 end) as expired,
 count(case when expiration_date > {_D} and expiration_date <= last_day({_D}) then 1 end) as expiring_this_month"""
_KEY = "trim(regexp_replace(lower(replace({0}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"with {ctes('certs')} select cert_id, expiration_date, {_STATUS} as status, case when expiration_date is null then 'active' when expiration_date - {_D} <= 0 then 'expired' when expiration_date - {_D} <= 30 then 'expiring_soon' else 'active' end as json_status from certs")
def cert_statuses(spark, sf_dir):
    rows = certs(spark, sf_dir)
    return rows.select("cert_id", "expiration_date", cert_status(F.col("expiration_date"), _day()).alias("status"), cert_status(F.col("expiration_date"), _day(), "json").alias("json_status"))


@query(f"with {ctes('certs')} select {_STATS} from certs where is_uploaded")
def cert_stats(spark, sf_dir):
    return C.cert_stats(certs(spark, sf_dir), _day())


@query(f"with {ctes('certs')} select c_nationkey as team_id, {_STATS} from certs join customer on profile_id = c_custkey where is_uploaded group by 1")
def cert_stats_by_team(spark, sf_dir):
    teams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("team_id"))
    return C.cert_stats(certs(spark, sf_dir).join(teams, "profile_id"), _day(), ["team_id"])


@query(f"with {ctes('certs')} select coalesce(nullif(split_part(trim(issuer), ' ', 1), ''), 'Other') as issuer, count(*) as n from certs group by 1 order by n desc, issuer limit 6")
def top_issuers(spark, sf_dir):
    return C.top_issuers(certs(spark, sf_dir), 6)


@query(f"with {ctes('certs')} select cert_id, case {_STATUS} when 'expiring_soon' then 0 when 'active' then 1 else 2 end as priority, expiration_date from certs")
def cert_priority_order(spark, sf_dir):
    return C.order_certs(certs(spark, sf_dir), _day()).select("cert_id", "priority", "expiration_date")


@query(f"""with {ctes('certs')}, trainings as (select o_orderkey as training_id, o_custkey as profile_id, (select p_name from part where p_partkey = o_custkey) as title from orders)
 select t.training_id, t.profile_id, t.title, max(c.cert_id) filter (where c.issue_date = m.d) as cert_id from trainings t
 left join (select profile_id, lower(cert_name) as n, max(issue_date) as d from certs where is_uploaded group by 1, 2) m on m.profile_id = t.profile_id and m.n = lower(t.title)
 left join certs c on c.profile_id = t.profile_id and lower(c.cert_name) = lower(t.title) and c.is_uploaded group by 1, 2, 3""")
def latest_match_join(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("training_id"), F.col("o_custkey").alias("profile_id"))
    trainings = orders.join(names, F.col("profile_id") == F.col("k"), "left").drop("k")
    return C.attach_latest_cert(trainings, certs(spark, sf_dir)).select("training_id", "profile_id", "title", "cert_id")


@query("""with lines as (select l_orderkey * 10 + l_linenumber as id, o_custkey as profile_id, l_returnflag as flag, min(p_name || ' ' || p_type) as name, bool_or(l_linestatus = 'F') as verified from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2, 3),
 uploads as (select * from lines where flag = 'R'), ex as (select * from lines where flag = 'A'),
 pairs as (select u.id as upload_id, e.id as cert_id, lower(u.name) = lower(e.name) as equal, e.verified, len(list_intersect(list_distinct(string_split(lower(u.name), ' ')), list_distinct(string_split(lower(e.name), ' ')))) as common,
  contains(lower(u.name), lower(e.name)) or contains(lower(e.name), lower(u.name)) as inside, least(len(string_split(u.name, ' ')), len(string_split(e.name, ' '))) as shorter from uploads u join ex e using (profile_id))
 select upload_id, cert_id, case when equal then 0 when not verified then 1 else 2 end as priority from pairs where equal or inside or common / shorter >= 0.6
 qualify row_number() over (partition by upload_id order by priority, cert_id) = 1""")
def lenient_cert_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("profile_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), (F.col("l_linestatus") == "F").alias("verified"), F.col("l_returnflag").alias("flag"))
    lines = lines.groupBy("id", "profile_id", "flag").agg(F.min("name").alias("name"), F.bool_or("verified").alias("verified"))
    uploads = lines.where("flag = 'R'").select("profile_id", F.col("id").alias("upload_id"), "name")
    existing = lines.where("flag = 'A'").select("profile_id", F.col("id").alias("cert_id"), F.col("name").alias("other_name"), "verified")
    return C.match_certs(uploads, existing)


_MERGED = f"""with {ctes('certs')}, k as (select *, {_KEY.format('cert_name')} as cert_key, cert_id * 1000 + coalesce(expiration_date - date '1990-01-01', 0) % 1000 as ord from certs),
 merged as (select profile_id, cert_key, arg_min(issuer, ord) filter (where issuer is not null) as issuer, arg_min(expiration_date, ord) filter (where expiration_date is not null) as expiration_date, bool_or(is_uploaded) as is_uploaded from k group by 1, 2)"""


def _merged(spark, sf_dir):
    order = F.col("cert_id") * 1000 + F.coalesce(F.datediff("expiration_date", F.lit("1990-01-01").cast("date")), F.lit(0)) % 1000
    # Numbers can be equal: then the first row of the table counts.
    keyed = certs(spark, sf_dir, row=True).select("*", C.match_key(F.col("cert_name")).alias("cert_key"), F.struct(order.alias("number"), "row").alias("ord"))
    return C.coalesce_dups(keyed, ["profile_id", "cert_key"], "ord", ["issuer", "expiration_date"], ["is_uploaded"])


@query(f"{_MERGED} select profile_id, cert_key, expiration_date, is_uploaded from merged")
def first_non_null_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("profile_id", "cert_key", "expiration_date", "is_uploaded")


@query(f"{_MERGED} select profile_id, cert_key, coalesce(expiration_date < {_D}, false) as is_expired from merged where is_uploaded")
def verified_only_gate(spark, sf_dir):
    return C.verified_certs(_merged(spark, sf_dir), _day()).select("profile_id", "cert_key", "is_expired")


@query(f"""with {ctes('certs')}, n as (select profile_id, count(*) as n, count(case when is_uploaded then 1 end) as v from certs group by 1)
 select profile_id, round(v / n * 100, 2) as verified_pct, least(100.0, round(v / 20 * 100, 2)) as target_pct, v >= 20 as target_met from n""")
def progress_ratio(spark, sf_dir):
    counts = certs(spark, sf_dir).groupBy("profile_id").agg(F.count("*").alias("n"), F.count_if("is_uploaded").alias("n_verified")).withColumn("target", F.lit(20))
    return C.progress(counts).select("profile_id", "verified_pct", "target_pct", "target_met")


@query(f"with {ctes('certs')} select cert_id, profile_id, cert_name from certs c where not is_uploaded and not exists (select 1 from certs v where v.is_uploaded and v.profile_id = c.profile_id and lower(v.cert_name) = lower(c.cert_name))")
def suppress_verified(spark, sf_dir):
    rows = certs(spark, sf_dir)
    return C.new_unverified(rows.where("not is_uploaded"), rows.where("is_uploaded")).select("cert_id", "profile_id", "cert_name")


@query(f"""with {ctes('certs')}, due as (select *, expiration_date - {_D} as days from certs), k as (select *, case when days > 0 and days <= 30 then 'expiring_30_days' when days > -7 and days <= 0 then 'expired' end as alert_type from due)
 select cert_id, profile_id, alert_type, cast(days as integer) as days, case when alert_type = 'expiring_30_days' and days > 7 then 2 else 3 end as priority from k where alert_type is not null and not (alert_type = 'expired' and cert_id in (select cert_id from certs where is_uploaded))""")
def expiry_alerts(spark, sf_dir):
    """Alerts of the day; uploaded certifications have had their expired alert before."""
    rows = certs(spark, sf_dir)
    sent = rows.where("is_uploaded").select("cert_id", F.lit("expired").alias("alert_type"))
    return C.expiry_alerts(rows, sent, _day())


@query("""with d as (select o_orderkey as doc_id, o_orderpriority as name from orders), c as (select l_orderkey as doc_id, case when l_linenumber % 2 = 0 then o_orderpriority else p_name end as name, max(p_brand) as issuer from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)
 select coalesce(d.doc_id, c.doc_id) as doc_id, coalesce(d.name, c.name) as name, coalesce(c.issuer, case when d.doc_id is not null then 'none' end) as issuer, c.doc_id is not null as is_uploaded from d full outer join c on d.doc_id = c.doc_id and lower(d.name) = lower(c.name)""")
def merge_cert_into_document(spark, sf_dir):
    one = F.array(F.struct(F.col("o_orderpriority").alias("name"), F.lit("none").alias("issuer"), F.lit(False).alias("is_uploaded")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), one.alias("certs"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = lines.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("issuer"), F.lit(True).alias("is_uploaded"))
    return C.merge_cert_arrays(docs, found).select("doc_id", F.explode("certs").alias("c")).select("doc_id", "c.*")
