"""Queries on evaluation: labels against a rule, benchmark items, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.operators import evaluation as E
from crewlens.plans.standins import table


def _sides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    truth = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.array("p_brand", "p_type").alias("skills"))
    odd = F.col("p_size") % 2 == 1
    turned = F.concat_ws(" ", F.get(F.split("p_name", " "), F.lit(1)), F.get(F.split("p_name", " "), F.lit(0)))
    predicted = part.select("p_partkey", F.when(odd, turned).otherwise(F.upper("p_name")).alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"), F.when(odd, F.array(F.lower("p_brand"))).otherwise(F.array("p_name")).alias("skills"))
    return truth, predicted


_TURNED = "split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)"


@query(f"select round(avg(case when p_size % 2 = 0 or p_name = {_TURNED} then 100.0 else 0.0 end), 6) as name, round(avg(case when p_size > 25 then 100.0 else 0.0 end), 6) as kind, round(avg(case when p_size % 2 = 1 then 50.0 else 0.0 end), 6) as skills from part")
def field_accuracy(spark, sf_dir):
    truth, predicted = _sides(spark, sf_dir)
    return E.field_accuracy(truth, predicted, "p_partkey", ["name", "kind"], [], ["skills"])


@query(f"""select p_partkey, 'name' as field, 'same words in another order' as reason from part where p_size % 2 = 1 and p_name <> {_TURNED} union all select p_partkey, 'kind', 'missing' from part where p_size <= 25 union all select p_partkey, 'skills', 'no overlap' from part where p_size % 2 = 0""")
def mismatch_report(spark, sf_dir):
    truth, predicted = _sides(spark, sf_dir)
    return E.mismatch_report(truth, predicted, "p_partkey", ["name", "kind"], ["skills"]).select("p_partkey", "field", "reason")


@query(f"""with m as (select 'name' as field, p_partkey from part where p_size % 2 = 1 and p_name <> {_TURNED} union all select 'kind', p_partkey from part where p_size <= 25 union all select 'skills', p_partkey from part where p_size % 2 = 0) select field, count(*) as mismatches, (select count(*) from part) as records from m group by 1""")
def mismatch_counts(spark, sf_dir):
    truth, predicted = _sides(spark, sf_dir)
    return E.mismatch_counts(E.mismatch_report(truth, predicted, "p_partkey", ["name", "kind"], ["skills"]), truth, "p_partkey")


def _alias_rows(spark, sf_dir):
    """Names with a letter dropped, blank or of another part, issuers inside longer ones, against spellings of which some are blank or none."""
    n, part = F.col("p_partkey") % 7, table(spark, sf_dir, "part")
    name = F.when(n == 0, " ").when(n == 1, F.col("p_type")).otherwise(F.expr("left(p_name, length(p_name) - 1)"))
    names = F.when(n == 2, F.array().cast("array<string>")).when(n < 6, F.array(F.lit(" "), F.col("p_brand"), F.col("p_name")))
    return part.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat("p_brand", F.lit(" Academy")).alias("issuer"), names.alias("names"), F.array(F.when(n == 3, "").otherwise(F.col("p_brand")), F.lit("x")).alias("issuers"))


@query()
def alias_match_eval(spark, sf_dir):
    return E.alias_eval(_alias_rows(spark, sf_dir))


@query("""with r as (select p_partkey % 7 in (3, 4, 5) as name_ok, p_partkey % 7 <> 3 as issuer_ok, p_size as seconds from part)
 select count(*) as sample_size, count_if(name_ok) as name_right, count_if(issuer_ok) as issuer_right, count_if(name_ok and issuer_ok) as both_right, round(avg(case when name_ok then 100.0 else 0.0 end), 6) as name_pct, round(avg(case when issuer_ok then 100.0 else 0.0 end), 6) as issuer_pct,
  round(avg(case when name_ok and issuer_ok then 100.0 else 0.0 end), 6) as both_pct, round(sum(seconds)::double, 3) as seconds, round(sum(seconds) / count(*), 3) as seconds_mean from r""")
def alias_rates(spark, sf_dir):
    """Of names with a letter dropped, all others are blank, another text or without spellings; issuers lack only where theirs is blank."""
    seconds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("seconds"))
    return E.alias_rates(E.alias_eval(_alias_rows(spark, sf_dir)), seconds)


@query("""with e as (select item_id as query_id, string_split(lower(text), ' ')[1:3] as terms from benchmark), r as (select doc_id % (select count(*) from benchmark) as query_id, lower(text) as text from documents)
 select query_id, round(avg(case when len(list_filter(terms, lambda t: contains(text, t))) > 0 then 100.0 else 0.0 end), 6) as precision from r join e using (query_id) group by 1""")
def retrieval_precision(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    expected = items.select(F.col("item_id").alias("query_id"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("terms"))
    n = items.count()
    results = table(spark, sf_dir, "documents").select((F.col("doc_id") % n).alias("query_id"), F.lit(1).alias("place"), "text")
    return E.retrieval_precision(results, expected)


@query(r"""with t as (select conv_id as id, turn, role, regexp_replace(case when role = 'assistant' and turn % 7 = 3 then 'I don''t know. ' else '' end || text, '[^\x00-\x7F]', ' ', 'g') as text from conversations),
 a as (select id, string_agg(text, ' ' order by turn) as text from t where role = 'assistant' group by 1),
 l as (select id, case when contains(lower(text), 'i don''t have') or contains(lower(text), 'i don''t know') then [] else list_distinct(list_transform(list_concat(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), regexp_extract_all(text, '\b\+?[0-9]{2,4}[ 0-9-]{6,12}\b'), regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9-]{2,}\b'), regexp_extract_all(text, '\b[A-Z]{3,5}\b')), lambda c: trim(lower(c)))) end as claims from a),
 u as (select id, trim(lower(text)) as context from t where role = 'user'), c as (select id, unnest(claims) as claim from l),
 x as (select c.id, claim, claim in ('the', 'this', 'he', 'she', 'they') or coalesce(bool_or(contains(context, claim)), false) as ok from c left join u using (id) group by 1, 2)
 select l.id, len(claims)::integer as claims, case when len(claims) = 0 then 100.0 else round((select count_if(ok) from x where x.id = l.id) / len(claims) * 100, 1) end as grounded_pct from l""")
def claim_groundedness(spark, sf_dir):
    """All that the assistant says in a conversation, some of it a refusal, against what the user says; letters beyond ASCII are blanks."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")
    said = F.concat(F.when((F.col("role") == "assistant") & (F.col("turn") % 7 == 3), "I don't know. ").otherwise(""), "text")
    turns = turns.withColumn("text", F.regexp_replace(said, r"[^\x00-\x7F]", " "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return E.claim_groundedness(turns.where("role = 'assistant'").groupBy("id").agg(lines.alias("text")), turns.where("role = 'user'"))


@query("""with a as (select case when turn % 3 = 0 then 'Sorry, I DON''T KNOW. ' else '' end || text as text from conversations where role = 'assistant')
 select round(avg(case when contains(lower(text), 'i don''t have') or contains(lower(text), 'i do not have') or contains(lower(text), 'i don''t know') or contains(lower(text), 'i do not know') or contains(lower(text), 'not mentioned') or contains(lower(text), 'insufficient information') or contains(lower(text), 'no information') or contains(lower(text), 'does not contain') then 100.0 else 0.0 end), 6) as rejected_pct from a""")
def rejection_rate(spark, sf_dir):
    """Answers of the conversations, every third turn with a refusal before it."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return E.rejection_rate(turns.select(F.concat(F.when(F.col("turn") % 3 == 0, "Sorry, I DON'T KNOW. ").otherwise(""), "text").alias("text")))


@query("""with b as (select l_returnflag as metric, round(avg(l_quantity), 6) as before from lineitem where l_linestatus = 'F' group by 1), a as (select l_returnflag as metric, round(avg(l_quantity), 6) as after from lineitem where l_linestatus = 'O' group by 1)
 select coalesce(b.metric, a.metric) as metric, before, after, round(after - before, 6) as delta from b full outer join a on a.metric = b.metric""")
def before_after(spark, sf_dir):
    metric = lambda status: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status).groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return E.metric_delta(metric("F"), metric("O"))


@query("select o_custkey, string_agg(o_orderpriority || ' | ' || o_orderstatus, ';' order by o_orderkey) as jobs from orders group by 1")
def flatten_predictions(spark, sf_dir):
    jobs = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"), F.lit(" ").alias("dates"))))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(jobs.alias("jobs"))
    return E.flatten_predictions(rows, "jobs", ["title", "company", "dates"]).select("o_custkey", F.array_join("jobs", ";").alias("jobs"))
