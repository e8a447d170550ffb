"""Queries on field extraction, over documents, pages and texts put together from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.operators import extraction as X
from crewlens.operators import records as D
from crewlens.plans.standins import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_WORDY = "trim(regexp_replace(lower(replace(strip_accents({0}), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""with t as (select doc_id, {_WORDY.format("repeat('Feuille de présence; FORMATION, ', (doc_id % 4)::integer) || text || repeat(' le Projet du Marché', (doc_id % 3)::integer) || case when doc_id % 5 = 0 then ' projets, trainers' else ' Client!' end")} as key from documents)
 select doc_id, case when len(regexp_extract_all(key, '\b(feuille de presence|attendance|participants|formateur|trainer|formation)\b')) > len(regexp_extract_all(key, '\b(attestation|certifie|certify|projet|project|client|marche)\b')) then 'training_sheet' else 'attestation' end as doc_type from t""")
def classify_document(spark, sf_dir):
    """Whole documents with some words of either kind before and behind them."""
    n = F.col("doc_id")
    text = F.concat(F.expr("repeat('Feuille de présence; FORMATION, ', cast(doc_id % 4 as int))"), "text", F.expr("repeat(' le Projet du Marché', cast(doc_id % 3 as int))"), F.when(n % 5 == 0, " projets, trainers").otherwise(" Client!"))
    return X.classify_docs(_docs(spark, sf_dir).select("doc_id", text.alias("text"))).select("doc_id", "doc_type")


@query("""select o_orderkey as doc_id, 'Net ' || o_orderpriority as project_name, case when o_orderkey % 3 > 0 then 'C' || o_custkey::varchar end as client_name, o_orderdate::date as date, true as confirmed, 2 as n_members, case o_orderkey % 4 when 0 then 'project_lead' when 1 then 'technical_lead' else 'contributor' end as first_role, case when o_orderkey % 3 = 0 then 'no client' else '' end as assumptions from orders""")
def extract_attestation(spark, sf_dir):
    o = F.col("o_orderkey")
    role = F.when(o % 4 == 0, "Chef de projet").when(o % 4 == 1, "Chef de projet technique").when(o % 4 == 2, "Project Manager").otherwise("Chef de projet, support technique")
    text = F.concat_ws("\n", F.lit("We certify the following"), F.concat(F.lit("Project: Net "), "o_orderpriority"), F.when(o % 3 > 0, F.concat(F.lit("Client: C"), F.col("o_custkey").cast("string"))), F.concat(F.lit("Tunis, le "), F.date_format("o_orderdate", "dd/MM/yyyy")), F.concat(F.lit("- Ann Lee: "), role), F.lit("- Bo Ek: developer"))
    found = X.extract_attestation(table(spark, sf_dir, "orders").select(o.alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "project_name", "client_name", "date", "confirmed", F.size("members").alias("n_members"), F.col("members")[0]["role"].alias("first_role"), F.array_join("assumptions", ",").alias("assumptions"))


@query("""select o_orderkey as doc_id, o_orderpriority as training_name, 'T' || o_custkey::varchar as trainer, 'Sfax' as place, o_orderdate::date as start_date, o_orderdate::date + 3 as end_date, 2 as n_participants from orders""")
def extract_sheet(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    text = F.concat_ws("\n", F.concat(F.lit("Formation : "), "o_orderpriority"), F.concat(F.lit("Formateur: T"), F.col("o_custkey").cast("string")), F.lit("Lieu: Sfax"), F.concat(F.lit("Dates: "), F.date_format(d, "dd/MM/yyyy"), F.lit(" au "), F.date_format(F.date_add(d, 3), "dd/MM/yyyy")), F.lit("1. Ann\n2) Bo\n3. Ann"))
    found = X.extract_sheet(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "training_name", "trainer", "place", "period.start_date", "period.end_date", F.size("participants").alias("n_participants"))


@query("select o_orderkey as doc_id, o_orderdate::date as date from orders")
def extract_dates(spark, sf_dir):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(n == 0, F.concat(F.lit("Tunis, le "), F.date_format(d, "dd/MM/yyyy"))).when(n == 1, F.concat(F.lit("seen on 99 and "), F.date_format(d, "dd-MM-yyyy"), F.lit(" there"))).otherwise(F.concat(F.lit("Done "), F.date_format(d, "d MMMM yyyy")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), X.first_date(text).alias("date"))


@query("""select o_orderkey as doc_id, case o_orderkey % 3 when 0 then 'Acme ' || o_orderstatus when 1 then 'University of X' else 'Cisco' end as issuer, o_orderdate::date as issue_date, case o_orderkey % 3 when 0 then (o_orderdate + interval 3 year)::date when 1 then null else o_orderdate::date + 100 end as expiration_date, 'AB-' || (o_orderkey + 10000)::varchar as credential_id from orders""")
def extract_cert_fields(spark, sf_dir):
    d, n = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    body = F.when(n == 0, F.concat(F.lit("Issued by: Acme "), F.col("o_orderstatus"), F.lit("\nValid for 3 years"))).when(n == 1, F.lit("University of X\nDiploma")).otherwise(F.concat(F.lit("a Cisco course\nExpires: "), F.date_format(F.date_add(d, 100), "yyyy-MM-dd")))
    text = F.concat_ws("\n", body, F.concat(F.lit("Issue date: "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("Credential ID: AB-"), (F.col("o_orderkey") + 10000).cast("string")))
    return X.extract_cert_fields(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents), t as (select doc_id, trim(x) as x from l) select d.doc_id, count(x) as n_lines, coalesce(sum(length(x)), 0)::bigint as chars from documents d left join (select * from t where length(x) > 3 and length(regexp_replace(x, '[^\p{L}\p{N} ]', '', 'g')) * 2 >= length(x)) k on k.doc_id = d.doc_id group by 1""")
def line_noise_filter(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", X.clean_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("""select p_partkey, concat_ws(', ', case when p_size < 10 then 'name unknown or generic' end, case when p_size % 2 = 0 then 'no issuer' end, case when p_size > 40 then 'no date' end) as flags from part""")
def completeness_gate(spark, sf_dir):
    size = F.col("p_size")
    fields = table(spark, sf_dir, "part").select("p_partkey", F.when(size < 10, "Certificate").otherwise(F.col("p_name")).alias("certification_name"), F.when(size % 2 == 1, F.col("p_brand")).alias("issuer"), F.when(size <= 40, F.lit("2020-01-01").cast("date")).alias("issue_date"))
    return X.needs_review(fields).select("p_partkey", F.array_join("flags", ", ").alias("flags"))


_PHONE = r"\+?[0-9(][0-9().\- ]{6,}[0-9]"
_FINE = r"(length(regexp_replace({0}, '[^0-9]', '', 'g')) between 8 and 15 and not regexp_matches({0}, '^[0-9]{{1,2}}[.\-/ ][0-9]{{1,2}}[.\-/ ][0-9]{{4}}$'))"


@query(rf"""with l as (select doc_id, text, regexp_extract(text, '(?i)(?:phone|tel|mobile|t[ée]l[ée]phone)\.?\s*[:\-]?\s*({_PHONE})', 1) as named, list_filter(regexp_extract_all(text, '({_PHONE})', 1), lambda p: {_FINE.format("p")}) as others, trim(string_split(text, chr(10))[1]) as head from documents)
 select doc_id, nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0)), '') as email, coalesce(case when {_FINE.format("named")} then named end, others[1]) as phone,
  case when len(regexp_split_to_array(head, '\s+')) <= 4 and not regexp_matches(head, '[0-9@]') and head <> '' then head end as name from l""")
def extract_contact(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.extract_contact(F.col("text")).alias("c")).select("doc_id", "c.*")


#: Lines put into documents: headings in several languages with up to two words more, and lines that only look like some.
_PUT = ("Expérience professionnelle", "SKILLS & Tools", "Formation:", "projects of the last years", "Technical Skills", "- Langues -", "my education", "Work experience at the old firm", "Certificats et diplômes", "")
_PUT_SQL = "[" + ", ".join(f"'{x}'" for x in _PUT) + "]"
_HEADINGS = ", ".join(f"('{word}', '{section}', {len(word.split())})" for section, words in X.SECTIONS.items() for word in words)


@query(rf"""with x as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
 l as (select doc_id, n * 2 as pos, line from x union all select doc_id, n * 2 - 1, ({_PUT_SQL})[((doc_id + n) % 10 + 1)::integer] from x where n % 3 = 2), k as (select *, string_split({_WORDY.format('line')}, ' ') as words from l where trim(line) <> ''),
 h as (select word, min(section) as section, any_value(n) as n from (values {_HEADINGS}) v(word, section, n) group by 1),
 m as (select doc_id, pos, arg_max(section, n) as head from k join h on array_to_string(words[1:n], ' ') = word and len(words) - n between 0 and 2 group by 1, 2),
 s as (select k.*, head, coalesce(last_value(head ignore nulls) over (partition by k.doc_id order by k.pos rows between unbounded preceding and current row), 'header') as section from k left join m on m.doc_id = k.doc_id and m.pos = k.pos)
 select doc_id, section, count(*) as n, count(head) as headings, sha256(string_agg(line, chr(10) order by pos)) as lines from s group by 1, 2""")
def segment_sections(spark, sf_dir):
    """Whole documents with headings, and lines that are none, before every third line."""
    at = lambda i: F.element_at(F.array(*map(F.lit, _PUT)), ((F.col("doc_id") + i) % 10 + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 2, F.concat(at(i + 1), F.lit("\n"), x)).otherwise(x))
    docs = _docs(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text"))
    rows = X.segment_sections(docs).groupBy("doc_id", "section")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.agg(F.count("*").alias("n"), F.count_if("is_heading").alias("headings"), F.sha2(text, 256).alias("lines"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
 e as (select *, sum(case when regexp_matches(line, '(?:19|20)[0-9]{2}') then 1 else 0 end) over (partition by doc_id order by pos) as entry from l where trim(line) <> '')
 select doc_id, 'projects' as section, entry::bigint as entry, sha256(string_agg(trim(line), ' ' order by pos)) as item from e group by 1, 3""")
def section_items(spark, sf_dir):
    """Whole texts below a heading: every line with a year begins an entry."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Projets\n"), "text").alias("text"))
    items = X.section_items(X.segment_sections(docs).where("section = 'projects'"))
    return items.select("doc_id", "section", "entry", F.sha2("item", 256).alias("item"))


_KEY = "trim(regexp_replace(lower(replace(strip_accents({0}), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
 c as (select doc_id, pos, trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as t from l where trim(line) <> ''),
 h as (select *, contains(t, ':') as colon, trim(split_part(t, ':', 1)) as category, case when contains(t, ':') then trim(t[position(':' in t) + 1:]) else t end as rest from c),
 p as (select *, list_filter(list_transform(string_split(rest, ','), lambda x: trim(x)), lambda x: x <> '') as parts from h),
 k as (select doc_id, pos, list_concat(case when colon and not (contains({_KEY.format("category")}, 'competence') or {_KEY.format("category")} in ('skill', 'skills')) then [category] else [] end,
  case when len(parts) > 1 and len(list_filter(parts, lambda x: len(string_split(x, ' ')) > 4)) = 0 and (colon or not regexp_matches(rest, '[()]')) then parts else [rest] end) as skills from p),
 u as (select doc_id, pos, unnest(skills) as skill, generate_subscripts(skills, 1) as i from k),
 f as (select *, {_KEY.format("skill")} as key from u where skill <> '' and {_KEY.format("skill")} not in ('competence', 'competences', 'skill', 'skills', 'technology', 'technologie', 'supplementaire', 'additional', 'competences supplementaires', 'additional skills')),
 o as (select * from f qualify row_number() over (partition by doc_id, key order by pos, i) = 1)
 select doc_id, (row_number() over (partition by doc_id order by pos, i))::integer as place, sha256(skill) as skill from o""")
def section_skills(spark, sf_dir):
    """Whole texts as skills sections, without the headings that may stand in them."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    found = X.section_skills(lines.withColumn("section", F.lit("skills")).withColumn("is_heading", F.lit(False)))
    return found.select("doc_id", "place", F.sha2("skill", 256).alias("skill"))


@query("""select p_partkey, coalesce(case when p_size % 2 = 0 then p_name end, p_brand) as title, case when p_size % 2 = 0 then p_type || ',' || p_brand else p_type || ',' || p_brand end as skills from part""")
def gap_fill_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("title"), F.array("p_type").alias("skills"))
    second = part.select("p_partkey", F.col("p_brand").alias("title"), F.array("p_type", "p_brand").alias("skills"))
    return X.gap_fill(first, second, "p_partkey", ["title"], ["skills"]).withColumn("skills", F.array_join("skills", ","))


@query("""with o as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, least(n, 10)::integer as kept, (n + 1 - least(n, 10))::integer as dropped, case when n > 10 then 'too many projects' else '' end as warnings from o""")
def validate_records(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.array(F.lit(" ")), F.collect_list("o_orderpriority")).alias("projects"))
    out = X.validate_records(lists, ["projects"])
    return out.select("o_custkey", F.size("projects").alias("kept"), F.col("dropped.projects").alias("dropped"), F.array_join("warnings", ",").alias("warnings"))


@query(r"""with o as (select o_custkey as id, o_orderkey as pos, case o_orderkey % 4 when 0 then ' ' when 1 then null else o_orderpriority end as title, case when o_orderkey % 4 = 1 then 'Lead' end as job, case when o_orderkey % 6 = 0 then '' else o_orderstatus end as company, case o_orderkey % 5 when 0 then 'soon' when 1 then null else year(o_orderdate)::varchar end as dates from orders),
 k as (select *, coalesce(nullif(title, ''), job) as told from o where trim(coalesce(nullif(title, ''), job, '')) <> '' and company <> ''), n as (select id, count(*) as n from o group by 1),
 j as (select id, count(*) as n_jobs, count_if(dates = 'soon') as undated, arg_min(told, pos) as first from k group by 1),
 s as (select id, count(*) as n_schools, string_agg(case when pos % 2 = 0 then 'MSc Data' else 'BSc' end, ',' order by pos) as degrees from (select *, row_number() over (partition by id order by pos) as i from o where pos % 3 > 0) where i <= 15 group by 1), d as (select id, count_if(pos % 3 = 0) as lost from o group by 1)
 select c_custkey as id, case when c_custkey % 4 = 0 then 'Employee' when c_custkey % 4 = 1 then 'First Last' else c_name end as name, case when c_custkey % 5 = 0 then coalesce(first, '') else 'Boss' end as title, case when c_custkey % 3 = 0 then '' else c_custkey::varchar || '@x.org' end as email, case when c_custkey % 7 = 0 then '' else c_phone end as phone, 'Main St ' || c_custkey::varchar as address,
  least(coalesce(n_jobs, 0), 20)::integer as jobs, coalesce(n.n - n_jobs, n.n, 0)::integer as dropped_jobs, coalesce(degrees, '') as degrees, coalesce(lost, 0)::integer as dropped_schools,
  ((c_custkey % 4 = 0)::integer + (c_custkey % 3 = 0)::integer + (c_custkey % 7 = 0)::integer + (c_custkey % 2 = 0)::integer + 1 + coalesce(undated, 0) + (c_custkey % 5 = 0 and first is not null)::integer)::integer as warnings
  from (select *, '+33 (0)' || c_nationkey::varchar as c_phone from (select c_custkey, c_name, c_nationkey from customer)) left join n on n.id = c_custkey left join j on j.id = c_custkey left join s on s.id = c_custkey left join d on d.id = c_custkey""")
def validated_documents(spark, sf_dir):
    """Whole records: names, addresses and numbers that can't be, doubled skills, jobs and schools with missing parts."""
    order, key = F.col("o_orderkey"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    job = F.struct(F.when(order % 4 == 0, " ").when(order % 4 > 1, F.col("o_orderpriority")).alias("title"), F.when(order % 4 == 1, "Lead").alias("jobTitle"), F.when(order % 6 > 0, F.col("o_orderstatus")).otherwise("").alias("company"), none.alias("companyName"), F.when(order % 5 == 0, "soon").when(order % 5 > 1, F.year("o_orderdate").cast("string")).alias("dates"), none.alias("description"))
    school = F.struct(F.when(order % 3 == 0, " ").when(order % 2 == 0, "MSc Data MSc Data").otherwise("BSc").alias("degree"), none.alias("institution"), none.alias("dates"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("c")))), lambda x: x["c"])
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed(job).alias("experience"), listed(school).alias("education"))
    people = table(spark, sf_dir, "customer").join(nested, key == F.col("o_custkey"), "left")
    texts = F.array().cast("array<string>")
    rows = people.select(
        key.alias("id"), F.when(key % 4 > 1, F.col("c_name")).otherwise(" ").alias("name"), F.when(key % 4 == 1, "First").alias("firstName"), F.when(key % 4 == 1, "Last").alias("lastName"), F.when(key % 5 > 0, "Boss").alias("title"), none.alias("summary"),
        F.concat(key.cast("string"), F.when(key % 3 == 0, "@x").otherwise("@x.org")).alias("email"), F.concat(F.when(key % 7 == 0, "call ").otherwise(""), F.lit("+33 (0)"), F.col("c_nationkey").cast("string")).alias("phone"),
        F.concat(F.lit("Main St "), key.cast("string"), F.when(key % 2 == 0, "  Compétences Java").otherwise("")).alias("address"), F.array(F.lit("Été"), F.lit("ETE"), F.lit("SQL")).alias("skills"), texts.alias("languages"), texts.alias("certifications"), "experience", "education",
        F.lit(None).cast("array<struct<name: string, description: string>>").alias("projects"),
    )
    out = D.validated(rows)
    return out.select(
        "id", "name", "title", "email", "phone", "address", F.size("experience").alias("jobs"), F.col("report.dropped_experiences").alias("dropped_jobs"), F.array_join(F.transform("education", lambda e: e["degree"]), ",").alias("degrees"),
        F.col("report.dropped_educations").alias("dropped_schools"), F.size("report.warnings").alias("warnings"),
    )


@query()
def recovered_cert_dates(spark, sf_dir):
    """Certifications listed by customer: names that swallowed the next one, days that slipped, dates in the place of names. A fold, which SQL doesn't express; held against a loop in the tests."""
    n, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    day, hint = (F.col("o_orderkey") % 28 + 1).cast("string"), F.date_format(d, "MM/yyyy")
    name = F.when(n == 0, F.concat("o_orderpriority", F.lit(" "), day, F.lit("/ Next "), "o_orderstatus")).when(n == 1, F.concat(day, F.lit("/ "), "o_orderpriority")).when(n == 2, F.concat(F.lit("mars "), day)).otherwise(F.col("o_orderpriority"))
    date = F.when(n == 2, F.concat(F.lit("Certification: "), "o_orderpriority")).when(n < 5, hint)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("pos"), name.alias("name"), date.alias("date"))
    return D.recover_cert_dates(rows, "profile_id")


@query("""select event_id as doc_id, 0 as pos, cast(json_extract_string(props, '$.k') as bigint) as k, event_type as kind from events""")
def normalise_payload(spark, sf_dir):
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"items": ['), F.expr("concat(left(props, length(props) - 1), ', \"kind\": \"', event_type, '\"}')"), F.lit("]}"))).otherwise(F.concat(F.lit('{"entries": ['), F.expr("concat(left(props, length(props) - 1), ', \"kind\": \"', event_type, '\"}')"), F.lit("]}")))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), payload.alias("payload"))
    return X.normalise_payload(docs, "items array<struct<k: bigint, kind: string>>, entries array<struct<k: bigint, kind: string>>", {"items": ["items", "entries"]})["items"]
