"""Queries on the text and date functions, over documents and over texts put together from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import query
from crewlens.functions import dates as D
from crewlens.functions import similarity as M
from crewlens.functions import text as T
from crewlens.operators import extraction as X
from crewlens.plans.standins import table

_KEY = "trim(regexp_replace(lower(replace(strip_accents({0}), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"select doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as cleaned from documents")
def clean_text(spark, sf_dir):
    """Non-breaking and zero-width spaces are put in and come out again."""
    dirty = F.concat(F.lit("​ "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("﻿"))
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(dirty).alias("cleaned"))


@query("select doc_id, text from documents")
def fix_mojibake(spark, sf_dir):
    """Texts read as Latin-1 by mistake come back as they were."""
    broken = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    return _docs(spark, sf_dir).select("doc_id", T.fix_mojibake(broken).alias("text"))


@query(rf"select doc_id, {_KEY.format('text')} as words, regexp_replace(lower(replace(strip_accents(text), '&', ' and ')), '[^a-z0-9]', '', 'g') as dense, trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')) as punctuated from documents")
def match_key(spark, sf_dir):
    rows = _docs(spark, sf_dir)
    return rows.select("doc_id", *(T.match_key(F.col("text"), m).alias(m) for m in ("words", "dense", "punctuated")))


_DATED = """with d as (select o_orderkey as k, cast(o_orderdate as date) as d, o_orderkey % 8 as form from orders)"""


@query(f"{_DATED} select k, case form when 3 then date_trunc('month', d)::date when 5 then date_trunc('month', d)::date when 6 then date_trunc('year', d)::date when 7 then null else d end as start_date, case form when 3 then last_day(d) when 5 then last_day(d) when 6 then make_date(year(d), 12, 31) when 7 then null else d end as end_date from d")
def parse_dates(spark, sf_dir):
    """Every order's date written in one of eight ways."""
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 8
    month = F.element_at(F.array(*map(F.lit, ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"))), F.month(d))
    text = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd")).when(form == 1, F.date_format(d, "dd/MM/yyyy")).when(form == 2, F.date_format(d, "dd.MM.yy")).when(form == 3, F.date_format(d, "MM/yyyy"))
        .when(form == 4, F.concat_ws(" ", F.day(d).cast("string"), month, F.year(d).cast("string"))).when(form == 5, F.date_format(d, "MMMM yyyy")).when(form == 6, F.date_format(d, "yyyy")).otherwise("soon")
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("t"))
    return rows.select("k", D.parse_date(F.col("t")).alias("start_date"), D.parse_date(F.col("t"), "end").alias("end_date"))


@query(f"{_DATED} select k, date_trunc('month', d)::date as start_date, case when form < 4 then last_day(d) end as end_date, form >= 4 as is_current from d")
def parse_ranges(spark, sf_dir):
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 8
    m = F.date_format(d, "MM/yyyy")
    text = F.when(form < 2, F.concat_ws(" - ", m, m)).when(form < 4, F.concat_ws(" au ", m, m)).when(form < 6, F.concat(F.lit("since "), m)).otherwise(F.concat(m, F.lit(" – présent")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), D.parse_range(text).alias("r")).select("k", "r.*")


@query("select o_orderkey, case o_orderkey % 7 when 0 then 'project_lead' when 1 then 'technical_lead' when 2 then 'contributor' when 4 then 'contributor' when 5 then 'project_lead' when 6 then 'contributor' end as role from orders")
def role_classes(spark, sf_dir):
    """Roles in any order of words, and what names none: architects contribute, sentences have no role, long lists without a stop do."""
    n = F.col("o_orderkey") % 7
    text = (
        F.when(n == 0, F.concat(F.lit("Cheffe de  Projet "), F.col("o_orderpriority"))).when(n == 1, F.concat(F.col("o_orderstatus"), F.lit(" Lead of the technical team")))
        .when(n == 2, F.concat(F.lit("Software architect "), F.col("o_orderpriority"))).when(n == 3, F.concat(F.lit("He wrote the code and tested all of it. "), F.col("o_orderstatus")))
        .when(n == 4, F.repeat(F.lit("word "), F.lit(14))).when(n == 5, F.lit("project and delivery lead")).otherwise("Main contributor who wrote it all. And more!")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.role_class(text).alias("role"))


@query(r"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;\n]+'), lambda x: trim(x)), lambda x: x <> '') as parts from documents),
 q as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from p), h as (select *, sum(case when i = 1 or not regexp_matches(part, '^[a-z]') then 1 else 0 end) over (partition by doc_id order by i) as head from q),
 g as (select doc_id, head, string_agg(part, ' ' order by i) as clause from h group by 1, 2), u as (select distinct doc_id, clause from g)
 select d.doc_id, count(clause) as n, coalesce(sum(length(clause)), 0)::bigint as chars from documents d left join u on d.doc_id = u.doc_id group by 1""")
def narrative_rules(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", T.clauses(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(r"select doc_id, trim(regexp_replace(text, '(?is)\b(?:this|from|avec)\b.*$', '')) as head from documents")
def section_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_at_marker(F.col("text"), ["this", "from", "avec"]).alias("head"))


@query(r"""with e as (select doc_id, case when doc_id % 2 = 0 then 'Unknown Degree' else lang end as degree, nullif(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '') as institution from documents)
 select * from e where not (degree = 'Unknown Degree' and (institution is null or length(institution) > 180 or (len(regexp_split_to_array(institution, '\s+')) > 18 and regexp_matches(lower(institution), 'incident|maintenance|sur site|distance|reporting|analyse|diagnostique|r[ée]seaux'))))""")
def education_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("lang")).otherwise(" ").alias("degree"), F.col("text").alias("institution"))
    return X.clean_education(rows)


@query("select p_partkey, case when p_partkey % 3 = 2 then null else p_name end as name from part")
def cert_name_rules(spark, sf_dir):
    n = F.col("p_partkey") % 3
    text = F.when(n == 0, F.concat(F.lit("Certification: "), F.col("p_name"))).when(n == 1, F.col("p_name")).otherwise("12 March 2020")
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_cert_name(text).alias("name"))


@query("""with d as (select *, lpad((o_orderkey % 28 + 1)::varchar, 2, '0') as day from orders)
 select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then day || '/' || strftime(o_orderdate, '%m/%Y') when 2 then day || '/' || strftime(o_orderdate, '%m/%Y') when 3 then day || ' ' || strftime(o_orderdate, '%B %Y') else day || ', ' || year(o_orderdate)::varchar end as obtained from d""")
def cert_date_hints(spark, sf_dir):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 5
    hint = F.when(n == 0, F.date_format(d, "dd/MM/yyyy")).when(n == 1, F.date_format(d, "M/yyyy")).when(n == 2, F.date_format(d, "yyyy-MM")).when(n == 3, F.date_format(d, "MMMM yyyy")).otherwise(F.concat(F.lit("in about "), F.year(d).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.merge_day_hint((F.col("o_orderkey") % 28 + 1).cast("string"), hint).alias("obtained"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_name end as first, case when p_partkey % 2 = 0 then p_brand end as second, case when p_partkey % 2 = 0 then lpad((p_size % 28 + 1)::varchar, 2, '0') end as day from part")
def cert_split_names(spark, sf_dir):
    day = (F.col("p_size") % 28 + 1).cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), day, F.lit(" / Certifications: "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.split_cert_names(text).alias("c")).select("p_partkey", "c.*")


@query("""with w as (select p_partkey, lower(split_part(p_name, ' ', 2)) || case p_partkey % 6 when 0 then 's' when 1 then 'ing' when 2 then 'ies' when 3 then 'ed.' when 4 then 'es' else '' end as w from part)
 select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform([w, case when w like '%ies' and length(w) > 4 then left(w, length(w) - 3) || 'y' end, case when w like '%es' and length(w) > 3 then left(w, length(w) - 2) end, case when length(w) <= 3 then null when w like '%s' then left(w, length(w) - 1) else w || 's' end,
  case when w like '%ing' and length(w) > 5 then left(w, length(w) - 3) end, case when w like '%ed' and length(w) > 4 then left(w, length(w) - 2) end], lambda x: trim(x, '-_. ')), lambda x: length(x) >= 3))), ',') as forms from w""")
def token_variants(spark, sf_dir):
    n = F.col("p_partkey") % 6
    ending = F.when(n == 0, "s").when(n == 1, "ing").when(n == 2, "ies").when(n == 3, "ed.").when(n == 4, "es").otherwise("")
    word = F.concat(F.get(F.split("p_name", " "), F.lit(1)), ending)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.token_variants(word)), ",").alias("forms"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split({_KEY.format('text')}, ' '), lambda w: length(w) >= 3 and w not in ({_STOP})))), ' ') as words from conversations")
def query_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(T.tokens(F.col("text"))), " ").alias("words"))


@query(r"""with w as (select doc_id, lang, regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g') as key, unnest(case lang when 'en' then ['theries', 'thery', 'theri', 'therie'] when 'fr' then ['des'] when 'es' then ['ands', 'and'] else ['unding', 'und', 'undings'] end) as form from documents)
 select doc_id, lang, bool_or(regexp_matches(key, '(^|[^\p{L}\p{N}_])' || form || case when length(form) >= 4 then '[a-z0-9]*' else '' end || '($|[^\p{L}\p{N}_])')) as hit from w group by 1, 2""")
def contains_word(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    word = F.when(F.col("lang") == "en", "theries").when(F.col("lang") == "fr", "des").when(F.col("lang") == "es", "ands").otherwise("unding")
    return rows.select("doc_id", "lang", T.contains_word(F.col("text"), word).alias("hit"))


@query("select o_orderkey, case when o_orderkey % 3 < 2 then cast(o_orderkey % 20 as integer) end as years from orders")
def min_years(spark, sf_dir):
    n, k = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 20).cast("string")
    text = F.when(n == 0, F.concat(F.lit("who has "), k, F.lit("+ years of experience"))).when(n == 1, F.concat(F.lit("Experience: "), k, F.lit(" ans"))).otherwise(F.concat(k, F.lit(" years old")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.min_years(text).alias("years"))


@query(f"select conv_id, turn, list_has_any(string_split({_KEY.format('text')}, ' '), ['he', 'she', 'they', 'them', 'his', 'her', 'their', 'theirs', 'him', 'hers', 'other', 'another', 'else', 'same', 'former', 'latter', 'that', 'this']) as refers from conversations")
def needs_reference(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.needs_reference(F.col("text")).alias("refers"))


@query("""with t as (select p_partkey, p_name as a, p_type || ' ' || p_name as b from part)
 select p_partkey, case when greatest(length(a), length(b)) = 0 then 1.0 else round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) end as lev, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 9) as jac,
 round(list_sum(list_transform(list_distinct(u), lambda v: least(len(list_filter(u, lambda x: x = v)), len(list_filter(w, lambda x: x = v))))) / greatest(len(u), len(w)), 9) as layout
 from (select *, list_transform(string_split(a, ' '), lambda x: length(x)) as u, list_transform(string_split(b, ' '), lambda x: length(x)) as w from t) l""")
def similarity_functions(spark, sf_dir):
    a, b = F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")
    widths = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(M.lev_sim(a, b), 9).alias("lev"), F.round(M.jaccard(F.split(a, " "), F.split(b, " ")), 9).alias("jac"), F.round(M.layout_overlap(widths(a), widths(b)), 9).alias("layout"))


@query()
def sequence_ratio(spark, sf_dir):
    """The ratio of neighbouring pages' hosts: blocked by page."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return urls.select("page_id", F.round(M.seq_ratio("host", "title"), 6).alias("ratio"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then s_name else 'other' end as entries from supplier")
def first_array(spark, sf_dir):
    n = F.col("s_suppkey") % 3
    found = T.first_array(F.when(n == 0, F.expr("cast(array() as array<string>)")), F.when(n == 1, F.array("s_name")), F.array(F.lit("other")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(found, ",").alias("entries"))


@query("select p_partkey, p_brand || '|' || p_type as skills from part")
def skill_sanitise(spark, sf_dir):
    dirty = F.array(F.concat(F.lit("• "), "p_brand"), F.lower("p_brand"), F.lit("01/02/2020"), F.lit("and so on, etc."), "p_type", F.repeat(F.col("p_name"), F.lit(9)), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.clean_skills(dirty), "|").alias("skills"))


@query("select p_partkey, case when length(replace(p_name, ' ', '')) >= 4 then replace(p_name, ' ', '') else p_name end as joined from part")
def despace(spark, sf_dir):
    spaced = F.array_join(F.split(F.replace("p_name", F.lit(" ")), ""), " ")
    return table(spark, sf_dir, "part").select("p_partkey", T.despace(spaced).alias("joined"))


@query("select p_partkey, p_name as once, p_name || ' ' || p_type as kept from part")
def collapse_repeats(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.collapse_repeats(F.concat_ws(" ", "p_name", F.upper("p_name"))).alias("once"), T.collapse_repeats(F.concat_ws(" ", "p_name", "p_type")).alias("kept"))


@query(r"select doc_id, case when length(trim(text)) <= 80 then trim(text) else regexp_replace(left(trim(text), 80), '\s+\S*$', '') || '…' end as short from documents")
def cap_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.cap_text(F.concat(F.lit("\x01"), "text"), 80).alias("short"))


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))


@query(r"select doc_id, case when len(regexp_split_to_array(trim(text), '\s+')) > 8 then array_to_string(regexp_split_to_array(trim(text), '\s+')[1:8], ' ') || '…' else array_to_string(regexp_split_to_array(trim(text), '\s+'), ' ') end as title from documents")
def fallback_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fallback_title(F.lit(" "), F.col("text")).alias("title"))


@query("select o_orderkey, case o_orderkey % 4 when 3 then date '2020-01-01' else cast(o_orderdate as date) end as date from orders")
def reference_dates(spark, sf_dir):
    n, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    data = F.when(n == 1, F.concat(F.lit('{"assignment_date": "'), d.cast("string"), F.lit('"}'))).when(n == 2, F.concat(F.lit('{"assignmentDate": "'), d.cast("string"), F.lit('"}'))).otherwise("{}")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.reference_date(F.when(n == 0, d), data, F.lit("2020-01-01").cast("date")).alias("date"))
