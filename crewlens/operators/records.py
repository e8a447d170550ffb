"""Nested records of people: a new parse merged over an old document, entries checked by kind, certification dates moved to their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from crewlens.functions import text as T

CERT = "struct<name: string, issuer: string, issue_date: string, date_obtained: string, expiration: string, credential_id: string, is_uploaded: boolean>"
_CERT_FIELDS = ("issuer", "issue_date", "date_obtained", "expiration", "credential_id")


def _blank_free(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def plain_key(text: Column) -> Column:
    """Accents off, lower case, trimmed; other marks stay."""
    return F.trim(F.lower(T.strip_accents(F.coalesce(text, F.lit("")))))


def distinct_texts(values: Column) -> Column:
    """Trimmed texts that aren't blank, the first spelling of those that differ by case or accents only."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    same = lambda done, v: F.exists(done, lambda d: plain_key(d) == plain_key(v))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda done, v: F.when(same(done, v), done).otherwise(F.concat(done, F.array(v))))


def merged_cert_arrays(old: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """``key`` and certifications: an old document's proven entries, then the parsed ones, one for each name.

    Of equal names (by ``plain_key``) the first entry that has a field gives it; upload
    marks are or-ed, and a parse proves nothing. A missing issue date is the date
    obtained, which is left out where both are equal. Both: ``key``, certifications (array of CERT).
    """
    entry = lambda df, source: df.select(key, F.posexplode("certifications").alias("pos", "c")).select(key, F.lit(source).alias("source"), "pos", "c.*")
    proven = entry(old, 0).where("is_uploaded")
    rows = proven.unionByName(entry(parsed, 1).withColumn("is_uploaded", F.lit(False))).withColumn("name", _blank_free(F.col("name"))).where("name is not null")
    issued, obtained = F.coalesce(_blank_free(F.col("issue_date")), _blank_free(F.col("date_obtained"))), _blank_free(F.col("date_obtained"))
    rows = rows.withColumns({"date_obtained": F.when(obtained != issued, obtained), "issue_date": issued})
    order = F.struct("source", "pos")
    first = lambda c: F.min(F.when(_blank_free(F.col(c)).isNotNull(), F.struct("source", "pos", _blank_free(F.col(c)).alias("v"))))["v"].alias(c)
    one = rows.groupBy(key, plain_key(F.col("name")).alias("same")).agg(F.min(order).alias("first"), first("name"), *map(first, _CERT_FIELDS), F.bool_or("is_uploaded").alias("is_uploaded"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.struct("name", *_CERT_FIELDS, "is_uploaded").alias("c"))))
    return one.groupBy(key).agg(F.transform(listed, lambda x: x["c"]).alias("certifications"))


def save_documents(old: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Documents after a new parse: its fields, distinct skills and merged certifications over the old document, whose other fields stay.

    The name is the parse's first and last, or Unknown; experience_years stays, 0
    where there was none. Documents without a parse stay as they are; new ones are added. old: ``key``,
    name, skills, certifications, experience_years and others; parsed: ``key``,
    first_name, last_name, skills, certifications and any of the others.
    """
    over = parsed.select(key, F.lit(True).alias("parsed now"), *(F.col(c).alias(f"new {c}") for c in parsed.columns if c not in (key, "certifications")))
    certs = merged_cert_arrays(old.join(parsed.select(key), key, "left_semi"), parsed, key).withColumnRenamed("certifications", "new certifications")
    both = old.join(over, key, "full_outer").join(certs, key, "left")
    now = F.coalesce("parsed now", F.lit(False))
    fields = {
        "name": F.coalesce(_blank_free(F.concat_ws(" ", _blank_free(F.col("new first_name")), _blank_free(F.col("new last_name")))), F.lit("Unknown")),
        "skills": distinct_texts(F.col("new skills")),
        "certifications": F.coalesce("new certifications", F.array().cast(f"array<{CERT}>")),
        "experience_years": F.coalesce("experience_years", F.lit(0)),
    }
    new = lambda c: fields.get(c, F.col(f"new {c}") if c in parsed.columns else F.col(c))
    return both.select(key, *(F.when(now, new(c)).otherwise(F.col(c)).alias(c) for c in old.columns if c != key))


#: How long texts of a kind may be, and how many entries of a kind a record may have.
NAME, FIELD, SUMMARY, DESCRIPTION, SKILL, LANGUAGE = 80, 300, 2000, 1500, 100, 50
CAPS = {"experience": 20, "education": 15, "certifications": 10, "projects": 10, "skills": 15, "languages": 20}
_SECTION = r"(?i)\s+(?:Exp[eé]riences?|Formation|Certifications?|Comp[eé]tences?|Skills|Education|Projects?|P[eé]riode|Organisme|Fonction\s+occup|Professional\s+experience|Work\s+experience)"
EXPERIENCE = "array<struct<title: string, jobTitle: string, company: string, companyName: string, dates: string, description: string>>"
EDUCATION = "array<struct<degree: string, institution: string, dates: string>>"


def safe_text(text: Column, most: int = FIELD) -> Column:
    """Trimmed, without control characters; longer texts are cut at their last space, with an ellipsis. Null is empty."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*\z", ""), F.lit("…"))).otherwise(t)


def safe_list(values: Column, most: int, cap: int) -> Column:
    """The first entries that aren't blank, each a safe text."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    return F.slice(F.transform(kept, lambda v: safe_text(v, most)), 1, cap)


def _undoubled(degree: Column) -> Column:
    """A degree that is the same two words or more twice becomes one of them."""
    words = F.filter(F.split(degree, r"\s+"), lambda w: w != "")
    half = F.floor(F.size(words) / 2).cast("int")
    return F.when((half >= 2) & (F.slice(words, 1, F.greatest(half, F.lit(1))) == F.slice(words, half + 1, F.size(words))), F.array_join(F.slice(words, 1, F.greatest(half, F.lit(1))), " ")).otherwise(degree)


def validated(df: DataFrame, totals: Observation | None = None) -> DataFrame:
    """Records made safe, with a report: warnings, how many jobs and schools were dropped, and which fields have a default.

    Columns: name, firstName, lastName, title, summary, email, phone, address
    (strings), skills, languages, certifications (arrays of strings), experience
    (EXPERIENCE), education (EDUCATION), projects (array of structs with description); others stay. Addresses
    and numbers that can't be are emptied; a job needs a title and a company, a school
    a degree or a name; a record without a name is Employee, one without a title takes
    its first job's. ``totals``, if given, observes the sums of the reports as the table is written.
    """
    first, last = safe_text(F.col("firstName"), 40), safe_text(F.col("lastName"), 40)
    named = F.coalesce(F.nullif(safe_text(F.col("name"), NAME), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit("")))
    email, phone, address = (safe_text(F.col(c)) for c in ("email", "phone", "address"))
    bad_email, bad_phone = (email != "") & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), (phone != "") & ~phone.rlike(r"^[0-9\s+()\-./]+$")
    cut = F.trim(F.regexp_extract(address, rf"(?s)^(.*?)(?:{_SECTION}.*)?$", 1))
    skills, languages = safe_list(F.col("skills"), SKILL, CAPS["skills"]), safe_list(F.col("languages"), LANGUAGE, CAPS["languages"])
    jobs, schools = F.coalesce("experience", F.array().cast(EXPERIENCE)), F.coalesce("education", F.array().cast(EDUCATION))
    either = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    kept_jobs = F.filter(jobs, lambda e: (safe_text(either(e["title"], e["jobTitle"])) != "") & (safe_text(either(e["company"], e["companyName"])) != ""))
    undated = F.filter(kept_jobs, lambda e: (safe_text(e["dates"]) != "") & ~safe_text(e["dates"]).rlike("[0-9]"))
    kept_schools = F.filter(schools, lambda e: (safe_text(e["degree"]) != "") | (safe_text(e["institution"]) != ""))
    told_schools = F.transform(kept_schools, lambda e: e.withField("degree", _undoubled(safe_text(e["degree"]))))
    top_jobs = F.slice(kept_jobs, 1, CAPS["experience"])
    derived = F.when(safe_text(F.col("title")) == "", F.nullif(F.trim(either(F.get(top_jobs, F.lit(0))["title"], F.get(top_jobs, F.lit(0))["jobTitle"])), F.lit("")))
    removed = lambda label, a: F.when(F.size(distinct_texts(a)) < F.size(a), F.concat(F.lit("Removed "), (F.size(a) - F.size(distinct_texts(a))).cast("string"), F.lit(f" duplicate {label}(s)")))
    quoted = lambda label, c: F.concat(F.lit(f"{label}: '"), c, F.lit("'"))
    warnings = F.array_compact(
        F.concat(
            F.array(
                F.when(named.isNull(), F.lit("No usable name — defaulting to 'Employee'")), F.when(bad_email, quoted("Discarding invalid email", email)), F.when(bad_phone, quoted("Discarding invalid phone", phone)),
                F.when(cut != F.trim(address), F.lit("Address had section-header artifacts — truncated")), removed("skill", skills), removed("language", languages),
            ),
            F.transform(undated, lambda e: quoted("Experience: Date string contains no digits", safe_text(e["dates"]))),
            F.array(F.when(derived.isNotNull(), quoted("Derived title from first experience", derived))),
        )
    )
    report = F.struct(
        warnings.alias("warnings"), (F.size(jobs) - F.size(kept_jobs)).alias("dropped_experiences"), (F.size(schools) - F.size(kept_schools)).alias("dropped_educations"),
        F.when(named.isNull(), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("fields_defaulted"),
    )
    certs = F.filter(F.coalesce("certifications", F.array().cast("array<string>")), lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    projects = F.transform(F.filter("projects", lambda p: p.isNotNull()), lambda p: p.withField("description", F.when(F.coalesce(p["description"], F.lit("")) != "", safe_text(p["description"], DESCRIPTION)).otherwise(p["description"])))
    clean = {
        "name": F.coalesce(named, F.lit("Employee")), "firstName": first, "lastName": last, "title": F.coalesce(F.when(derived.isNotNull(), safe_text(derived)), safe_text(F.col("title"))), "summary": safe_text(F.col("summary"), SUMMARY),
        "email": F.when(bad_email, "").otherwise(email), "phone": F.when(bad_phone, "").otherwise(phone), "address": cut, "skills": distinct_texts(skills), "languages": distinct_texts(languages),
        "experience": top_jobs, "education": F.slice(told_schools, 1, CAPS["education"]), "certifications": F.slice(certs, 1, CAPS["certifications"]), "projects": F.slice(F.coalesce(projects, F.array().cast(df.schema["projects"].dataType)), 1, CAPS["projects"]),
    }
    out = df.select(*(clean.get(c, F.col(c)).alias(c) for c in df.columns), report.alias("report"))
    if totals is None:
        return out
    return out.observe(totals, F.count(F.lit(1)).alias("records"), F.sum(F.size("report.warnings")).alias("warnings"), F.sum("report.dropped_experiences").alias("dropped_experiences"), F.sum("report.dropped_educations").alias("dropped_educations"), F.sum(F.size("report.fields_defaulted")).alias("defaulted"))


def _month(hint: Column) -> Column:
    """Year and month of MM/YYYY or YYYY/MM, blanks apart, as one number; null for all else."""
    h = F.regexp_replace(hint, r"\s+", "")
    part = lambda pattern, i: F.regexp_extract(h, pattern, i).try_cast("int")
    first, last = r"^([0-9]{1,2})[/-]((?:19|20)[0-9]{2})$", r"^((?:19|20)[0-9]{2})[/-]([0-9]{1,2})$"
    year, month = F.coalesce(part(first, 2), part(last, 1)), F.coalesce(part(first, 1), part(last, 2))
    return F.when(month.between(1, 12), year * 12 + month)


def _has_month(hint: Column) -> Column:
    return F.regexp_replace(hint, r"\s+", "").rlike(r"^(?:[0-9]{1,2}[/-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/-][0-9]{1,2})$")


def cert_tokens(rows: DataFrame, key: str) -> DataFrame:
    """The one or two certifications of each listed entry: ``key``, pos, part, name, hint (of a date), day and tail (the second of two).

    Where the name is a date and the date a name, they change places. Two names with a
    day and a slash between them are two; a leading day and slash are no part of a name.
    Entries without a name give none. Columns are made step by step, so that each is computed once.
    """
    blank, bare = F.lit(""), lambda c: F.lower(F.trim(F.regexp_replace(T.strip_accents(c), r"\.", "")))
    dated = rf"^{T.MONTH_SHORT}\s+[0-9]{{1,2}}(?:,\s*[0-9]{{4}})?$|^[0-9]{{1,2}}\s+{T.MONTH_SHORT}(?:\s+[0-9]{{4}})?$"
    is_name = lambda c: F.col(c).rlike(T.LETTER) & ~bare(F.col(c)).rlike(dated)
    t = rows.select(key, "pos", F.coalesce(T.clean_text(F.col("name")), blank).alias("raw"), F.coalesce(T.clean_text(F.col("date")), blank).alias("hint"))
    t = t.withColumn("raw", T.label_off(F.col("raw"))).withColumn("other", T.label_off(F.col("hint")))
    t = t.withColumn("swap", bare(F.col("raw")).rlike(dated) & is_name("hint") & (F.col("other") != ""))
    t = t.select(key, "pos", F.when(F.col("swap"), F.col("other")).otherwise(F.col("raw")).alias("told"), F.when(F.col("swap"), F.col("raw")).otherwise(F.col("hint")).alias("hint")).where("told != ''")
    two, lead = rf"^(.+?)([0-9]{{1,2}})\s*/\s*({T.LETTER}.+)$", r"^([0-9]{1,2})\s*/\s*(.+)$"
    part = lambda pattern, i: F.regexp_extract("told", pattern, i)
    t = t.select("*", T.label_off(part(two, 1)).alias("a"), part(two, 2).alias("a_day"), T.label_off(part(two, 3)).alias("b"), part(lead, 1).alias("l_day"), T.label_off(part(lead, 2)).alias("rest"))
    none = F.lit(None).cast("string")
    token = lambda n, h, d, tail: F.struct(n.alias("name"), h.alias("hint"), d.alias("day"), F.lit(tail).alias("tail"))
    tokens = (
        F.when(is_name("a") & is_name("b"), F.array(token(F.col("a"), F.col("hint"), F.lpad("a_day", 2, "0"), False), token(F.col("b"), blank, none, True)))
        .when(F.col("rest") != "", F.array(token(F.col("rest"), F.col("hint"), F.lpad("l_day", 2, "0"), False)))
        .otherwise(F.array(token(F.col("told"), F.col("hint"), none, False)))
    )
    t = t.select(key, "pos", F.posexplode(tokens).alias("part", "t")).select(key, "pos", "part", "t.*").withColumn("name", T.label_off(F.col("name")))
    return t.withColumn("clean", F.when(is_name("name"), F.col("name")))


def recover_cert_dates(rows: DataFrame, key: str) -> DataFrame:
    """``key``, place, name and date_obtained of each document's certifications, in order, with dates that slipped to the next entry moved back.

    A fold over a document's tokens: the second of two names in one entry borrows the
    next one's date and leading day; another without a day takes the next one's where
    both have the same month. A day moves once, and a token whose day and month were taken by
    the one before has no date. Names that can't be are left out. rows: ``key``, pos, name, date.
    """
    w = Window.partitionBy(key).orderBy("pos", "part")
    t = cert_tokens(rows, key).withColumn("month", _month(F.col("hint")))
    t = t.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("day", "hint", "month")))
    lent = F.col("tail") & (F.col("hint") == "") & (F.coalesce("next_hint", F.lit("")) != "")
    t = t.withColumn("month", F.when(lent, F.col("next_month")).otherwise(F.col("month"))).withColumn("hint", F.when(lent, F.col("next_hint")).otherwise(F.col("hint")))
    borrows = F.col("tail") & F.col("next_day").isNotNull()
    may = ~borrows & F.col("next_day").isNotNull() & F.coalesce(F.col("month") == F.col("next_month"), F.lit(False))
    t = t.withColumn("borrows", borrows).withColumn("may", may)
    # What depends on the token before: whether its own day is gone. The fold carries two marks.
    docs = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "part", "clean", "hint", "day", "next_day", "borrows", "may"))).alias("tokens"))
    marks = "array<struct<taken: boolean, consumed: boolean, moved: boolean>>"

    def step(state: Column, x: Column) -> Column:
        moved = x["may"] & (x["day"].isNull() | state["taken"])
        now = F.struct(state["taken"].alias("taken"), state["consumed"].alias("consumed"), moved.alias("moved"))
        usable = x["clean"].isNotNull()
        return F.struct(F.concat(state["done"], F.array(now)).alias("done"), (usable & (x["borrows"] | moved)).alias("taken"), (usable & moved).alias("consumed"))

    start = F.struct(F.array().cast(marks).alias("done"), F.lit(False).alias("taken"), F.lit(False).alias("consumed"))
    folded = docs.select(key, F.explode(F.arrays_zip("tokens", F.aggregate("tokens", start, step, lambda s: s["done"]).alias("marks"))).alias("x")).select(key, "x.tokens.*", "x.marks.*").where("clean is not null")
    last = F.when(F.col("borrows") | F.col("moved"), F.col("next_day")).when(~F.col("taken"), F.col("day"))
    folded = folded.withColumn("last", last)
    date = F.when(F.col("consumed") & _has_month(F.col("hint")), "").when(F.col("last").isNotNull(), T.merge_day_hint(F.col("last"), F.col("hint"))).otherwise(F.col("hint"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("pos", "part")) - 1
    return folded.select(key, order.alias("place"), F.col("clean").alias("name"), F.nullif(date, F.lit("")).alias("date_obtained"))
