"""Field extraction over tables of documents, in column expressions and windows per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.functions import dates as D
from crewlens.functions import text as T

#: Words that tell sheets of a training from attestations of a project.
SHEET_WORDS = ("feuille de presence", "attendance", "participants", "formateur", "trainer", "formation")
ATTESTATION_WORDS = ("attestation", "certifie", "certify", "projet", "project", "client", "marche")
#: Heading words by section, in English, French, Spanish, German, Italian and Portuguese.
SECTIONS = {
    "experience": ("experience", "work experience", "professional experience", "experience professionnelle", "experiencia", "berufserfahrung", "esperienza", "experiencia profissional"),
    "education": ("education", "formation", "educacion", "ausbildung", "istruzione", "formacao", "diplomes"),
    "skills": ("skills", "technical skills", "competences", "competencias", "habilidades", "kenntnisse", "competenze"),
    "certifications": ("certifications", "certificates", "certificats", "certificaciones", "zertifikate", "certificazioni", "certificacoes"),
    "projects": ("projects", "projets", "proyectos", "projekte", "progetti", "projetos"),
    "languages": ("languages", "langues", "idiomas", "sprachen", "lingue"),
    "summary": ("summary", "profile", "profil", "resume", "resumen", "zusammenfassung", "profilo", "resumo"),
    "contact": ("contact", "coordonnees", "contacto", "kontakt", "contatti", "contato"),
    "interests": ("interests", "hobbies", "centres d interet", "intereses", "interessen", "interessi", "interesses"),
    "references": ("references", "referencias", "referenzen", "referenze"),
    "awards": ("awards", "distinctions", "premios", "auszeichnungen", "premi"),
    "publications": ("publications", "publicaciones", "veroffentlichungen", "pubblicazioni", "publicacoes"),
}


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.regexp_count(text, F.lit(rf"\b{w}\b")) for w in words[1:]), F.regexp_count(text, F.lit(rf"\b{words[0]}\b")))


def classify_docs(docs: DataFrame) -> DataFrame:
    """training_sheet where its words are more than those of attestations, else attestation."""
    t = T.match_key(F.col("text"))
    return docs.withColumn("doc_type", F.when(_count(t, SHEET_WORDS) > _count(t, ATTESTATION_WORDS), "training_sheet").otherwise("attestation"))


def labelled(text: Column, labels: list[str]) -> Column:
    """What follows one of the labels and a colon, up to the end of the line."""
    found = F.regexp_extract(text, rf"(?im)^\s*(?:{'|'.join(labels)})\s*[:\-]\s*(\S[^\n]*?)\s*$", 1)
    return F.nullif(found, F.lit(""))


def first_date(text: Column) -> Column:
    """The first date in the text: after a place ("Tunis, le ..."), else D/M/Y, else in words."""
    numeric, words = r"([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})", r"([0-9]{1,2}\s+\p{L}+\s+[0-9]{4})"
    pick = lambda p: D.parse_date(F.nullif(F.regexp_extract(text, p, 1), F.lit("")))
    return F.coalesce(pick(rf"\p{{L}}+,?\s+(?:le|on)\s+{numeric}"), pick(rf"\p{{L}}+,?\s+(?:le|on)\s+{words}"), pick(numeric), pick(words))


def _member_role(text: Column) -> Column:
    """Of an attestation's member: only "chef de projet" leads, the project or its technical side; all else contributes."""
    t = F.lower(text)
    lead = F.contains(t, F.lit("chef de projet"))
    return F.when(lead & ~F.contains(t, F.lit("technique")), "project_lead").when(F.contains(t, F.lit("chef de projet technique")), "technical_lead").otherwise("contributor")


def extract_attestation(docs: DataFrame) -> DataFrame:
    """Project, client, market number, date, whether it is confirmed, team members with roles, and what had to be assumed."""
    text = F.col("text")
    members = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-•]\s*(.+?\s*:\s*.+?)\s*$"), F.lit(1)), lambda m: F.struct(F.trim(F.regexp_extract(m, r"^(.+?)\s*:", 1)).alias("name"), _member_role(F.regexp_extract(m, r":\s*(.+)$", 1)).alias("role")))
    out = docs.select(
        "doc_id",
        labelled(text, ["project", "projet"]).alias("project_name"),
        labelled(text, ["client"]).alias("client_name"),
        labelled(text, ["market", "marché"]).alias("market_number"),
        first_date(text).alias("date"),
        F.lower(text).rlike(r"\b(certif|attest|confirm)").alias("confirmed"),
        members.alias("members"),
    )
    assumed = F.filter(F.array(F.when(F.col("client_name").isNull(), "no client"), F.when(F.col("date").isNull(), "no date"), F.when(F.size("members") == 0, "no members")), lambda x: x.isNotNull())
    return out.withColumn("assumptions", assumed)


def extract_sheet(docs: DataFrame) -> DataFrame:
    """Training, trainer, client, place, date range and distinct participants."""
    text = F.col("text")
    people = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[0-9]+[.)]\s*(.+?)\s*$"), F.lit(1))
    return docs.select(
        "doc_id",
        labelled(text, ["training", "formation"]).alias("training_name"),
        labelled(text, ["trainer", "formateur"]).alias("trainer"),
        labelled(text, ["client"]).alias("client_name"),
        labelled(text, ["place", "lieu"]).alias("place"),
        D.parse_range(labelled(text, ["dates", "date"])).alias("period"),
        F.array_distinct(people).alias("participants"),
    )


#: Issuers known by name.
ISSUERS = ("Cisco", "Microsoft", "Fortinet", "Oracle", "Huawei", "PMI", "CompTIA", "AWS", "Google")


def extract_cert_fields(docs: DataFrame) -> DataFrame:
    """Issuer (label, header, known name), issue and expiry date (label, or "valid for n years"), credential id."""
    text = F.col("text")
    known = F.regexp_extract(text, rf"\b({'|'.join(ISSUERS)})\b", 1)
    issuer = F.coalesce(labelled(text, ["issued by", "issuer", "délivré par"]), F.nullif(F.regexp_extract(text, r"(?m)^\s*((?:University|Institute|Université|Institut)\b[^\n]*)$", 1), F.lit("")), F.nullif(known, F.lit("")))
    issued = D.parse_date(labelled(text, ["issue date", "issued on", "date d'émission"]))
    years = F.nullif(F.regexp_extract(text, r"(?i)valid for\s+([0-9]{1,2})\s+years?", 1), F.lit("")).try_cast("int")
    expiry = F.coalesce(D.parse_date(labelled(text, ["expires", "expiration date", "valid until"]), "end"), F.add_months(issued, years * 12))
    diploma = F.lower(text).rlike(r"\b(diploma|dipl[oô]me)\b")
    credential = F.nullif(F.regexp_extract(text, r"(?i)credential id\s*[:#]?\s*([A-Z0-9][A-Z0-9\-]{4,})", 1), F.lit(""))
    return docs.select("doc_id", issuer.alias("issuer"), issued.alias("issue_date"), F.when(~diploma, expiry).alias("expiration_date"), credential.alias("credential_id"))


def clean_education(df: DataFrame) -> DataFrame:
    """Rows with a default degree and a clean institution; those without a degree whose institution is missing or prose are dropped."""
    rows = df.withColumn("degree", T.clean_degree(F.col("degree"))).withColumn("institution", T.clean_institution(F.col("institution")))
    unknown = F.lower("degree") == "unknown degree"
    return rows.where(~(unknown & (F.col("institution").isNull() | T.is_report(F.col("institution")))))


def clean_lines(text: Column) -> Column:
    """Lines of over 3 characters of which half or more are letters, digits or spaces."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & (F.length(F.regexp_replace(x, r"[^\p{L}\p{N} ]", "")) * 2 >= F.length(x)))


def needs_review(fields: DataFrame, name: str = "certification_name") -> DataFrame:
    """Why extracted fields need another look; routed by ``review``."""
    n = F.lower(F.trim(F.col(name)))
    flags = F.array(
        F.when(F.col(name).isNull() | n.isin("", "unknown", "certificate", "certification"), "name unknown or generic"),
        F.when(F.length(n) > 120, "name suspiciously long"),
        F.when(F.col("issuer").isNull(), "no issuer"),
        F.when(F.col("issue_date").isNull(), "no date"),
    )
    return fields.withColumn("flags", F.filter(flags, lambda f: f.isNotNull())).withColumn("review", F.size("flags") > 0)


def extract_contact(text: Column) -> Column:
    """E-mail, phone (8 to 15 digits, a labelled one first, no dates) and the first line as the name if it is short and has no digits."""
    phone = r"\+?[0-9(][0-9().\- ]{6,}[0-9]"
    fine = lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(8, 15) & ~p.rlike(r"^[0-9]{1,2}[.\-/ ][0-9]{1,2}[.\-/ ][0-9]{4}$")
    labelled_one = F.regexp_extract(text, rf"(?i)(?:phone|tel|mobile|t[ée]l[ée]phone)\.?\s*[:\-]?\s*({phone})", 1)
    first = F.get(F.filter(F.regexp_extract_all(text, F.lit(rf"({phone})"), F.lit(1)), fine), F.lit(0))
    head = F.trim(F.get(F.split(text, "\n"), F.lit(0)))
    return F.struct(
        F.nullif(F.lower(F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0)), F.lit("")).alias("email"),
        F.coalesce(F.when(fine(labelled_one), labelled_one), first).alias("phone"),
        F.when((F.size(F.split(head, r"\s+")) <= 4) & ~head.rlike("[0-9@]") & (head != ""), head).alias("name"),
    )


def _headings(spark) -> DataFrame:
    rows = [(word, section, len(word.split())) for section, words in SECTIONS.items() for word in words]
    return spark.createDataFrame(rows, "heading string, section string, n int").groupBy("heading").agg(F.min("section").alias("section"))


def segment_sections(docs: DataFrame, extra_words: int = 2) -> DataFrame:
    """doc_id, pos, line, and the section each line stands in: the last heading above it.

    A heading is a line that begins with a heading word and has up to
    ``extra_words`` more; the longest heading word wins. The words are a fixed
    list, so they are broadcast.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    words = F.split(T.match_key(F.col("line")), " ")
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size("words"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("words", 1, n), " ").alias("heading"))))
    tried = lines.withColumn("words", words).where(F.size("words") <= 3 + extra_words).select("doc_id", "pos", F.size("words").alias("size"), starts.alias("h")).select("doc_id", "pos", "size", "h.*")
    heads = tried.where(F.col("size") - F.col("n") <= extra_words).join(F.broadcast(_headings(docs.sparkSession)), "heading")
    heads = heads.groupBy("doc_id", "pos").agg(F.max_by("section", "n").alias("head"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(heads, ["doc_id", "pos"], "left").withColumn("section", F.last("head", ignorenulls=True).over(w))
    return rows.select("doc_id", "pos", "line", F.coalesce("section", F.lit("header")).alias("section"), F.col("head").isNotNull().alias("is_heading"))


def section_items(sections: DataFrame, dated: str = r"(?:19|20)[0-9]{2}") -> DataFrame:
    """Entries of sections: a line with a year begins a new one, others join it; skills are cut at commas."""
    rows = sections.where("not is_heading")
    w = Window.partitionBy("doc_id", "section").orderBy("pos")
    rows = rows.withColumn("entry", F.sum(F.when(F.col("line").rlike(dated), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ")
    items = rows.where("section <> 'skills'").groupBy("doc_id", "section", "entry").agg(text.alias("item"))
    skills = rows.where("section = 'skills'").select("doc_id", "section", "pos", F.posexplode(F.split(F.regexp_replace("line", r"^[^:]*:", ""), "[,;]")).alias("i", "item"))
    skills = skills.where(F.trim("item") != "").select("doc_id", "section", (F.col("pos") * 1000 + F.col("i")).cast("long").alias("entry"), F.trim("item").alias("item"))
    return items.select("doc_id", "section", F.col("entry").cast("long").alias("entry"), "item").union(skills)


#: Words that stand in a skills section but are no skill, as ``match_key`` spells them.
NO_SKILL = ("competence", "competences", "skill", "skills", "technology", "technologie", "supplementaire", "additional", "competences supplementaires", "additional skills")


def skill_names(line: Column) -> Column:
    """The skills of a line: what stands before a colon, and what behind it or else in the whole line, cut at commas if all parts have up to four words.

    Without a colon, lines with brackets aren't cut. A category of skills in general is none.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    colon = F.contains(clean, F.lit(":"))
    category = F.when(colon, F.trim(F.regexp_extract(clean, "^([^:]*):", 1)))
    general = F.contains(T.match_key(category), F.lit("competence")) | T.match_key(category).isin("skill", "skills")
    rest = F.when(colon, F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1))).otherwise(clean)
    parts = F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p != "")
    cut = (F.size(parts) > 1) & F.forall(parts, lambda p: F.size(F.split(p, " ")) <= 4) & (colon | ~rest.rlike("[()]"))
    found = F.concat(F.array(F.when(colon & ~general, category)), F.when(cut, parts).otherwise(F.array(rest)))
    return F.filter(found, lambda x: (F.coalesce(x, F.lit("")) != "") & ~T.match_key(x).isin(*NO_SKILL))


def section_skills(sections: DataFrame) -> DataFrame:
    """doc_id, place and skill: the distinct skills of each document's skills section in order, the first spelling of each.

    sections: doc_id, pos, line, section, is_heading.
    """
    rows = sections.where("section = 'skills' and not is_heading").select("doc_id", "pos", F.posexplode(skill_names(F.col("line"))).alias("i", "skill"))
    first = rows.groupBy("doc_id", T.match_key(F.col("skill")).alias("key")).agg(F.min(F.struct("pos", "i", "skill")).alias("s"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("s.pos", "s.i")).alias("place"), "s.skill")


def gap_fill(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """The primary's fields, empty ones filled from the secondary; list values of both, the primary's first."""
    right = secondary.select(F.col(key).alias("of"), *(F.col(c).alias(f"{c} of the other") for c in (*fields, *lists)))
    both = primary.join(right, F.col(key) == F.col("of"), "left")
    empty = F.expr("cast(array() as array<string>)")
    return both.select(
        key,
        *(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(F.col(f"{c} of the other")), F.lit(""))).alias(c) for c in fields),
        *(F.array_union(F.coalesce(c, empty), F.coalesce(F.col(f"{c} of the other"), empty)).alias(c) for c in lists),
    )


#: How many entries of a kind a record may have.
CAPS = {"experience": 20, "education": 15, "certifications": 10, "projects": 10, "skills": 15}


def validate_records(df: DataFrame, lists: list[str]) -> DataFrame:
    """Lists of entries without blanks, cut to their caps, with what was dropped and warnings."""
    kept = {c: F.filter(F.transform(F.col(c), lambda x: F.trim(x)), lambda x: x != "") for c in lists}
    out = df.select(*(c for c in df.columns if c not in lists), *lists)
    report = F.struct(*((F.size(F.col(c)) - F.least(F.size(kept[c]), F.lit(CAPS.get(c, 10)))).alias(c) for c in lists))
    warnings = F.filter(F.array(*(F.when(F.size(kept[c]) == 0, f"no {c}").when(F.size(kept[c]) > CAPS.get(c, 10), f"too many {c}") for c in lists)), lambda w: w.isNotNull())
    out = out.withColumn("dropped", report).withColumn("warnings", warnings)
    for c in lists:
        out = out.withColumn(c, F.slice(kept[c], 1, CAPS.get(c, 10)))
    return out


def normalise_payload(docs: DataFrame, schema: str, sections: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Child tables of parsed JSON records: for each section, the first of its spellings that is there, exploded with positions."""
    parsed = docs.select("doc_id", F.from_json("payload", schema).alias("p"))
    out = {}
    for section, spellings in sections.items():
        entries = T.first_array(*(F.col(f"p.{s}") for s in spellings))
        out[section] = parsed.select("doc_id", F.posexplode(entries).alias("pos", "entry")).select("doc_id", "pos", "entry.*")
    return out
