"""Nested records against plain versions and hand-made rows."""

import random
import re
import unicodedata

from pyspark.sql import Observation
from pyspark.sql import functions as F

from crewlens.operators import records as R


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


LABEL = re.compile(r"^(?:date\s*d['’]?\s*obtention|date\s*obtention|certifications?)\b\s*[:\-]?\s*", re.I)
MONTHS = "jan|janv|feb|fev|mar|mars|apr|avr|may|mai|jun|juin|jul|juil|aug|aout|sep|sept|oct|nov|dec"


def clean(x):
    return re.sub(r"\s+", " ", x or "").strip()


def named(x):
    return LABEL.sub("", clean(x)).strip()


def usable(x):
    c = bare(clean(x)).replace(".", "").strip().lower()
    return bool(re.search("[A-Za-zÀ-ɏ]", clean(x))) and not re.match(rf"^(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?$|^\d{{1,2}}\s+(?:{MONTHS})(?:\s+\d{{4}})?$", c)


def month(h):
    h = re.sub(r"\s+", "", clean(h))
    m = re.match(r"^(\d{1,2})[/-]((?:19|20)\d{2})$", h) or re.match(r"^((?:19|20)\d{2})[/-](\d{1,2})$", h)
    if not m:
        return None
    a, b = m.groups()
    y, mo = (int(b), int(a)) if len(b) == 4 else (int(a), int(b))
    return (y, mo) if 1 <= mo <= 12 else (y, -1)


def merged(day, hint):
    h, packed = clean(hint), re.sub(r"\s+", "", clean(hint))
    if not h:
        return ""
    if re.match(r"^\d{1,2}[/-]\d{1,2}[/-](19|20)\d{2}$", packed) or re.match(r"^(19|20)\d{2}[/-]\d{1,2}[/-]\d{1,2}$", packed):
        return h
    if m := re.match(r"^(\d{1,2})[/-](\d{4})$", h):
        return f"{day}/{m[1].zfill(2)}/{m[2]}"
    if m := re.match(r"^(\d{4})[/-](\d{1,2})$", h):
        return f"{day}/{m[2].zfill(2)}/{m[1]}"
    if m := re.match(r"^([A-Za-zÀ-ɏ]+)\s+(\d{4})$", h):
        return f"{day} {m[1]} {m[2]}"
    m = re.search(r"(19|20)\d{2}", h)
    return f"{day}, {m[0]}" if m else day


def plain_dates(entries):
    tokens = []
    for name, date in entries:
        n, h = named(name), clean(date)
        c = bare(n).replace(".", "").strip().lower()
        if re.match(rf"^(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?$|^\d{{1,2}}\s+(?:{MONTHS})(?:\s+\d{{4}})?$", c) and usable(h) and named(h):
            n, h = named(h), n
        if not n:
            continue
        m = re.match(r"^(.+?)(\d{1,2})\s*/\s*([A-Za-zÀ-ɏ].+)$", n)
        if m and usable(named(m[1])) and usable(named(m[3])):
            tokens += [[named(m[1]), h, m[2].zfill(2), False, False], [named(m[3]), "", None, True, False]]
            continue
        m = re.match(r"^(\d{1,2})\s*/\s*(.+)$", n)
        tokens.append([named(m[2]), h, m[1].zfill(2), False, False] if m and named(m[2]) else [n, h, None, False, False])
    out = []
    for i, t in enumerate(tokens):
        if not usable(t[0]):
            continue
        hint, day, after = t[1], t[2], tokens[i + 1] if i + 1 < len(tokens) else None
        if t[3] and after:
            hint = hint or after[1]
            if not day and after[2]:
                day, after[2] = after[2], None
        if not day and hint and after and after[2] and month(hint) and month(hint) == month(after[1]) and month(hint)[1] > 0:
            day, after[2], after[4] = after[2], None, True
        date = merged(day, hint) if day else hint
        if t[4] and not t[2] and month(hint):
            date = ""
        out.append((t[0], date or None))
    return out


def test_recovered_dates(spark):
    cases = [
        [("Cisco 23/ CyberOps", "05/2021"), ("14/ Linux Pro", "06/2021")], [("AWS", "05/2021"), ("23/ CyberOps", "05/2021"), ("Scrum", "2020-01")], [("AWS", "05/2021"), ("23/ CyberOps", "5/2021"), ("7/ Scrum", "05/2021")],
        [("mars 12, 2020", "Scrum Master"), ("12 mars", None), ("Certification: PMP", "2021-03")], [("A 3/ B", ""), ("C", "03/2020")], [("A 3/ B", ""), ("9/ C", "mars 2020"), ("4/ D", "13/2020")], [("12/ ", "05/2020"), ("", "x"), (None, None)],
    ]
    rng = random.Random(3)
    names = ["AWS", "9/ Linux", "Cisco 23/ CyberOps", "12 mars", "Certifications: PMP", "14/ Scrum", "Réseaux 4/Été", " ", "2020"]
    dates = ["05/2021", "5/2021", "2021-05", "mars 2021", "", None, "01/02/2020", "about 2019", "13/2020", "2021/5"]
    cases += [[(rng.choice(names), rng.choice(dates)) for _ in range(rng.randrange(1, 7))] for _ in range(150)]
    rows = [(d, i, n, t) for d, entries in enumerate(cases) for i, (n, t) in enumerate(entries)]
    got = {}
    for r in R.recover_cert_dates(spark.createDataFrame(rows, "doc long, pos long, name string, date string").repartition(3), "doc").orderBy("doc", "place").collect():
        got.setdefault(r.doc, []).append((r.name, r.date_obtained))
    assert got == {d: plain_dates(e) for d, e in enumerate(cases) if plain_dates(e)}
    assert got[0] == [("Cisco", "23/05/2021"), ("CyberOps", "14/06/2021"), ("Linux Pro", "06/2021")] and got[1][:2] == [("AWS", "23/05/2021"), ("CyberOps", None)]


def test_saved_documents(spark):
    cert = lambda name, up=False, **f: (name, *(f.get(k) for k in ("issuer", "issue_date", "date_obtained", "expiration", "credential_id")), up)
    old = spark.createDataFrame([(1, "Ann", ["x"], [cert("Réseau", True, issuer="Cisco", credential_id=" "), cert("Old", False), cert("reseau ", True, credential_id="c7")], 4.0, "kept"), (2, "Bo", ["y"], None, None, "o")], f"id long, name string, skills array<string>, certifications array<{R.CERT}>, experience_years double, other string")
    parsed = spark.createDataFrame([(1, "Ann", " Lee ", ["SQL", "sql ", "Été", "ETE", " "], [cert("RÉSEAU", True, issuer="Other", date_obtained="2020"), cert("New", True, date_obtained="2021", issue_date="2021"), cert(" ")]), (3, None, "", None, None)], f"id long, first_name string, last_name string, skills array<string>, certifications array<{R.CERT}>")
    got = {r.id: r for r in R.save_documents(old, parsed, "id").collect()}
    assert (got[1].name, got[1].skills, got[1].experience_years, got[1].other) == ("Ann Lee", ["SQL", "Été"], 4.0, "kept")
    assert [tuple(c) for c in got[1].certifications] == [cert("Réseau", True, issuer="Cisco", issue_date="2020", credential_id="c7"), cert("New", False, issue_date="2021")]
    assert (got[2].name, got[2].skills, got[2].certifications, got[2].other) == ("Bo", ["y"], None, "o")
    assert (got[3].name, got[3].skills, got[3].certifications, got[3].experience_years, got[3].other) == ("Unknown", [], [], 0.0, None)
    assert R.save_documents(old.where("id > 9"), parsed.where("id > 9"), "id").count() == 0


SCHEMA = f"id long, name string, firstName string, lastName string, title string, summary string, email string, phone string, address string, skills array<string>, languages array<string>, certifications array<string>, experience {R.EXPERIENCE}, education {R.EDUCATION}, projects array<struct<name: string, description: string>>, extra string"


def test_validated(spark):
    job = lambda title=None, company=None, dates=None, other=None, firm=None: (title, other, company, firm, dates, "d")
    rows = [
        (1, " Ann\x01 Lee ", "Ann", None, None, "s " * 1200, "ann@x", "call me", "1 Main St  Skills Java", ["Java", "java", " ", None, "Été", "ete"], None, ["CCNA", " ", None], [job("Dev", "Acme", "soon"), job(None, None), job("", "Bell", None, "Lead"), job("x", " ")], [("MSc Data MSc Data", "MIT", None), (" ", "", "2001"), ("BSc", None, None)], [("p", "z " * 900), None], "e"),
        (2, None, None, " ", "Boss", None, "b@x.org", "+33 (0)6-12", None, None, ["fr"] * 30, [str(i) for i in range(12)], [job("a", "b")] * 25, None, None, None),
    ]
    totals = Observation("totals")
    out = {r.id: r for r in R.validated(spark.createDataFrame(rows, SCHEMA), totals).collect()}
    a, b = out[1], out[2]
    assert (a.name, a.title, a.email, a.phone, a.address, a.skills, a.languages, a.certifications, a.extra) == ("Ann Lee", "Dev", "", "", "1 Main St", ["Java", "Été"], [], ["CCNA"], "e")
    assert len(a.summary) == 2000 and a.summary.endswith("s…") and len(a.projects) == 1 and a.projects[0].description.endswith("z…")
    assert [e.title or e.jobTitle for e in a.experience] == ["Dev", "Lead"] and [e.degree for e in a.education] == ["MSc Data", "BSc"]
    assert a.report.warnings == ["Discarding invalid email: 'ann@x'", "Discarding invalid phone: 'call me'", "Address had section-header artifacts — truncated", "Removed 2 duplicate skill(s)", "Experience: Date string contains no digits: 'soon'", "Derived title from first experience: 'Dev'"]
    assert (a.report.dropped_experiences, a.report.dropped_educations, a.report.fields_defaulted) == (2, 1, [])
    assert (b.name, b.title, b.phone, len(b.experience), len(b.certifications), b.languages, b.report.fields_defaulted) == ("Employee", "Boss", "+33 (0)6-12", 20, 10, ["fr"], ["name"])
    assert totals.get == {"records": 2, "warnings": 8, "dropped_experiences": 2, "dropped_educations": 1, "defaulted": 1}
    assert R.validated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_cut_at_a_space(spark):
    texts = ["a" * 400, "ab " * 200, None, " x\ty ", "w " + "b" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(R.safe_text(F.col("t")).alias("t")).collect()
    cut = lambda s: s if len(s) <= 300 else s[:300].rsplit(" ", 1)[0] + "…"
    assert [r.t for r in rows] == [cut((t or "").strip()) for t in texts]
