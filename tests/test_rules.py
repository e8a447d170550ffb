"""Hand-made rows with known answers, and properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crewlens.functions import dates as D
from crewlens.functions import text as T
from crewlens.functions.similarity import lev_sim, seq_ratio
from crewlens.operators import aggregates as A
from crewlens.operators import certifications as C
from crewlens.operators import extraction as X
from crewlens.operators import scoring as S
from crewlens.operators import windows as W
from crewlens.operators.joins import resolve_person, verify_owner

DAY = dt.date(2024, 5, 10)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_item_scores(spark):
    score = lambda s, c, external=False, pending=False: one(spark, S.item_score(F.lit(s).cast("double"), F.lit(c), F.lit(external), F.lit(pending)))
    assert score(16, "high") == 68.0
    assert score(72, "low") == 72.0
    assert score(None, "high") == 0.0
    assert score(16, "high", True, True) == 0.0


def test_certification_pillar(spark):
    rows = [(1, DAY, DAY, True, "active")] * 3 + [(2, None, DAY, True, "active"), (2, DAY, DAY, True, "expired"), (2, DAY, DAY, False, "active")]
    certs = spark.createDataFrame(rows, "profile_id int, issue_date date, uploaded_at date, is_uploaded boolean, status string")
    targets = spark.createDataFrame([(1, 2024, 2), (2, 2024, 0)], "profile_id int, target_year int, certification_target int")
    assert {r.profile_id: r.certification_score for r in S.certification_pillar(certs, targets).collect()} == {1: 100.0, 2: 100.0}
    assert {r.profile_id: r.n_certs for r in S.certification_pillar(certs).collect()} == {1: 3, 2: 1}


def test_weighted_project(spark):
    projects = spark.createDataFrame([(1, "high", "project_lead", True)], "profile_id int, complexity string, role string, verified boolean")
    counts = spark.createDataFrame([(1, 0, 2, 0, 0)], "profile_id int, n_certs int, target int, n_trainings int, n_formations int")
    row = S.weighted_score(projects, counts).first()
    assert row.project_score == 65.62 and row.weighted_score == 22.97


def test_experience(spark):
    jobs = [(1, dt.date(2018, 1, 1), dt.date(2020, 1, 1), False), (1, dt.date(2019, 1, 1), dt.date(2021, 1, 1), False), (2, None, None, False)]
    rows = spark.createDataFrame(jobs, "profile_id int, start_date date, end_date date, is_current boolean")
    assert {r[0]: r[1] for r in W.experience_years(rows, F.lit(DAY)).collect()} == {1: 3, 2: None}


def test_dates(spark):
    parse = lambda t, b="start": one(spark, D.parse_date(F.lit(t), b))
    assert parse("03/2021", "end") == dt.date(2021, 3, 31)
    assert parse("13/02/2020") == dt.date(2020, 2, 13)
    assert parse("02/13/2020") == dt.date(2020, 2, 13)
    assert parse("31/02/2020") is None
    assert parse("présent") is None
    assert parse(None) is None


def test_cert_status_and_alerts(spark):
    ends = [DAY - dt.timedelta(1), DAY, DAY + dt.timedelta(30), DAY + dt.timedelta(31), None]
    rows = spark.createDataFrame([(i, 7, e) for i, e in enumerate(ends)], "cert_id int, profile_id int, expiration_date date")
    got = [r[0] for r in rows.orderBy("cert_id").select(D.cert_status(F.col("expiration_date"), F.lit(DAY))).collect()]
    assert got == ["expired", "expiring_soon", "expiring_soon", "active", "active"]
    ends = [DAY, DAY + dt.timedelta(7), DAY + dt.timedelta(30), DAY - dt.timedelta(7)]
    rows = spark.createDataFrame([(i, 7, e) for i, e in enumerate(ends)], "cert_id int, profile_id int, expiration_date date")
    none = spark.createDataFrame([], "cert_id int, alert_type string")
    alerts = C.expiry_alerts(rows, none, F.lit(DAY))
    assert {r.cert_id: (r.alert_type, r.priority) for r in alerts.collect()} == {0: ("expired", 3), 1: ("expiring_30_days", 3), 2: ("expiring_30_days", 2)}
    assert C.expiry_alerts(rows, alerts, F.lit(DAY)).count() == 0


def test_fragments(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(["Fortinet NSE 4", "Troubleshooting", "CCNA 200-301"])], "k int, pos int, name string")
    assert [r.name for r in W.merge_fragments(rows, "k", "pos", "name").orderBy("pos").collect()] == ["Fortinet NSE 4 Troubleshooting", "CCNA 200-301"]


@pytest.mark.parametrize(("partitions", "by"), [(1, ["y"]), (5, ["y"]), (40, ["y", "team"]), (7, [])])
def test_places_agree_with_a_window(spark, partitions, by):
    """One group holds nine rows in ten; a null is a group; names clash."""
    rows = spark.range(1000).select(F.col("id").alias("profile_id"), (F.col("id") * 37 % 50).cast("double").alias("final_score"), F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 20 > 0, F.col("id") % 3).alias("y"), (F.col("id") % 4).alias("team"), F.lit("x").alias("range"))
    w = Window.partitionBy(*by)
    expected = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("final_score"), "profile_id"))).withColumn("n", F.count("*").over(w))
    got = W.places(rows, by, [F.desc("final_score"), F.asc("profile_id")], "rank", "n", partitions)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, expected.collect())))
    assert W.places(rows.where("profile_id < 0"), by, ["profile_id"]).count() == 0


def test_rank_of_one(spark):
    row = W.rank_scores(spark.createDataFrame([(1, 2.0, 1)], "profile_id int, final_score double, y int"), ["y"]).first()
    assert row["rank"] == 1 and row["rank_percentile"] == 100.0


def test_text_rules(spark):
    assert one(spark, T.despace(F.lit("H I C H E M"))) == "HICHEM"
    assert one(spark, T.match_key(F.lit("Société & Cie, S.A."))) == "societe and cie s a"
    assert one(spark, T.role_class(F.lit("Chef de projet"))) == "project_lead"
    assert one(spark, T.fix_mojibake(F.lit("SociÃ©tÃ©"))) == "Société"
    assert one(spark, T.clean_skills(F.array(F.lit("Java"), F.lit("java"), F.lit("etc."), F.lit("• SQL")))) == ["Java", "SQL"]
    assert one(spark, T.min_years(F.lit("5+ years of experience"))) == 5
    assert one(spark, T.clauses(F.lit("First part. and more; Second. First part"))) == ["First part and more", "Second", "First part"]
    assert one(spark, seq_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_contact(spark):
    text = "Ann Lee\nAnn@Example.org\nborn 12/03/1990\nMobile: +216 22 333 444"
    got = one(spark, X.extract_contact(F.lit(text)))
    assert (got.email, got.phone, got.name) == ("ann@example.org", "+216 22 333 444", "Ann Lee")


def test_owner_scores_against_single_distances(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcde1") for _ in range(rng.randint(1, most)))
    say = lambda sizes, most: " ".join(word(rng.choice(sizes)) for _ in range(rng.randint(0, most)))
    # Long words reach past the windows that are compared first, names of 64 letters past the smallest cells.
    rows = [(i, say([3, 8, 60], 10) if i % 9 else None, say([2, 7, 70], 4) if i % 11 else None) for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, "zz " * 30_000 + "anm le", "Ann Lee"), (121, "z" * 300_000, "Ann Zoe")], "id int, text string, name string")
    pairs = []
    for i, text, name in rows:
        w, n, said = (text or "").split(), (name or "").split(), " ".join(name.split()) if name else ""
        forms = [said, " ".join(n[::-1])]
        windows = {" ".join(w[at : at + k]) for k in {max(len(n) + d, 1) for d in (-1, 0, 1)} for at in range(len(w) - k + 1)}
        pairs += [(i, "", "")] * any(f in " ".join(w) for f in forms) + [(i, x, f) for x in windows for f in forms]
    want = {r.id: r.best for r in spark.createDataFrame(pairs, "id int, a string, b string").groupBy("id").agg(F.max(lev_sim(F.col("a"), F.col("b"))).alias("best")).collect()}
    plan = verify_owner(docs)
    got = {r.id: r.name_score for r in plan.collect()}
    assert {i: got[i] for i, *_ in rows} == {i: want.get(i, 0.0) for i, *_ in rows}
    assert got[120] == 1 - 2 / 7 and got[121] == 1 - 299_999 / 300_000
    # A window of each place and a distance for it, both taken in the plan's own expressions, took hours at 6 GB.
    assert "levenshtein" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_owner_and_person(spark):
    docs = spark.createDataFrame([(1, "this is for Lee Ann", "Ann Lee"), (2, "given to An Lee today", "Ann Lee"), (3, "nobody here", "Ann Lee"), (4, "durant christophe", "Christophe Durand"), (5, "x", "Ann Lee"), (6, "", "Ann Lee")], "id int, text string, name string")
    assert {r.id: r.verified for r in verify_owner(docs).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
    people = spark.createDataFrame([(1, "Karim Haddad"), (2, "Karima Sassi"), (3, "Olga Brun")], "profile_id int, full_name string")
    asked = spark.createDataFrame([(1, "what did karimm do"), (2, "olgga")], "query_id int, query string")
    got = {(r.query_id, r.profile_id): r.outcome for r in resolve_person(asked, people).collect()}
    assert got[(2, 3)] == "match" and (1, 1) in got


def test_person_by_any_letter(spark):
    """Misspelt first letters and names of three letters, against the ratio of all pairs."""
    import difflib
    import random

    names = ["Mohamed Ali", "Michael Lee", "Leo Marchetti", "Ann Brun", "Al Bo", "Olga Mohamad"]
    people = spark.createDataFrame(list(enumerate(names)), "profile_id int, full_name string")
    rng, words = random.Random(2), ["nohamed", "xichael", "leee", "anne", "nana", "oarchetti"]
    for w in [w.lower() for n in names for w in n.split()] * 6:
        i = rng.randrange(len(w))
        words.append(rng.choice((w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :])))
    asked = spark.createDataFrame(list(enumerate(words)), "query_id int, query string")
    for least in (0.84, 0.6):
        expected = {}
        for q, w in enumerate(words):
            ratios = {p: max([difflib.SequenceMatcher(None, w, x).ratio() for x in n.lower().split() if len(x) >= 3], default=0) for p, n in enumerate(names)}
            close = {p: r for p, r in ratios.items() if len(w) >= 4 and r >= least}
            close = {p: r for p, r in close.items() if r >= max(close.values()) - 0.02}
            expected |= {(q, p): (r, "match" if len(close) == 1 else "ambiguous") for p, r in close.items()}
        assert {(r.query_id, r.profile_id): (r.ratio, r.outcome) for r in resolve_person(asked, people, least).collect()} == expected
        assert (0, 0) in expected and (1, 1) in expected and (2, 1) in expected


def test_sections(spark):
    docs = spark.createDataFrame([(1, "Ann\nWork Experience\n2019 Acme\nbuilt things\nCompétences techniques\nlangs: Java, SQL")], "doc_id int, text string")
    rows = X.segment_sections(docs)
    assert [r.section for r in rows.orderBy("pos").collect()] == ["header", "experience", "experience", "experience", "skills", "skills"]
    assert {(r.section, r["item"]) for r in X.section_items(rows).collect()} == {("header", "Ann"), ("experience", "2019 Acme built things"), ("skills", "Java"), ("skills", "SQL")}


def test_certification_hints(spark):
    merge = lambda day, hint: one(spark, T.merge_day_hint(F.lit(day).cast("string"), F.lit(hint).cast("string")))
    assert [merge("5", h) for h in ("3/2021", "2021-3", "mars 2021", "01/02/2020", "spring of 2019", "soon", "", None)] == ["05/03/2021", "05/03/2021", "05 mars 2021", "01/02/2020", "05, 2019", "05", "", ""]
    assert merge(None, "3/2021") == "3/2021"
    name = lambda t: one(spark, T.clean_cert_name(F.lit(t)))
    assert [name(t) for t in ("Certifications - CCNA", "Date d'obtention: CCNA", "Févr. x", "12 janv.", "oct 3, 2020", "12/2020")] == ["CCNA", "CCNA", "Févr. x", None, None, None]
    split = lambda t: one(spark, T.split_cert_names(F.lit(t)))
    assert tuple(split("CCNA 5 / Azure Basics")) == ("CCNA", "Azure Basics", "05")
    assert split("CCNA 5 / 2020") is None and split("CCNA") is None


def test_skills_of_lines(spark):
    lines = ["Skills: Python, Spark", "Databases : PostgreSQL", "Python", "Cloud (AWS, Azure)", "one, a part of more than four words", " ", None, "Additional skills", "python , Go"]
    rows = [(1, i, x, "skills", False) for i, x in enumerate(lines)] + [(1, 20, "Rust", "projects", False), (1, 21, "Zig", "skills", True)]
    found = X.section_skills(spark.createDataFrame(rows, "doc_id long, pos int, line string, section string, is_heading boolean"))
    got = [r.skill for r in found.orderBy("place").collect()]
    assert got == ["Python", "Spark", "Databases", "PostgreSQL", "Cloud (AWS, Azure)", "one, a part of more than four words", "Go"]


def test_entities_of_results(spark):
    schema = "q int, name string, certification_name string, certifications array<string>, project_name string, company_name string, client_name string, employees array<struct<name: string, companies: array<string>>>"
    rows = [(1, " Ann ", None, ["C1", " ", None], "P", "", "Client", None), (1, "Ann", "C2", None, None, None, "Client", [("Bo", ["House", ""]), (None, None)]), (2, None, None, None, None, None, None, None)]
    found = {r.q: r.asDict() for r in A.result_entities(spark.createDataFrame(rows, schema), "q").collect()}
    assert found[1] == {"q": 1, "people": ["Ann", "Bo"], "certifications": ["C1", "C2"], "projects": ["P"], "companies": ["Client", "House"]}
    assert found[2] == {"q": 2, "people": [], "certifications": [], "projects": [], "companies": []}


def test_facts_of_people(spark):
    directory = spark.createDataFrame([("Ann", 1, 9, 0, 4, ["House"]), ("Ann", 2, 7, 0, None, None)], "name string, pos int, project_count int, experience_count int, experience_years int, companies array<string>")
    projects = spark.createDataFrame([("Bo", i, f"P{i % 60}", None, "2020", "d" * 600) for i in range(120)], "name string, pos int, project_name string, client_name string, project_year string, description string")
    jobs = spark.createDataFrame([("Bo", 1, "Firm ", "dev", None, None, None), ("Bo", 2, "Firm", "dev", "", None, None), ("", 3, "None", "x", None, None, None)], "name string, pos int, company string, role string, start_date string, end_date string, description string")
    named = spark.createDataFrame([("Ann", "certification", "éa"), ("Ann", "certification", "Z"), ("Ann", "education", " ")], "name string, kind string, entity string")
    got = {r.name: r for r in A.employee_facts(directory, projects, jobs, named).collect()}
    assert set(got) == {"Ann", "Bo"}
    ann, bo = got["Ann"], got["Bo"]
    assert (ann.project_count, ann.experience_count, ann.experience_years, ann.companies, ann.certifications, ann.education) == (7, 0, 4, ["House"], ["éa", "Z"], [])
    assert (bo.project_count, bo.experience_count, bo.companies, len(bo.projects), len(bo.experience)) == (60, 1, ["Firm"], 50, 1)
    assert bo.projects[0].project_name == "P0" and len(bo.projects[0].description) == 501
