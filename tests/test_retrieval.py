"""Retrieval on hand-made rows with known answers."""

import pytest

from crewlens.operators import retrieval as R

CHUNKS = [
    (1, "ann", "profile", "Ann Smith likes Kafka"), (2, "ann", "projects", "Kafka work"), (3, "ann", "project_entry", "kafka, kafkaesque"),
    (4, "bo", "skills", "Apache KAFKA"), (5, "bo", "profile", "Bo Ek"), (6, "ann", "skills", "Smith charts"), (7, "ann", "experience_entry", "spark at Smith & Co."), (8, "ann", "education", "school"),
]
PEOPLE = [("ann", "Ann Smith"), ("bo", "Bo Ek")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, user_id string, chunk_type string, content string").cache()


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 7)), "query_id long, query string")


def test_rare_tokens_entries_first_then_profiles(spark, chunks):
    asked = questions(spark, "Who used kafkas?", "flink")
    found = R.rare_token_search(asked, chunks, k=3)
    assert [(r.query_id, r.chunk_id) for r in found.orderBy("place").collect()] == [(7, 3), (7, 2), (7, 1)]
    found = R.rare_token_search(asked, chunks)
    rows = R.with_profiles(found, chunks, chunks.where("chunk_type = 'profile'")).orderBy("place").collect()
    assert [(r.chunk_id, r.place) for r in rows] == [(3, 1), (2, 2), (1, 3), (4, 4), (5, 22)]
    # More than the rare limit hold it.
    assert R.rare_token_search(asked, chunks, least=3, share=0.0).count() == 0


def test_equal_questions_and_chunks_meet_once(spark, monkeypatch):
    """400 equal questions on 400 chunks with the same words: one question meets one chunk."""
    tables, keep = {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: tables.setdefault(name, keep(df, name)))
    chunks = spark.range(400).selectExpr("id as chunk_id", "if(id % 2 = 0, 'profile', 'skills') as chunk_type", "concat('kafka spark ', if(id = 5, 'flink', '')) as content")
    asked = spark.range(400).selectExpr("id as query_id", "'kafka, flink' as query")
    found = R.rare_token_search(asked, chunks, k=3, share=1.0).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [(q, c) for q in range(400) for c in (5, 0, 2)]
    # Of the 399 and the one the first three of each are kept.
    assert tables["first"].count() == 4


def test_focus_leaves_out_the_own_name(spark, chunks):
    people = spark.createDataFrame(PEOPLE, "user_id string, full_name string")
    scope = spark.createDataFrame([(7, "ann")], "query_id long, user_id string")
    found = R.focus_rows(scope, questions(spark, "smiths charts, spark, kafka"), chunks, people)
    # Three of six chunks hold kafka, three smith: more than a quarter. The own name doesn't count, its plural does.
    assert [(r.chunk_id, r.place) for r in found.orderBy("place").collect()] == [(7, 1), (6, 2)]


def test_names_of_any_length(spark):
    people = spark.createDataFrame([(1, "Ana Maria Lopez"), (2, "Ana Maria Silva"), (3, "Zoé"), (4, "Bo Ek"), (5, None), (6, " ")], "user_id long, full_name string")
    asked = questions(spark, "tell me about Ana Maria Lopez please", "who is zoe?", "xbo ekx", "silvas and lopez", "ana", "Bo", None, "")
    got = {(r.query_id, r.user_id): r.how for r in R.name_scope(asked, people).collect()}
    # A part is looked for with its variants: silvas is a plural of silva, and begins with it.
    assert got == {(7, 1): "full", (8, 3): "full", (9, 4): "full", (10, 2): "word", (10, 1): "word"}
    shared = {(r.query_id, r.word): r.people for r in R.name_ambiguities(asked, people).collect()}
    assert shared == {(7, "ana"): 2, (7, "maria"): 2, (11, "ana"): 2}


def test_names_that_grow_are_never_broadcast(spark):
    people = spark.range(300).selectExpr("id as user_id", "concat('given', id, ' family', id) as full_name")
    asked = people.selectExpr("user_id as query_id", "concat('who is ', full_name) as query")
    for found in (R.name_scope(asked, people), R.name_ambiguities(asked, people)):
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        # Only the lengths of what begins alike, at most a row for each slot, go everywhere.
        assert any("SortMergeJoin" in x for x in joins)
        assert all("slot#" in x for x in joins if "Broadcast" in x)


def test_references(spark):
    people = spark.createDataFrame([("Zoé Alder",), ("Ann Smith",)], "full_name string")
    turns = ["Zoe Alder and Ann Smith", "what did she do", "more on alders", "and the other?", "-", "-", "-", "-", "his age", None]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string")
    got = {r.turn: r.name for r in R.resolve_references(rows, people).collect()}
    assert got == {0: None, 1: "Ann Smith", 2: None, 3: "Zoé Alder", 4: None, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_token_people(spark):
    texts = spark.createDataFrame([("ann", 1, "java"), ("ann", 2, "node.js tools"), ("bo", 1, "javascript and tool"), ("cy", 1, "")], "person string, n long, text string")
    got = {r.token: r.people for r in R.token_people(questions(spark, "java tools node.js cobol"), texts, "n").collect()}
    assert got == {"java": ["ann", "bo"], "javas": ["ann", "bo"], "tools": ["ann", "bo"], "tool": ["ann", "bo"], "node.js": ["ann"], "node.j": ["ann"]}


def test_groundedness_of_long_words(spark):
    """A word of a million letters is cut at the lengths of asked tokens only."""
    answers = spark.createDataFrame([(1, "spark kafka engineering"), (2, "cobol")], "id long, text string")
    evidence = spark.createDataFrame([(1, "sparkle " + "kafka" * 200000), (2, "x" * 60000)], "id long, text string")
    got = {r.id: (r.share, r.grounded, r.in_results) for r in R.groundedness(answers, evidence).collect()}
    assert got == {1: (round(2 / 3, 9), True, True), 2: (0.0, False, False)}


ROWS = [
    ("Ann Lee", "role", "Engineer", False), ("Ann Lee", "years", "7", False), ("Ann Lee", "skill", "Apache Kafka", False), ("Ann Lee", "company", None, False),
    ("Bo Ek", "years", "3", True), ("Bo Ek", "project", "Kafkaesque", False),
    ("Cy Fox", "role", "Clerk", True), ("Cy Fox", "company", "Acme", True),
]


def cards(spark, query, rows=None):
    rows = spark.createDataFrame([(1, *r) for r in (ROWS if rows is None else rows)], "query_id long, person string, kind string, entity string, directory boolean")
    found = R.result_cards(rows, spark.createDataFrame([(1, query)], "query_id long, query string"))
    return found.orderBy("place").collect()


def test_cards(spark):
    both = cards(spark, "Who has Kafka skills?")
    assert [(r.person, r.score) for r in both] == [("Ann Lee", 3), ("Bo Ek", 2)]
    assert (both[0].role, both[0].years, both[0].skill, both[0].company) == ("Engineer", 7, ["Apache Kafka"], []) and both[1].years == 3
    assert [r.person for r in cards(spark, "kafka, 5+ years of experience")] == ["Ann Lee"]
    # Nobody has that many years: the filter is left out.
    assert [r.person for r in cards(spark, "kafka with 30 years experience")] == ["Ann Lee", "Bo Ek"]
    # All words of a name: only that person.
    assert [r.person for r in cards(spark, "show Ek Bo")] == ["Bo Ek"]
    # The directory stands in for queries of one word at most.
    assert [(r.person, r.role, r.years, r.score) for r in cards(spark, "cobol")] == [("Bo Ek", None, 3, 0), ("Cy Fox", "Clerk", None, 0)]
    assert cards(spark, "cobol mainframe") == [] and cards(spark, None, []) == []
    assert [r.person for r in cards(spark, None)] == ["Ann Lee", "Bo Ek"]


def test_cards_summary(spark):
    rows = spark.createDataFrame([(1, *r) for r in ROWS], "query_id long, person string, kind string, entity string, directory boolean")
    found = R.cards_summary(R.result_cards(rows, spark.createDataFrame([(1, "kafka")], "query_id long, query string")))
    assert found.first().summary == "Ann Lee | role: Engineer | experience: 7 years\nBo Ek | experience: 3 years"
