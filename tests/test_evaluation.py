"""Evaluation against plain versions: spellings, rates, claims and likeness of documents."""

import difflib
import re

from crewlens.operators import evaluation as E
from crewlens.operators import retrieval as R


def norm(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower().replace("&", " and ")).strip()


def fits(value, spellings, least, inside):
    a = norm(value)
    for b in map(norm, spellings or []):
        if a and b and (a == b or (inside and len(b) >= 4 and (b in a or a in b)) or difflib.SequenceMatcher(None, a, b).ratio() >= least):
            return True
    return False


def test_aliases(spark):
    values = [None, "", " ", "AWS", "Amazon Web Services", "amazon web service", "Cisco", "AWS Certified", "Oracle & Co"]
    spellings = [None, [], [""], [" ", None], ["AWS"], ["amazon web services", "AWS"], ["Oracle and Co", "isc2"], ["cisco systems"]]
    rows = [(i * 100 + j, v, v, s, s) for i, v in enumerate(values) for j, s in enumerate(spellings)]
    df = spark.createDataFrame(rows, "id long, name string, issuer string, names array<string>, issuers array<string>")
    found = E.alias_eval(df)
    expected = {i: (fits(v, s, 0.86, False), fits(v, s, 0.88, True)) for i, v, _, s, _ in rows}
    assert {r.id: (r.name_ok, r.issuer_ok) for r in found.collect()} == expected and all(r.both_ok == (r.name_ok and r.issuer_ok) for r in found.collect())
    rates = E.alias_rates(found, spark.createDataFrame([(0, 1.5), (1, 2.5)], "id long, seconds double")).first()
    names = sum(e[0] for e in expected.values())
    assert (rates.sample_size, rates.name_right, rates.seconds, rates.seconds_mean) == (72, names, 4.0, 0.056) and rates.name_pct == round(names / 72 * 100, 6)


def test_claims(spark):
    answers = [(1, "I don't know, ask Bob"), (2, ""), (3, None), (4, "nothing here"), (5, "Bob Ray has CCNA, mail bob@x.org or 0612 345 678. The This"), (6, "Zed"), (7, "Étoile Ab x")]
    context = [(5, "bob has a ccna"), (5, "BOB@X.ORG"), (6, None)]
    rows = E.claim_groundedness(spark.createDataFrame(answers, "id long, text string"), spark.createDataFrame(context, "id long, text string")).collect()
    # Bob, Ray, CCNA, the address, the number, The and This: Ray and the number don't stand in the context.
    assert {r.id: (r.claims, r.grounded_pct) for r in rows} == {1: (0, 100.0), 2: (0, 100.0), 3: (0, 100.0), 4: (0, 100.0), 5: (7, 71.4), 6: (1, 0.0), 7: (0, 100.0)}


def test_likeness_by_layout(spark):
    schema = "id long, text string, cols array<int>"
    a = spark.createDataFrame([(1, "red blue green", [3, 3]), (2, "", [3, 3]), (3, "one two", None)], schema)
    b = spark.createDataFrame([(i, "other words", [3, 3]) for i in range(10, 20)] + [(30, "red words", None), (31, "red blue other", [3]), (32, "one two", [])], schema)
    rows = R.similar_documents(a, b).orderBy("a_id", "place").collect()
    assert [(r.a_id, r.b_id, r.score) for r in rows] == [(1, 31, round(0.85 * 2 / 4 + 0.15 * 0.5, 9)), (1, 30, round(0.85 / 4, 9)), (1, 10, 0.15), (3, 32, 0.85)]
