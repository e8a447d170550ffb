"""A live database, read in ranges, and owners of texts by sequence ratio."""

import difflib
import random
import tempfile

import pytest

from crewlens.operators.joins import verify_owner_by_ratio
from crewlens.sources.tables import load_jdbc

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def url(spark):
    found = f"jdbc:derby:{tempfile.mkdtemp(prefix='derby-')}/db;create=true"
    rows = spark.createDataFrame([(i * 3, f"p{i}", "team" if i % 2 else "other") for i in range(50)], "id int, name string, kind string")
    rows.coalesce(1).write.jdbc(found, "people", properties=DERBY)
    rows.where("id < 0").write.jdbc(found, "nobody", properties=DERBY)
    return found


def test_ranges_of_a_live_table(spark, url):
    found = load_jdbc(spark, url, "people", "id", 4, **DERBY)
    assert found.rdd.getNumPartitions() == 4 and sorted(r[0] for r in found.select("id").collect()) == [i * 3 for i in range(50)]
    sizes = found.rdd.glom().map(len).collect()
    assert max(sizes) <= 14, sizes
    plan = found.where("kind = 'team'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KIND), *EqualTo(KIND,team)]" in plan.replace("kind", "KIND") and "id" not in plan.split("ReadSchema")[1].lower()


def test_conditions_and_empty_tables(spark, url):
    some = load_jdbc(spark, url, "people", "id", 3, where='"id" >= 30 and "id" < 60', **DERBY)
    assert some.rdd.getNumPartitions() == 3 and sorted(r[0] for r in some.select("id").collect()) == list(range(30, 60, 3))
    assert load_jdbc(spark, url, "nobody", "id", 3, **DERBY).count() == 0


def test_owners_by_ratio(spark):
    rng = random.Random(4)
    names = [("Anna", "Lopez"), ("Bo", "Ek"), ("Jean Marc", "Dupond"), ("", "X"), (None, "Y"), ("Zoé", "Alder")]
    words = ["ana", "lopes", "lopez", "anna", "bo", "ek", "eck", "jean", "mark", "dupont", "dupond", "report", "of", "zoe", "alder", "certificate", "2020"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) if i % 20 else None, *names[i % 6]) for i in range(240)]

    def holds(text, first, last):
        first, last, low = (first or "").strip().lower(), (last or "").strip().lower(), (text or "").lower()
        if not first or not last or (first in low and last in low):
            return True
        parts, n = low.split(), len(f"{first} {last}".split())
        windows = [" ".join(parts[i : i + k]) for k in (max(1, n - 1), n, n + 1) for i in range(len(parts) - k + 1)]
        return any(difflib.SequenceMatcher(None, w, x).ratio() > 0.75 for w in windows for x in (f"{first} {last}", f"{last} {first}"))

    got = verify_owner_by_ratio(spark.createDataFrame(rows, "id long, text string, first string, last string"), "id")
    assert {r.id: r.verified for r in got.collect()} == {r[0]: holds(*r[1:]) for r in rows}
