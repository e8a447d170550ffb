"""Revisit resolution against a plain version, with odd records."""

from crewlens.llm.warc import canonical_url, resolve_revisits
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, at long, type string, status int, headers map<string,string>, body string, site string, part int"


def test_resolution(spark):
    full = lambda i, url, at, body, **h: (i, url, at, "response", 200, {k.replace("_", "-"): v for k, v in h.items()}, body, "x", 1)
    again = lambda i, url, at, **h: (i, url, at, "revisit", 304, {k.replace("_", "-"): v for k, v in h.items()}, None, "x", 1)
    rows = [
        full(1, "http://www.A.org:80/p/?b=2&a=1&utm_source=z#top", 10, "one", ETag='"1"', Content_Type="text/html", Server="s1"),
        full(2, "https://a.org/p?a=1&b=2", 20, "two", ETag='"2"', Last_Modified="L2", Content_Type="text/html"),
        (3, "https://a.org/p?a=1&b=2", 25, "response", 404, {}, "gone", "x", 1),
        again(11, "https://a.org/p?a=1&b=2", 15, etag='W/"1"', content_type="x", server="s2"),
        again(12, "https://a.org/p?a=1&b=2", 30, last_modified="L2"),
        again(13, "https://a.org/p?a=1&b=2", 30, etag='"1"'),
        again(14, "https://a.org/p?a=1&b=2", 10, etag='"1"'),
        again(15, "https://a.org/p?a=1&b=2", 30),
        again(16, None, 30, etag='"1"'),
        again(17, "https://a.org/other", None, etag='"1"'),
        (18, "https://a.org/p?a=1&b=2", 30, "revisit", 304, None, None, "x", 1),
    ]
    rows += [full(100 + i, "http://hot.org/", 100 + 2 * i, f"b{i}", ETag=f'"{i}"') for i in range(60)] + [again(300 + i, "http://hot.org", 101 + 2 * i, ETag=f'"{i}"') for i in range(60)]
    found = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {i: (r.outcome, r.response_id) for i, r in found.items() if i < 100} == {
        11: ("resolved", 1), 12: ("resolved", 2), 13: ("mismatch", 2), 14: ("no_response", None), 15: ("unvalidated", 2), 16: ("no_response", None), 17: ("no_response", None), 18: ("unvalidated", 2)}
    assert found[11].headers == {"etag": 'W/"1"', "content-type": "text/html", "server": "s2"} and found[11].body == "one"
    assert all(found[300 + i].response_id == 100 + i and found[300 + i].body == f"b{i}" for i in range(60))
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_an_id(spark):
    """Null and repeated record_ids: a result for every revisit, of its own URL."""
    rows = [(1, "http://a.org/", 1, "response", 200, {"etag": "1"}, "a", "x", 1), (1, "http://b.org/", 1, "response", 200, {"etag": "2"}, "b", "x", 1)]
    rows += [(i, f"http://{s}.org/", 5, "revisit", 304, {"etag": t}, None, "x", 1) for i in (None, 7, 7) for s, t in (("a", "1"), ("b", "2"))]
    got = sorted((str(r.record_id), r.outcome, r.body) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted((i, "resolved", b) for i in ("None", "7", "7") for b in ("a", "b"))


def test_canonical(spark):
    urls = ["HTTP://WWW.X.org:443/a//?ref=q", "ftp://x.org/a", "", None, "no url"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()] == ["x.org/a", "x.org/a", "", None, "no url"]
