"""Not-modified revisits in WARC records, resolved to what they stand for.

A revisit with status 304 says that a page had not changed. It is joined as of
its time to the latest earlier full response of the same canonical URL. Their
validators must agree: entity tags by weak comparison where both records have
one, else Last-Modified. The response's headers are then updated by those of
the revisit, except for headers that describe the stored content or a single
connection.

The as-of join has two steps, so that one URL may hold any share of all rows.
Records are range-partitioned by URL and time; windows work inside a URL's rows
of one partition, and the last response of each such part, one row each, is
carried on to the next parts of the URL.

Records: record_id, url, at (a long or timestamp), type (response or revisit),
status, headers (a map) and, for responses, body. A null or unusual url is its
own canonical form; records without a time or URL resolve to nothing. Responses
at the very time of a revisit are not earlier; of several at one time the
greatest record_id counts, a null one last. Rows are told apart by a number given
to each, not by record_id, which may be null or repeat: every revisit gets one
result, repeated rows each theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.llm.shared import stored

#: Query parameters that don't tell pages apart.
IGNORED = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Headers of a 304 that don't change a stored response: those on its content and those of a connection.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade", "set-cookie")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, parameters sorted; no scheme, fragment or tracking."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[a-zA-Z]+://([^/?]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[a-zA-Z]+://[^/?]+([^?]*)", 1), "/+$", "")
    parts = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(IGNORED)))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(host == "", plain).otherwise(F.concat(host, path, query))


def lower_headers(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case the last in order counts."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.expr("cast(map() as map<string, string>)"))


def merge_headers(stored_ones: Column, fresh: Column) -> Column:
    """Both with lower-case names: the stored headers, updated by the fresh ones that may change them."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT))
    return F.map_concat(F.map_filter(stored_ones, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _agree(revisit: str, response: str) -> Column:
    """Whether validators agree; null where there are none to compare."""
    tag = lambda side: F.regexp_replace(F.trim(F.col(f"{side}_headers")["etag"]), "^W/", "")
    when = lambda side: F.col(f"{side}_headers")["last-modified"]
    by_tag, by_time = tag(revisit) == tag(response), when(revisit) == when(response)
    return F.when(by_tag.isNotNull(), by_tag).otherwise(by_time)


def latest_earlier(records: DataFrame) -> DataFrame:
    """row and response (a row) of each 304 revisit: the latest earlier full response of its URL, or null.

    records: those of ``numbered``.
    """
    at = F.unix_micros(F.col("at").cast("timestamp")) if records.schema["at"].dataType.typeName().startswith("timestamp") else F.col("at").cast("long")
    rows = records.select("row", "record_id", canonical_url(F.col("url")).alias("site"), at.alias("at"), "full", "asks")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, "site", "at").withColumn("part", F.spark_partition_id()), "captures")
    known = dealt.where("site is not null and at is not null")
    response = F.when(F.col("full"), F.struct("at", "record_id", "row"))
    inside = F.max(response).over(Window.partitionBy("site", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    found = known.select("*", inside.alias("inside")).where("asks").select("row", "site", "part", "inside")
    ends = known.groupBy("site", "part").agg(F.max(response).alias("end"))
    # A URL's last time in a part may go on in the next one.
    before = F.max("end").over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("site").alias("of_site"), F.col("part").alias("of_part"), before.alias("carried")).where("carried is not null")
    joined = found.join(carried, (F.col("site") == F.col("of_site")) & (F.col("part") == F.col("of_part")), "left")
    lost = dealt.where("asks and (site is null or at is null)").select("row", F.lit(None).cast("long").alias("response"))
    return joined.select("row", F.coalesce("inside", "carried")["row"].alias("response")).union(lost)


def numbered(records: DataFrame) -> DataFrame:
    """304 revisits (``asks``) and full responses (``full``) with a number for each row."""
    full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    asks = F.coalesce((F.col("type") == "revisit") & (F.col("status") == 304), F.lit(False))
    rows = records.select("record_id", "url", "at", "headers", "body", full.alias("full"), asks.alias("asks")).where("full or asks")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "records")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, outcome, response_id, headers and body of each 304 revisit.

    outcome: resolved; no_response; mismatch, where the validators disagree; or
    unvalidated, where there are none. Only resolved ones get headers and body.
    """
    rows = numbered(records)
    found = latest_earlier(rows).withColumnRenamed("row", "of")
    asks = rows.where("asks").select("row", "record_id", lower_headers(F.col("headers")).alias("revisit_headers"))
    full = rows.where("full").select(F.col("row").alias("found"), F.col("record_id").alias("response_id"), lower_headers(F.col("headers")).alias("response_headers"), "body")
    pairs = asks.join(found, F.col("row") == F.col("of")).join(full, F.col("response") == F.col("found"), "left")
    agree = _agree("revisit", "response")
    outcome = F.when(F.col("response").isNull(), "no_response").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    pairs = pairs.withColumn("outcome", outcome)
    resolved = lambda c: F.when(F.col("outcome") == "resolved", c)
    return pairs.select("record_id", "outcome", "response_id", resolved(merge_headers(F.col("response_headers"), F.col("revisit_headers"))).alias("headers"), resolved(F.col("body")).alias("body"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures in the form of WARC records: each page fetched in full, and asked for again later with its entity tag."""
    tag, at = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.col("page_id") * 60
    later = at + 1 + F.col("page_id") * 7919 % 100000
    headers = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("type"), F.lit(200).alias("status"), headers("ETag", tag, "Content-Type", "text/html", "Content-Length", F.octet_length("html").cast("string"), "Cache-Control", "max-age=60").alias("headers"), F.col("html").alias("body"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), headers("etag", F.concat(F.lit("W/"), tag), "content-length", "0", "cache-control", "max-age=120", "date", later.cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.union(again)
