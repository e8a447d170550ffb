"""Evaluation of predictions against truth, as joins and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.functions.similarity import seq_ratio
from crewlens.functions.text import match_key


def _keys(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: match_key(v)), lambda v: v != "")


def field_accuracy(truth: DataFrame, predicted: DataFrame, key: str, fields: list[str], lists: list[str], recalls: list[str] | None = None) -> DataFrame:
    """One row: per field the % of records that are equal after normalising, per list the % that overlap, per recall list the mean recall.

    An empty truth list counts as a miss.
    """
    right = predicted.select(F.col(key).alias("of"), *(F.col(c).alias(f"p_{c}") for c in (*fields, *lists, *(recalls or []))))
    both = truth.join(right, F.col(key) == F.col("of"), "left")
    rate = lambda ok: F.round(F.avg(F.when(ok, 100.0).otherwise(0.0)), 6)
    recall = lambda c: F.round(F.avg(F.when(F.size(_keys(F.col(c))) == 0, 0.0).otherwise(100 * F.size(F.array_intersect(_keys(F.col(c)), _keys(F.col(f"p_{c}")))) / F.size(F.array_distinct(_keys(F.col(c)))))), 6)
    return both.agg(
        *(rate(match_key(F.col(c)) == match_key(F.col(f"p_{c}"))).alias(c) for c in fields),
        *(rate(F.arrays_overlap(_keys(F.col(c)), _keys(F.col(f"p_{c}")))).alias(c) for c in lists),
        *(recall(c).alias(c) for c in recalls or []),
    )


def mismatch_report(truth: DataFrame, predicted: DataFrame, key: str, fields: list[str], lists: list[str], preview: int = 6) -> DataFrame:
    """A row for each field that differs, with the reason and previews. Lists without truth are skipped."""
    right = predicted.select(F.col(key).alias("of"), *(F.col(c).alias(f"p_{c}") for c in (*fields, *lists)))
    both = truth.join(right, F.col(key) == F.col("of"), "left")
    bag = lambda c: F.array_sort(F.split(match_key(c), " "))

    def plain(c: str) -> Column:
        a, b = F.col(c), F.col(f"p_{c}")
        reason = F.when(match_key(a) == match_key(b), None).when(bag(a) == bag(b), "same words in another order").when(F.coalesce(F.trim(b), F.lit("")) == "", "missing").otherwise("different")
        return F.struct(F.lit(c).alias("field"), reason.alias("reason"), F.coalesce(a, F.lit("")).alias("expected"), F.coalesce(b, F.lit("")).alias("found"))

    def listed(c: str) -> Column:
        a, b = F.col(c), F.col(f"p_{c}")
        show = lambda x: F.coalesce(F.array_join(F.slice(x, 1, preview), "; "), F.lit(""))
        reason = F.when((F.size(_keys(a)) > 0) & ~F.coalesce(F.arrays_overlap(_keys(a), _keys(b)), F.lit(False)), "no overlap")
        return F.struct(F.lit(c).alias("field"), reason.alias("reason"), show(a).alias("expected"), show(b).alias("found"))

    rows = both.select(key, F.explode(F.array(*map(plain, fields), *map(listed, lists))).alias("m")).select(key, "m.*")
    return rows.where("reason is not null")


def mismatch_counts(report: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per field how many records differ, of how many."""
    total = truth.agg(F.count_distinct(key).alias("records"))
    return report.groupBy("field").agg(F.count_distinct(key).alias("mismatches")).crossJoin(F.broadcast(total))  # a single row


def alias_eval(rows: DataFrame, name_least: float = 0.86, issuer_least: float = 0.88) -> DataFrame:
    """id, name_ok, issuer_ok and both_ok: whether a name and an issuer match any of their spellings.

    Names match by equal keys or by ratio; issuers also where one holds the other, for
    spellings of 4 characters or more. Blank spellings count for nothing, and a blank
    name or issuer, or one without spellings, is wrong. rows: id (one row for each), name, issuer,
    names and issuers (arrays).
    """

    def fits(value: str, spellings: str, least: float, inside: bool) -> DataFrame:
        one = rows.select("id", match_key(F.col(value)).alias("a"), F.explode_outer(_keys(F.col(spellings))).alias("b"))
        held = (F.length("b") >= 4) & (F.contains("b", F.col("a")) | F.contains("a", F.col("b"))) if inside else F.lit(False)
        sure = one.withColumn("known", F.col("a") != "").withColumn("sure", F.coalesce((F.col("a") == F.col("b")) | held, F.lit(False)))
        # Only the rest is compared letter by letter.
        near = F.when(F.col("known") & ~F.col("sure") & F.col("b").isNotNull(), seq_ratio(F.when(~F.col("sure"), F.col("a")), F.when(~F.col("sure"), F.col("b"))) >= least)
        return sure.groupBy("id").agg(F.bool_or(F.col("known") & (F.col("sure") | F.coalesce(near, F.lit(False)))).alias(f"{value}_ok"))

    both = fits("name", "names", name_least, False).join(fits("issuer", "issuers", issuer_least, True), "id")
    return both.withColumn("both_ok", F.col("name_ok") & F.col("issuer_ok"))


def alias_rates(found: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row: how many were tried, counts and % of right names, issuers and both, seconds in all and on average. found: as ``alias_eval`` has it; seconds: id, seconds."""
    kinds = ("name", "issuer", "both")
    share = lambda c: F.round(F.avg(F.when(F.col(c), 100.0).otherwise(0.0)), 6)
    took = F.sum(F.coalesce("seconds", F.lit(0.0)))
    rows = found.join(seconds, "id", "left")
    return rows.agg(F.count("*").alias("sample_size"), *(F.count_if(f"{k}_ok").alias(f"{k}_right") for k in kinds), *(share(f"{k}_ok").alias(f"{k}_pct") for k in kinds), F.round(took, 3).alias("seconds"), F.round(took / F.count("*"), 3).alias("seconds_mean"))


def retrieval_precision(results: DataFrame, expected: DataFrame, k: int | None = None) -> DataFrame:
    """% of the returned chunks that hold an expected term or all its words; of all returned, or of the first k. results: query_id, place, text."""
    text = F.lower(F.col("text"))
    rows = results.where(F.col("place") <= k) if k else results
    hit = F.exists("terms", lambda t: F.contains(text, F.lower(t)) | F.forall(F.split(F.lower(t), " "), lambda w: F.contains(text, w)))
    return rows.join(expected, "query_id").groupBy("query_id").agg(F.round(F.avg(F.when(hit, 100.0).otherwise(0.0)), 6).alias("precision"))


#: Claims are e-mail addresses, numbers like those of phones, capitalised words and acronyms; capitalised words that claim nothing; answers that claim nothing.
CLAIMS = (r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", r"(\b\+?[0-9]{2,4}[ 0-9-]{6,12}\b)", r"(\b[A-Z][a-zA-Z0-9-]{2,}\b)", r"(\b[A-Z]{3,5}\b)")
NO_NAMES = ("the", "this", "he", "she", "they")
NOTHING_CLAIMED = ("i don't have", "i don't know")


def claim_groundedness(answers: DataFrame, context: DataFrame, ignored: tuple[str, ...] = NO_NAMES) -> DataFrame:
    """id, claims and grounded_pct of every answer: the % of its distinct claims that its context holds, to one decimal.

    Blank answers, refusals and answers without claims are 100. Claims and context are
    compared in lower case; ignored words are claims that hold. Both:
    id, text; answers have one row for each id, a context any number, each of which may hold a claim.
    """
    plain = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in CLAIMS))
    low = F.lower("text")
    free = F.coalesce(F.trim("text") == "", F.lit(True)) | F.contains(low, F.lit(NOTHING_CLAIMED[0])) | F.contains(low, F.lit(NOTHING_CLAIMED[1]))
    claims = F.when(free, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(found, plain)))
    rows = answers.select("id", F.filter(claims, lambda c: c != "").alias("claims"))
    asked = rows.select("id", F.explode("claims").alias("claim")).where(~F.col("claim").isin(*ignored))
    texts = context.select("id", plain(F.col("text")).alias("context"))
    held = asked.join(texts, "id").where(F.contains("context", F.col("claim"))).select("id", "claim").distinct()
    lost = asked.join(held, ["id", "claim"], "left_anti").groupBy("id").agg(F.count("*").alias("lost"))
    n, out = F.size("claims"), F.coalesce("lost", F.lit(0))
    return rows.join(lost, "id", "left").select("id", n.alias("claims"), F.when(n == 0, 100.0).otherwise(F.round((n - out) / n * 100, 1)).alias("grounded_pct"))


#: Phrases of a refusal.
REFUSALS = ("i don't have", "i do not have", "i don't know", "i do not know", "not mentioned", "insufficient information", "no information", "does not contain")


def rejection_rate(answers: DataFrame) -> DataFrame:
    """% of answers that hold a phrase of a refusal."""
    text = F.lower("text")
    refused = F.contains(text, F.lit(REFUSALS[0]))
    for phrase in REFUSALS[1:]:
        refused = refused | F.contains(text, F.lit(phrase))
    return answers.agg(F.round(F.avg(F.when(refused, 100.0).otherwise(0.0)), 6).alias("rejected_pct"))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric by metric: before, after and the change. Both: metric, value."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full_outer")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def flatten_predictions(df: DataFrame, entries: str, parts: list[str]) -> DataFrame:
    """Nested entries as comparable strings: their parts that say something, joined."""
    flat = F.transform(entries, lambda e: F.array_join(F.filter(F.array(*(F.trim(e[p]) for p in parts)), lambda x: x != ""), " | "))
    return df.withColumn(entries, F.filter(flat, lambda x: x != ""))
