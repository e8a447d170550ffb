"""Changes as they come: each is a pure batch function first, with a foreachBatch form beside it.

Recomputing is idempotent by key, so a batch that runs twice leaves the same
tables. State without an end (a hash that was ever seen) is a table and an anti
join; only the folding of one record's status is kept in a state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlens.operators.certifications import expiry_alerts
from crewlens.operators.windows import first_per_key, rank_scores, top_k_per_key
from crewlens.sources.durable import stored
from crewlens.sources.partitioned import is_done, mark_done, read_table, replace_scopes, swap_partitions, upsert_rows


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands all that a stream has now to ``handle``, batch by batch."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_alerts(spark: SparkSession, certs: str, alerts: str, as_of: Column) -> Callable[[DataFrame, int], None]:
    """Appends the day's alerts of changed certifications; those of an earlier run never go out again."""

    def handle(batch: DataFrame, _: int) -> None:
        sent = read_table(spark, alerts, "cert_id long, profile_id long, alert_type string, days int, priority int")
        expiry_alerts(batch, sent, as_of).write.mode("append").parquet(alerts)

    return handle


def impacted_keys(events: DataFrame, year: Column) -> DataFrame:
    """(profile_id, score_year) that events touch: the current year and the event's own."""
    years = F.explode(F.array_distinct(F.array(year, F.year("date"))))
    return events.select("profile_id", years.alias("score_year")).where("score_year is not null").distinct()


def rescore(scores: DataFrame, fresh: DataFrame, keys: DataFrame) -> DataFrame:
    """Scores with the touched keys replaced, and ranks made anew for touched years only. Both: profile_id, score_year, final_score."""
    on = ["profile_id", "score_year"]
    kept = scores.select(*on, "final_score").join(keys, on, "left_anti")
    merged = kept.unionByName(fresh.select(*on, "final_score").join(keys, on, "left_semi"))
    years = keys.select("score_year").distinct()
    touched = rank_scores(merged.join(years, "score_year", "left_semi"), ["score_year"])
    rest = scores.join(years, "score_year", "left_anti").select(*touched.columns)
    return touched.unionByName(rest)


def rescoring(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], year: Column) -> Callable[[DataFrame, int], None]:
    """The durable form of ``rescore``: a batch of events recomputes its keys and swaps in the touched years of the table at ``path``.

    ``score`` takes (profile_id, score_year) and gives profile_id, score_year and
    final_score from tables that hold the batch's events. The table is partitioned by
    year; a batch that was done before changes nothing.
    """
    schema = "profile_id long, final_score double, rank int, rank_percentile double, score_year int"

    def handle(batch: DataFrame, number: int) -> None:
        if is_done(spark, path, number):
            return
        keys = stored(impacted_keys(batch, year), "keys")
        years = sorted(r[0] for r in keys.select("score_year").distinct().collect())
        old = read_table(spark, path, schema).where(F.col("score_year").isin(*years) if years else F.lit(False))
        fresh = score(keys).select(F.col("profile_id").cast("long").alias("profile_id"), F.col("score_year").cast("int").alias("score_year"), F.col("final_score").cast("double").alias("final_score"))
        staged = stored(rescore(old, fresh, keys).select("profile_id", "final_score", "rank", "rank_percentile", "score_year"), "staged")
        swap_partitions(staged, path, "score_year", years)
        mark_done(spark, path, number)

    return handle


def refreshing(spark: SparkSession, path: str, rebuild: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The durable form of ``refresh_chunks``: a batch of changed users replaces their chunks in the table at ``path``.

    ``rebuild`` takes user_id and gives the users' chunks (user_id, chunk_id and more);
    users that have none any more lose theirs.
    """

    def handle(batch: DataFrame, number: int) -> None:
        users = stored(batch.select("user_id").distinct(), "users")
        replace_scopes(spark, path, users, rebuild(users).withColumn("of one", F.lit(0)), "user_id", "chunk_id", "of one", buckets, number)

    return handle


def counting_usage(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """``template_usage`` of a stream: totals are kept in the state store, and what a batch changes is laid over the table at ``path``."""
    counted = template_usage(events).writeStream.outputMode("update")
    query = counted.foreachBatch(lambda batch, number: upsert_rows(spark, path, batch, ["user_id", "file_hash"], None, buckets, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_chunks(chunks: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Chunks of changed users replaced by rebuilt ones."""
    return chunks.join(changed.select("user_id").distinct(), "user_id", "left_anti").unionByName(rebuilt.join(changed.select("user_id").distinct(), "user_id", "left_semi"))


def admit_once(rows: DataFrame, known: DataFrame, order: list[str], key: str = "file_hash") -> DataFrame:
    """Rows whose hash was never seen, the first of equal ones."""
    return first_per_key(rows.join(known.select(key), key, "left_anti"), [key], order)


def admitting(spark: SparkSession, hashes: str, order: list[str], key: str = "file_hash") -> Callable[[DataFrame, int], None]:
    """The durable form of ``admit_once``: the hash table grows by what a batch admits."""

    def handle(batch: DataFrame, _: int) -> None:
        known = read_table(spark, hashes, batch.schema)
        admit_once(batch, known, order, key).write.mode("append").parquet(hashes)

    return handle


def outbox(notifications: DataFrame, acknowledged: DataFrame, as_of: Column, batch: int = 200, key: str = "notification_id") -> DataFrame:
    """Due notifications without an acknowledgement, the oldest first."""
    due = notifications.where(F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of)).join(acknowledged.select(key), key, "left_anti")
    return due.orderBy("created_at", key).limit(batch)


#: The steps of a training and of an evaluation.
STEPS = {"assigned": 1, "in_progress": 2, "completed": 3}


def fold_status(events: DataFrame, key: str = "training_id") -> DataFrame:
    """Each record's latest status with the dates of its steps; later events win, equal times go to the further step."""
    step = sum((F.when(F.col("status") == s, n).otherwise(0) for s, n in STEPS.items()), F.lit(0))
    return events.groupBy(key).agg(
        F.max_by("status", F.struct("ts", step.alias("step"))).alias("status"),
        F.min(F.when(F.col("status") == "in_progress", F.col("ts"))).alias("start"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("end"),
    )


def fold_evaluation(events: DataFrame, key: str = "record_id") -> DataFrame:
    """Guarded steps: pending, then scored once by the first score after it; others change nothing."""
    pending = events.where("status = 'pending'").groupBy(key).agg(F.min("ts").alias("pending_at"))
    scored = events.where("status = 'scored'").join(pending, key).where("ts >= pending_at").groupBy(key).agg(F.min_by("score", "ts").alias("score"), F.min("ts").alias("scored_at"))
    return pending.join(scored, key, "left").withColumn("status", F.when(F.col("scored_at").isNull(), "pending").otherwise("scored"))


def snapshot_versions(snapshots: DataFrame, key: str = "profile_id", order: str = "created_at", tie: str = "snapshot_id") -> DataFrame:
    """Every snapshot with the time it held: a new one closes the one before."""
    after = F.lead(order).over(Window.partitionBy(key).orderBy(order, tie))
    return snapshots.withColumn("valid_to", after).withColumn("is_current", F.col("valid_to").isNull())


def assemble_answers(events: DataFrame, key: str = "answer_id") -> DataFrame:
    """Answers of ordered events: token appends, replace starts anew, done closes. events: key, seq, kind, text."""
    cut = events.groupBy(key).agg(F.max(F.when(F.col("kind") == "replace", F.col("seq"))).alias("cut"), F.bool_or(F.col("kind") == "done").alias("done"), F.min_by("text", F.when(F.col("kind") == "context", F.col("seq"))).alias("context"))
    parts = events.join(cut, key).where(F.col("kind").isin("token", "replace") & (F.col("cut").isNull() | (F.col("seq") >= F.col("cut"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return cut.join(parts.groupBy(key).agg(text.alias("answer")), key, "left").select(key, F.coalesce("answer", F.lit("")).alias("answer"), "done", "context")


#: Who hears of an event, and how urgent it is.
NOTICES = (("assigned", "assignee", 2), ("requested", "manager", 2), ("approved", "requester", 1), ("rejected", "requester", 2), ("evidence", "manager", 1), ("score", "assignee", 1))


def notifications_for(events: DataFrame) -> DataFrame:
    """A notification for each recipient of each event. events: event_id, event_type, and a column for each role."""
    rules = events.sparkSession.createDataFrame(list(NOTICES), "event_type string, role string, priority int")
    rows = events.join(F.broadcast(rules), "event_type")  # a fixed handful of rules
    recipient = F.coalesce(*(F.when(F.col("role") == r, F.col(r)) for r in ("assignee", "manager", "requester")))
    return rows.select("event_id", "event_type", recipient.alias("user_id"), "priority").where("user_id is not null")


def template_usage(events: DataFrame) -> DataFrame:
    """How often, and when last, a user used the same bytes."""
    return events.groupBy("user_id", "file_hash").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))


def latest_unsent(notifications: DataFrame, k: int = 50) -> DataFrame:
    return top_k_per_key(notifications, ["user_id"], [F.desc("created_at"), "notification_id"], k)
