"""Streams give the tables that their batch forms give, in one batch or in many."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewlens.sources import tables as S
from crewlens.streaming import changes as C
from crewlens.sources import partitioned as P
from crewlens.streaming.state import fold_evaluation_stream, fold_status_stream


def stream(spark, folder, df, parts):
    for i in range(parts):
        df.where(F.pmod("n", F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_first_hash_wins(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"h{i % 4}") for i in range(12)], "n long, file_hash string")
    for parts in (1, 3):
        known = str(tmp_path / f"known{parts}")
        spark.createDataFrame([], rows.schema).write.parquet(known)
        C.run_batches(stream(spark, tmp_path / f"in{parts}", rows, parts), C.admitting(spark, known, ["n"]), str(tmp_path / f"at{parts}"))
        assert sorted(r.file_hash for r in spark.read.parquet(known).collect()) == ["h0", "h1", "h2", "h3"]


def test_alerts_go_out_once(spark, tmp_path):
    day = dt.date(2024, 5, 10)
    rows = spark.createDataFrame([(i, i % 3, 1, day + dt.timedelta(i % 3)) for i in range(6)], "n long, cert_id long, profile_id long, expiration_date date")
    sent = str(tmp_path / "sent")
    spark.createDataFrame([], "cert_id long, profile_id long, alert_type string, days int, priority int").write.parquet(sent)
    handle = C.daily_alerts(spark, "", sent, F.lit(day))
    C.run_batches(stream(spark, tmp_path / "in", rows.dropDuplicates(["cert_id"]), 3), handle, str(tmp_path / "at"))
    handle(rows.dropDuplicates(["cert_id"]), 9)
    assert spark.read.parquet(sent).count() == 3


def test_status_on_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [(0, 1, "assigned", t), (1, 1, "in_progress", t + dt.timedelta(1)), (2, 2, "assigned", t), (3, 1, "completed", t + dt.timedelta(2)), (4, 2, "in_progress", t)]
    rows = spark.createDataFrame(events, "n long, training_id long, status string, ts timestamp")
    batch = {r.training_id: r.status for r in C.fold_status(rows).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = {}

    def keep(df, _):
        out.update({r.training_id: r.status for r in df.collect()})

    folded = fold_status_stream(stream(spark, tmp_path / "in", rows, 3).drop("n"))
    folded.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert out == batch


@pytest.mark.parametrize("parts", [1, 4])
def test_evaluations_on_a_stream(spark, tmp_path, parts):
    """Scores before, at and after a pending that comes late; repeated scores; records without a pending."""
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(d)
    events = [(1, "scored", 9.0, 0), (1, "scored", 5.0, 5), (1, "pending", None, 3), (1, "scored", 4.0, 4), (2, "pending", None, 6), (2, "scored", 7.0, 6), (2, "scored", 8.0, 7), (2, "pending", None, 2), (2, "scored", 6.0, 3), (3, "scored", 1.0, 1), (4, "pending", None, 1), (4, "other", None, 2)]
    rows = spark.createDataFrame([(n, *e[:3], t(e[3])) for n, e in enumerate(events)], "n long, record_id long, status string, score double, ts timestamp")
    batch = {r.record_id: (r.status, r.score, r.scored_at) for r in C.fold_evaluation(rows).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = {}
    keep = lambda df, _: out.update({r.record_id: (r.status, r.score, r.scored_at) for r in df.collect()})
    folded = fold_evaluation_stream(stream(spark, tmp_path / "in", rows, parts).drop("n"))
    folded.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert out == batch


def test_replaced_scopes(spark, tmp_path):
    """Chunks of changed users are replaced, those of others stay; a user without chunks leaves an empty bucket; a replay does nothing."""
    path, schema = str(tmp_path / "chunks"), "user_id long, chunk_id string, content string, seq int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    users = lambda *u: spark.createDataFrame([(x,) for x in u], "user_id long")
    read = lambda: {(r.user_id, r.chunk_id, r.content) for r in spark.read.parquet(path).collect()}
    put = lambda u, r, batch=None: P.replace_scopes(spark, path, u, r, "user_id", "chunk_id", "seq", 4, batch)
    put(users(*range(9)), rows(*((u, f"{u}_a", "old", 1) for u in range(9)), (1, "1_b", "x", 1), (1, "1_b", "y", 2)), 1)
    assert len(read()) == 10 and (1, "1_b", "y") in read()
    assert put(users(1, 2), rows((1, "1_c", "new", 1), (3, "3_z", "not asked", 1)), 2)
    after = {(u, f"{u}_a", "old") for u in range(9) if u not in (1, 2)} | {(1, "1_c", "new")}
    assert read() == after
    assert not put(users(1, 5), rows(), 2) and read() == after
    put(users(*range(9)), rows(), 3)
    assert not [f for f in (tmp_path / "chunks").glob("bucket=*")]


def test_a_run_that_dies_between_staging_and_swap(spark, tmp_path, monkeypatch):
    """The stream starts again from its checkpoint and gives the batch form's table, once."""
    path, built = str(tmp_path / "chunks"), spark.createDataFrame([(u, f"{u}_{i}", f"text {u}") for u in range(12) for i in range(u % 3)], "user_id long, chunk_id string, content string")
    changed = spark.createDataFrame([(i, i) for i in range(12)], "n long, user_id long")
    handle = C.refreshing(spark, path, lambda users: built.join(users, "user_id", "left_semi"), 4)
    source, calls, swap = stream(spark, tmp_path / "in", changed, 3), [], P.swap_partitions

    def dies(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        swap(*a)

    monkeypatch.setattr(P, "swap_partitions", dies)
    with pytest.raises(Exception, match="killed"):
        C.run_batches(source, handle, str(tmp_path / "at"))
    C.run_batches(source, handle, str(tmp_path / "at"))
    C.run_batches(source, handle, str(tmp_path / "at"))
    found = spark.read.parquet(path).select("user_id", "chunk_id", "content")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, built.collect())) and len(calls) == 4
    assert sorted(r.batch for r in spark.read.parquet(f"{path}-batches").collect()) == [0, 1, 2]


@pytest.mark.parametrize("parts", [1, 3])
def test_rescoring_on_a_stream(spark, tmp_path, parts):
    """Events in one or many batches leave the ranks that scoring all at once gives."""
    day = lambda i: dt.date(2020 + i % 3, 1, 1 + i % 28)
    events = spark.createDataFrame([(i, i % 7, day(i), float(i % 5)) for i in range(40)], "n long, profile_id long, date date, points double")
    whole = events.groupBy("profile_id", F.year("date").alias("score_year")).agg(F.sum("points").alias("final_score")).cache()
    path = str(tmp_path / "scores")
    score = lambda keys: keys.join(whole, ["profile_id", "score_year"], "left").fillna(0.0, ["final_score"])
    handle = C.rescoring(spark, path, score, F.lit(2022))
    C.run_batches(stream(spark, tmp_path / "in", events, parts), handle, str(tmp_path / "at"))
    handle(events.limit(3), 0)
    keys = C.impacted_keys(events, F.lit(2022))
    from crewlens.operators.windows import rank_scores

    expected = rank_scores(score(keys), ["score_year"]).select("profile_id", "score_year", "final_score", "rank", "rank_percentile")
    got = spark.read.parquet(path).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_usage_on_a_stream(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, i % 3, f"h{i % 2}", dt.datetime(2024, 1, 1 + i % 20)) for i in range(30)], "n long, user_id long, file_hash string, ts timestamp")
    path = str(tmp_path / "usage")
    C.counting_usage(spark, stream(spark, tmp_path / "in", rows, parts), path, str(tmp_path / "at"), 4)
    got = spark.read.parquet(path).select("user_id", "file_hash", "uses", "last_used")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.template_usage(rows).select("user_id", "file_hash", "uses", "last_used").collect()))


def test_metadata_files(spark, tmp_path):
    for folder, text in {"Ann Lee": '{"name": "A. Lee"}', "bad": "{no json", "Bo": '{"name": "Bo"}'}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metadata.json").write_text(text)
    found = S.scan_profile_metadata(spark, [str(tmp_path)], "name string")
    assert {"a lee", "bo"} <= {r.profile_key for r in found.collect()}
    (tmp_path / "x.pdf").write_bytes(b"1234")
    (tmp_path / "y.exe").write_bytes(b"1")
    files = S.admit_files(S.scan_binary_documents(spark, str(tmp_path)).where("path like '%.pdf' or path like '%.exe'"))
    assert {r.reason for r in files.select("reason").collect()} == {"ok", "type not allowed"}


def test_query_log_grows_by_day(spark, tmp_path):
    from crewlens.sources.tables import append_query_log

    log = str(tmp_path / "log")
    rows = [("2024-05-01 10:00:00", "who knows Java", "{}", 3, 120), ("2024-05-02 09:00:00", "hello", "{}", 0, 5)]
    df = spark.createDataFrame(rows, "asked_at string, query string, entities string, results int, elapsed_ms int")
    df = df.withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    for _ in range(2):
        append_query_log(df, log)
    found = spark.read.parquet(log)
    assert found.count() == 4 and found.where("day = date '2024-05-01'").select("query").distinct().collect()[0][0] == "who knows Java"
