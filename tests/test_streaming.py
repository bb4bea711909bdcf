"""Streams give what their batch forms give; folds give the outcomes worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidewheel.plans.relations import relation
from tidewheel.streaming import deadlines, folds, lifecycle
from tidewheel.streaming.handlers import Handlers

DATA = "/root/testdata/sf0.001"


def test_result_stream(spark, tmp_path):
    history = relation(spark, DATA, "history").select("history_id", "job_id", "occurred_at", "action_name")
    history.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    got = lifecycle.run_to_table(lifecycle.result_stream(stream), spark, str(tmp_path / "out"))
    counts = {r["outcome"]: r["count"] for r in got.groupBy("outcome").count().collect()}
    batch = lifecycle.lifecycle_replay(history).groupBy().sum("results", "repeated", "rejected").first()
    assert counts["ALREADY_APPLIED"] == batch[1] and counts["REJECTED"] == batch[2] and sum(counts.values()) == batch[0]


def test_old_targets_are_forgotten(spark, tmp_path):
    """Target 1 is known while the stream is within 30 days of its last result; 100 days on it starts anew."""
    batches = [
        [(1, 1, "2024-01-01", "SUCCEEDED")],
        [(1, 2, "2024-01-20", "FAILED"), (2, 3, "2024-02-15", "FAILED")],
        [(1, 4, "2024-02-16", "SUCCEEDED"), (3, 5, "2024-06-01", "FAILED")],
        [(1, 6, "2024-06-02", "FAILED"), (3, 7, "2024-05-20", "SUCCEEDED")],
    ]
    schema = "job_id bigint, history_id bigint, occurred_at string, action_name string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        stream = spark.readStream.schema("job_id bigint, history_id bigint, occurred_at timestamp_ntz, action_name string").parquet(str(tmp_path / "in/*"))
        got = lifecycle.run_to_table(lifecycle.result_stream(stream), spark, str(tmp_path / "out"))
    outcomes = {r["history_id"]: r["outcome"] for r in got.collect()}
    assert outcomes == {1: "APPLIED", 2: "REJECTED", 3: "APPLIED", 4: "ALREADY_APPLIED", 5: "APPLIED", 6: "APPLIED", 7: "REJECTED"}


def test_windows_and_replays(spark, tmp_path):
    history = relation(spark, DATA, "history").selectExpr("history_id", "CAST(occurred_at AS TIMESTAMP) AS at", "action_name")
    history.write.parquet(str(tmp_path / "in"))
    history.write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    once = lifecycle.run_to_table(lifecycle.deduplicated(read(), "60 days"), spark, str(tmp_path / "one"))
    assert once.count() == history.count()
    windows = lifecycle.run_to_table(lifecycle.windowed_counts(read(), "0 seconds"), spark, str(tmp_path / "two"))
    assert 0 < windows.groupBy().sum("n").first()[0] <= 2 * history.count()


SCRIPTS = [
    (folds.claim_fold, [(0, "acquire", "", 0, "ACQUIRED:1"), (10, "acquire", "", 0, "IN_PROGRESS"), (20, "release", "", 2, "REFUSED"), (21, "release", "", 1, "APPLIED"), (22, "acquire", "", 0, "ACQUIRED:2"), (90, "acquire", "", 0, "ACQUIRED:3"), (91, "complete", "", 2, "REFUSED"), (92, "complete", "", 3, "APPLIED"), (99, "acquire", "", 0, "COMPLETED")]),
    (folds.lease_fold, [(0, "acquire", "a", 0, "TOKEN:1"), (5, "acquire", "b", 0, "HELD"), (6, "acquire", "a", 0, "TOKEN:1"), (40, "renew", "a", 1, "REFUSED"), (41, "acquire", "b", 0, "TOKEN:2"), (42, "renew", "a", 1, "REFUSED"), (43, "release", "b", 2, "APPLIED"), (44, "acquire", "a", 0, "TOKEN:3")]),
    (folds.target_fold, [(0, "ack", "", 0, "APPLIED"), (1, "ack", "", 0, "ALREADY_APPLIED"), (2, "complete", "FAILED", 0, "APPLIED"), (3, "complete", "FAILED", 0, "ALREADY_APPLIED"), (4, "complete", "SUCCEEDED", 0, "REJECTED"), (5, "ack", "", 0, "REJECTED")]),
]


@pytest.mark.parametrize("fold, script", SCRIPTS)
def test_folds(spark, tmp_path, fold, script):
    rows = [(key, seq, at, op, owner, token) for key in (1, 2) for seq, (at, op, owner, token, _) in enumerate(script)]
    commands = spark.createDataFrame(rows, "key bigint, seq bigint, at bigint, op string, owner string, token bigint")
    want = {(key, seq): x[4] for key in (1, 2) for seq, x in enumerate(script)}
    assert {(r["key"], r["seq"]): r["outcome"] for r in folds.fold_batch(commands, fold).collect()} == want
    half = len(script) // 2
    for k, part in enumerate((f"seq < {half}", f"seq >= {half}")):
        commands.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        stream = spark.readStream.schema(commands.schema).parquet(str(tmp_path / "in/*"))
        got = lifecycle.run_to_table(folds.fold_stream(stream, fold), spark, str(tmp_path / "out"))
    assert {(r["key"], r["seq"]): r["outcome"] for r in got.collect()} == want


def test_deadlines(spark, tmp_path):
    """Key 1 ends in time, key 2 expires, key 3 is kept alive by a later event until it expires too."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, at(0), "start", at(30)), (2, at(0), "start", at(30)), (3, at(0), "start", at(30))],
        [(1, at(20), "done", at(30)), (3, at(25), "beat", at(90))],
        [(9, at(60), "start", at(3000))],
        [(9, at(61), "start", at(3000))],
        [(9, at(120), "start", at(3000))],
        [(9, at(121), "start", at(3000))],
    ]
    ddl = "key bigint, at string, op string, deadline string"
    schema = "key bigint, at timestamp, op string, deadline timestamp"
    outcomes = []
    for k, rows in enumerate(batches):
        typed = spark.createDataFrame(rows, ddl).selectExpr("key", "CAST(at AS TIMESTAMP) AS at", "op", "CAST(deadline AS TIMESTAMP) AS deadline")
        typed.coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        got = lifecycle.run_to_table(deadlines.expire(stream), spark, str(tmp_path / "out"))
        outcomes.append({(r["key"], r["outcome"]) for r in got.collect()})
    assert outcomes[1] == {(1, "DONE")}
    assert outcomes[-1] == {(1, "DONE"), (2, "EXPIRED"), (3, "EXPIRED")}


def test_handlers(spark, tmp_path):
    handlers, seen = Handlers(), {}

    @handlers.register("clean-up")
    def clean(rows):
        seen["clean-up"] = sorted(r["id"] for r in rows.collect())

    @handlers.register("report")
    def report(rows):
        seen["report"] = rows.count()

    with pytest.raises(ValueError):
        handlers.register("report")(report)
    rows = spark.createDataFrame([(1, "clean-up"), (2, "report"), (3, "clean-up")], "id int, handler_name string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    handlers.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == {"clean-up": [1, 3], "report": 1}
    with pytest.raises(LookupError):
        handlers.run_batch(rows.selectExpr("id", "'unknown' AS handler_name"))
