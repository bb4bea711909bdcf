"""Literal rows for branches that the driver's tables do not reach."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, joins, temporal, transitions, windows
from tidewheel.plans.query import TERMINAL

ALL = ("DISPATCHING", "DISPATCHED", "RUNNING", *TERMINAL)


def allowed(old, new):
    if old == new:
        return True
    if old in TERMINAL or new == "DISPATCHING":
        return False
    return new != "DISPATCHED" or old == "DISPATCHING"


def test_transition_matrix(spark):
    rows = spark.createDataFrame(list(itertools.product(ALL, ALL)), "old string, new string")
    for r in rows.withColumn("ok", transitions.may_become(F.col("old"), F.col("new"))).collect():
        assert r["ok"] == allowed(r["old"], r["new"]), r


@pytest.mark.parametrize(
    "policy, expected, children, status",
    [
        ("ANY_SUCCESS", 3, ["FAILED", "SUCCEEDED"], "SUCCEEDED"),
        ("ANY_SUCCESS", 2, ["FAILED", "TIMEOUT"], "FAILED"),
        ("QUORUM", 3, ["SUCCEEDED", "SUCCEEDED"], "SUCCEEDED"),
        ("QUORUM", 4, ["SUCCEEDED", "SUCCEEDED", "FAILED", "FAILED"], "FAILED"),
        ("QUORUM", 3, ["SUCCEEDED", "RUNNING"], "RUNNING"),
        ("ALL_SUCCESS", 2, ["SUCCEEDED", "SUCCEEDED"], "SUCCEEDED"),
        ("ALL_SUCCESS", 2, ["FAILED", "TIMEOUT"], "FAILED"),
        ("ALL_SUCCESS", 2, ["SUCCEEDED", "TIMEOUT"], "PARTIAL"),
        ("ALL_SUCCESS", 2, ["DISPATCHED", "SUCCEEDED"], "DISPATCHED"),
        ("ALL_SUCCESS", 2, ["CANCELLED", "SUCCEEDED"], "DISPATCHED"),
        ("ALL_SUCCESS", 2, [], "DISPATCHED"),
    ],
)
def test_fan_in(spark, policy, expected, children, status):
    parents = spark.createDataFrame([(1, "RUNNING", policy, expected), (2, "CANCELLED", policy, expected)], "execution_id int, status string, completion_policy string, expected_targets int")
    targets = spark.createDataFrame([(k, c) for k in (1, 2) for c in children], "execution_id int, status string")
    got = {r["execution_id"]: r["next_status"] for r in aggregates.fan_in(parents, targets).collect()}
    assert got == {1: status, 2: "CANCELLED"}


def test_due_batch_ties(spark):
    rows = [(k, True, "2024-01-30 00:00:00") for k in range(7)] + [(8, True, "2024-01-30 12:00:00"), (9, False, "2024-01-29 00:00:00"), (10, True, "2024-02-02 00:00:00")]
    jobs = spark.createDataFrame(rows, "job_id int, enabled boolean, t string").withColumn("next_fire_time", F.col("t").cast("timestamp_ntz"))
    got = windows.due_batch(jobs, 5).collect()
    assert [r["job_id"] for r in got] == [0, 1, 2, 3, 4] and all(r["truncated"] for r in got)
    got = windows.due_batch(jobs.where("job_id > 4"), 5).collect()
    assert [r["job_id"] for r in got] == [5, 6] and not any(r["truncated"] for r in got)
    assert windows.due_batch(jobs.where("job_id = 10"), 5).count() == 0


def test_no_job_is_left_out(spark):
    """Fires and timeouts of jobs whatever their id; only a job that is missing expires its executions now."""
    jobs = spark.createDataFrame([(k, "2024-01-30 08:00:00", 90) for k in (3, 17, 20, 340, 5000)], "job_id int, t string, timeout_s int").withColumn("next_fire_time", F.col("t").cast("timestamp_ntz"))
    fires = temporal.cron_fires(jobs, "0 0 9 * * *", "UTC", 1).collect()
    assert {r["job_id"]: str(r["fire_time"]) for r in fires} == {k: "2024-01-30 09:00:00" for k in (3, 17, 20, 340, 5000)}
    runs = spark.createDataFrame([(1, 17, "2024-01-30 08:00:00", None), (2, 340, "2024-01-30 08:00:00", None), (3, 3, "2024-01-30 08:00:00", "2024-01-30 10:00:00"), (4, 99, "2024-01-30 08:00:00", None)], "execution_id int, job_id int, d string, t string")
    runs = runs.select("execution_id", "job_id", F.col("d").cast("timestamp_ntz").alias("dispatch_time"), F.col("t").cast("timestamp_ntz").alias("timeout_at"))
    got = {r["execution_id"]: str(r["timeout_at"]) for r in joins.timeout_backfill(runs, jobs).collect()}
    assert got == {1: "2024-01-30 08:01:30", 2: "2024-01-30 08:01:30", 3: "2024-01-30 10:00:00", 4: "2024-01-31 00:00:00"}
