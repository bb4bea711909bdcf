"""Event-driven state: target results, idempotency claims and alert windows as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.query import query

RESULT = "job_id bigint, history_id bigint, outcome string"


def apply_results(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A target keeps its first result: the same again has been applied, any other is rejected."""
    if state.hasTimedOut:
        state.remove()
        return
    first, last = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["at_ms", "history_id"])
    outcomes = []
    for action in rows["action_name"]:
        if first is None:
            first = action
            outcomes.append("APPLIED")
        else:
            outcomes.append("ALREADY_APPLIED" if action == first else "REJECTED")
    hold(state, (first, max(last, int(rows["at_ms"].max()))))
    yield pd.DataFrame({"job_id": key[0], "history_id": rows["history_id"], "outcome": outcomes})


def hold(state: GroupState, value: tuple) -> None:
    """Keeps a value, whose last field is the latest event time of its key in ms, until the watermark has passed that time."""
    state.update(value)
    state.setTimeoutTimestamp(max(value[-1], state.getCurrentWatermarkMs()) + 1)


def result_stream(events: DataFrame, keep: str = "30 days") -> DataFrame:
    """Outcome of every result of a stream of history rows, with two values of state for each target.

    The state of a target goes once the stream is ``keep`` past its last result. Results that come later than that behind the
    stream are not taken any more, so no result meets a target that has been forgotten before its time.
    """
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", keep).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("job_id").applyInPandasWithState(apply_results, RESULT, "first string, at_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of a kind by window, closed once the watermark has passed it."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "action_name").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Replays of an event within the watermark are dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["history_id"])


def run_to_table(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, with its checkpoint beside its table, and reads the table."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


@query(
    "r02_lifecycle_replay",
    "history",
    """SELECT job_id, count(*) AS results, count(*) FILTER (WHERE k > 1 AND action_name = f) AS repeated, count(*) FILTER (WHERE action_name <> f) AS rejected
       FROM (SELECT job_id, action_name, row_number() OVER w AS k, first_value(action_name) OVER w AS f FROM history WINDOW w AS (PARTITION BY job_id ORDER BY occurred_at, history_id)) GROUP BY job_id""",
)
def lifecycle_replay(history: DataFrame) -> DataFrame:
    """The stream's outcomes for a bounded history, in one pass of aggregates."""
    first = history.groupBy("job_id").agg(F.min_by("action_name", F.struct("occurred_at", "history_id")).alias("first"))
    counts = history.groupBy("job_id", "action_name").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("action_name") == F.col("first")
    sums = counts.join(first, "job_id").groupBy("job_id")
    return sums.agg(F.sum("n").alias("results"), (F.sum(F.when(same, F.col("n")).otherwise(0)) - 1).alias("repeated"), F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("rejected"))


@query("r04_deduplicated", "history", "SELECT DISTINCT history_id FROM (SELECT * FROM history UNION ALL SELECT * FROM history WHERE history_id % 3 = 0)")
def deduplicated_replay(history: DataFrame) -> DataFrame:
    replayed = history.unionByName(history.where("history_id % 3 = 0"))
    return replayed.dropDuplicates(["history_id"]).select("history_id")
