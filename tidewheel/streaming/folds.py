"""State machines that need the order of a key's commands: claims, leases and target messages.

A fold is a function (state, command) -> (state, outcome). In batch, rows are dealt by key and sorted, and
a task walks them once with the state of the current key only, so no key's history is held. As a
stream, the state of each key is kept by Spark between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.query import query
from .lifecycle import hold

State = tuple | None
Fold = Callable[[State, object], tuple[State, str]]
OUTCOME = "key bigint, seq bigint, outcome string"


def claim_fold(state: State, c) -> tuple[State, str]:
    """Idempotency claims: state (status, generation, until); a completed key is final, an expired or released one is claimed anew."""
    if c.op == "acquire":
        if state is None:
            return ("IN_PROGRESS", 1, c.at + 60), "ACQUIRED:1"
        status, generation, until = state
        if status == "COMPLETED":
            return state, "COMPLETED"
        if status == "IN_PROGRESS" and until > c.at:
            return state, "IN_PROGRESS"
        return ("IN_PROGRESS", generation + 1, c.at + 60), f"ACQUIRED:{generation + 1}"
    if state is None or state[0] != "IN_PROGRESS" or state[1] != c.token:
        return state, "REFUSED"
    return ("COMPLETED" if c.op == "complete" else "FAILED", state[1], state[2]), "APPLIED"


def lease_fold(state: State, c) -> tuple[State, str]:
    """Shard leases: state (owner, token, until); a live lease stays with its owner, any other acquire raises the token."""
    if c.op == "acquire":
        if state is None:
            return (c.owner, 1, c.at + 30), "TOKEN:1"
        owner, token, until = state
        if until > c.at and owner != c.owner:
            return state, "HELD"
        token += 0 if until > c.at else 1
        return (c.owner, token, c.at + 30), f"TOKEN:{token}"
    if state is None or (state[0], state[1]) != (c.owner, c.token) or (c.op == "renew" and state[2] < c.at):
        return state, "REFUSED"
    return (state[0], state[1], c.at + 30 if c.op == "renew" else -1), "APPLIED"


def target_fold(state: State, c) -> tuple[State, str]:
    """Target messages: state (status, 0, 0); a first acknowledgement runs the target, a first result ends it."""
    status = state[0] if state else "DISPATCHED"
    if c.op == "ack":
        if status == "DISPATCHED":
            return ("RUNNING", 0, 0), "APPLIED"
        return state, "ALREADY_APPLIED" if status == "RUNNING" else "REJECTED"
    if status in ("DISPATCHED", "RUNNING"):
        return (c.owner, 0, 0), "APPLIED"
    return state, "ALREADY_APPLIED" if status == c.owner else "REJECTED"


def fold_batch(commands: DataFrame, fold: Fold) -> DataFrame:
    """Outcomes of commands (key, seq, at, op, owner, token), each key's in order of seq."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            outcomes = []
            for c in frame.itertuples(index=False):
                if c.key != key:
                    key, state = c.key, None
                state, outcome = fold(state, c)
                outcomes.append(outcome)
            yield pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "outcome": outcomes})

    dealt = commands.select("key", "seq", "at", "op", "owner", "token").repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(walk, OUTCOME)


def fold_stream(commands: DataFrame, fold: Fold, keep: str = "30 days") -> DataFrame:
    """The same for a stream; a batch's commands of a key are taken in order of seq.

    The state of a key goes once the stream is ``keep`` past its last command; commands that far behind the stream are not taken any more.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        *state, last = kept.get if kept.exists else (0,)
        state = tuple(state) or None
        rows, outcomes = pd.concat(list(frames)).sort_values("seq"), []
        for c in rows.itertuples(index=False):
            state, outcome = fold(state, c)
            outcomes.append(outcome)
        if state is not None:
            hold(kept, (*state, max(last, (int(rows["at"].max()) + 1) * 1000)))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "outcome": outcomes})

    # a command's second has passed at its end; the watermark starts at the epoch, and what is not after it is late
    timed = commands.withColumn("event_time", F.timestamp_seconds(F.col("at") + 1)).withWatermark("event_time", keep)
    return timed.groupBy("key").applyInPandasWithState(step, OUTCOME, "status string, number bigint, until bigint, at_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)


def commands_of(history: DataFrame, ops: list[str], owners: list[str]) -> DataFrame:
    """Commands from history rows: the id picks the operation, owner and token."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(c, F.lit(len(xs))) + 1).cast("int"))
    at = F.unix_seconds(F.col("occurred_at").cast("timestamp"))
    return history.select(F.col("job_id").alias("key"), F.col("history_id").alias("seq"), at.alias("at"), pick(ops, F.col("history_id")).alias("op"), pick(owners, F.col("history_id").bitwiseXOR(F.col("job_id"))).alias("owner"), (F.pmod("history_id", F.lit(3)) + 1).alias("token"))


@query("d26_idempotency_claims", "history")
def idempotency_claims(history: DataFrame) -> DataFrame:
    return fold_batch(commands_of(history, ["acquire", "acquire", "complete", "acquire", "release"], ["a"]), claim_fold)


@query("d22b_lease_requests", "history")
def lease_requests(history: DataFrame) -> DataFrame:
    return fold_batch(commands_of(history, ["acquire", "renew", "acquire", "release"], ["node-1", "node-2"]), lease_fold)


@query("d16_target_messages", "history")
def target_messages(history: DataFrame) -> DataFrame:
    return fold_batch(commands_of(history, ["ack", "complete", "ack"], ["SUCCEEDED", "FAILED"]), target_fold)
