"""Orders, limits and ranks. A limit here is the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.query import now, query
from .filters import CLAIMABLE, claimable, is_due, is_terminal


@query(
    "w01_due_batch",
    "jobs",
    """WITH d AS (SELECT job_id, next_fire_time FROM jobs WHERE enabled AND next_fire_time <= {now}), f AS (SELECT d.* FROM d WHERE next_fire_time = (SELECT min(next_fire_time) FROM d))
       SELECT job_id, next_fire_time, (SELECT count(*) FROM f) > 5 AS truncated FROM f ORDER BY job_id LIMIT 5""",
    hard=5,
)
def due_batch(jobs: DataFrame, hard: int) -> DataFrame:
    """Due jobs that share the first fire time, at most ``hard``, flagged if there are more.

    A soft limit never splits jobs of one time, and a batch has no other, so only the hard limit cuts.

    The minimum is an aggregate, so only ties are sorted.
    """
    rows = jobs.where(is_due()).select("job_id", "next_fire_time")
    first = rows.groupBy("next_fire_time").agg(F.count(F.lit(1)).alias("ties")).orderBy("next_fire_time").limit(1)
    ties = rows.join(F.broadcast(first), "next_fire_time")  # one row
    return ties.select("job_id", "next_fire_time", (F.col("ties") > hard).alias("truncated")).orderBy("job_id").limit(hard)


@query("w02_poll_due", "jobs", "SELECT job_id, next_fire_time FROM jobs WHERE enabled AND next_fire_time <= {now} ORDER BY next_fire_time, job_id LIMIT 20", budget=20)
def poll_due(jobs: DataFrame, budget: int) -> DataFrame:
    return jobs.where(is_due()).select("job_id", "next_fire_time").orderBy("next_fire_time", "job_id").limit(budget)


@query("w03_next_fire", "jobs", "SELECT min(next_fire_time) AS next_fire FROM jobs WHERE enabled")
def next_fire(jobs: DataFrame) -> DataFrame:
    return jobs.where("enabled").agg(F.min("next_fire_time").alias("next_fire"))


def newest(rows: DataFrame, time: str, key: str, most: int, key_descends: bool = True) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col(key).desc() if key_descends else F.col(key)).limit(most)


@query("w04_recent_executions", "executions", "SELECT execution_id, created_at FROM executions ORDER BY created_at DESC, execution_id DESC LIMIT 100")
def recent_executions(executions: DataFrame) -> DataFrame:
    return newest(executions.select("execution_id", "created_at"), "created_at", "execution_id", 100)


@query("w05_attempts", "executions", "SELECT root_execution_id, run_attempt, execution_id FROM executions WHERE root_execution_id = 300 ORDER BY run_attempt, created_at, execution_id", root=300)
def attempts(executions: DataFrame, root: int) -> DataFrame:
    return executions.where(F.col("root_execution_id") == root).orderBy("run_attempt", "created_at", "execution_id").select("root_execution_id", "run_attempt", "execution_id")


@query("w06_dead_letters", "outbox", "SELECT outbox_id, updated_at, last_error FROM outbox WHERE status = 'DEAD' ORDER BY updated_at DESC, outbox_id LIMIT 100")
def dead_letters(outbox: DataFrame) -> DataFrame:
    return newest(outbox.where("status = 'DEAD'").select("outbox_id", "updated_at", "last_error"), "updated_at", "outbox_id", 100, False)


@query("w07_audit_top", "history", "SELECT history_id, occurred_at, action_name FROM history ORDER BY occurred_at DESC, history_id DESC LIMIT 200")
def audit_top(history: DataFrame) -> DataFrame:
    return newest(history.select("history_id", "occurred_at", "action_name"), "occurred_at", "history_id", 200)


@query("w08_job_history", "history", "SELECT job_id, history_id FROM history QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, history_id DESC) <= 10", most=10)
def job_history(history: DataFrame, most: int) -> DataFrame:
    """The newest entries of every job; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("occurred_at").desc(), F.col("history_id").desc()))
    return history.withColumn("k", rank).where(F.col("k") <= most).select("job_id", "history_id")


@query("w09_latest_location", "instances", "SELECT executor_name, instance_id FROM instances QUALIFY row_number() OVER (PARTITION BY executor_name ORDER BY last_heartbeat_at DESC, instance_id DESC) = 1")
def latest_location(instances: DataFrame) -> DataFrame:
    return instances.groupBy("executor_name").agg(F.max_by("instance_id", F.struct("last_heartbeat_at", "instance_id")).alias("instance_id"))


@query("w10_timeout_order", "executions", "SELECT execution_id, timeout_at FROM executions WHERE status NOT IN {terminal} ORDER BY timeout_at NULLS FIRST, execution_id LIMIT 50")
def timeout_order(executions: DataFrame, most: int = 50) -> DataFrame:
    return executions.where(~is_terminal()).select("execution_id", "timeout_at").orderBy(F.col("timeout_at").asc_nulls_first(), "execution_id").limit(most)


@query("w11_claim_order", "outbox", f"SELECT outbox_id, available_at FROM outbox WHERE {CLAIMABLE} ORDER BY available_at, outbox_id LIMIT 50")
def claim_order(outbox: DataFrame, most: int = 50) -> DataFrame:
    return outbox.where(claimable()).select("outbox_id", "available_at").orderBy("available_at", "outbox_id").limit(most)


@query("w12_retention_order", "executions", "SELECT execution_id, updated_at FROM executions WHERE status IN {terminal} AND updated_at < TIMESTAMP_NTZ '1999-01-01 00:00:00' ORDER BY updated_at, execution_id LIMIT 100", before="1999-01-01 00:00:00")
def retention_order(executions: DataFrame, before: str, most: int = 100) -> DataFrame:
    old = is_terminal() & (F.col("updated_at") < F.expr(f"TIMESTAMP_NTZ '{before}'"))
    return executions.where(old).select("execution_id", "updated_at").orderBy("updated_at", "execution_id").limit(most)


#: The zones that a blank search lists first, in this order.
PREFERRED_ZONES = ["UTC", "Asia/Shanghai", "Asia/Hong_Kong", "Asia/Tokyo", "Asia/Singapore", "Europe/London", "Europe/Paris", "America/New_York", "America/Los_Angeles"]
SEPARATORS = "/_ -"


def search_score(name: Column, wanted: str) -> Column:
    """0 equal, 1 prefix, 2 prefix of a part, 3 contained, 4 subsequence without separators, null otherwise.

    A blank search scores preferred names by their place and all others 100.
    """
    if not wanted:
        at = F.array_position(F.array(*[F.lit(z) for z in PREFERRED_ZONES]), name).cast("int")
        return F.when(at > 0, at - 1).otherwise(100)
    low = F.lower(name)
    part = F.exists(F.split(low, "[/_-]"), lambda x: x.startswith(wanted))
    loose = "(?s)" + ".*".join(c if c.isalnum() else "\\" + c for c in wanted if c not in SEPARATORS)
    close = F.translate(low, SEPARATORS, "").rlike(loose)
    return F.when(low == wanted, 0).when(low.startswith(wanted), 1).when(part, 2).when(low.contains(wanted), 3).when(close, 4)


@query(
    "w15_name_search",
    "nation",
    """SELECT n_name, CASE WHEN lower(n_name) = 'nation_1' THEN 0 WHEN starts_with(lower(n_name), 'nation_1') THEN 1
         WHEN len(list_filter(regexp_split_to_array(lower(n_name), '[/_-]'), lambda x: starts_with(x, 'nation_1'))) > 0 THEN 2
         WHEN contains(lower(n_name), 'nation_1') THEN 3 WHEN regexp_matches(translate(lower(n_name), '/_ -', ''), 'n.*a.*t.*i.*o.*n.*1') THEN 4 END AS score
       FROM nation WHERE score IS NOT NULL ORDER BY score, n_name LIMIT 100""",
    column="n_name",
    wanted="nation_1",
)
@query(
    "w15b_zone_search",
    "jobs",
    "SELECT zone, CASE zone WHEN 'UTC' THEN 0 WHEN 'America/New_York' THEN 7 ELSE 100 END AS score FROM (SELECT DISTINCT zone FROM jobs) ORDER BY score, zone LIMIT 100",
    column="zone",
    wanted=" ",
)
def name_search(names: DataFrame, column: str, wanted: str, most: int = 100) -> DataFrame:
    """The best names for a search, as zones are searched: by score, then by name."""
    found = names.select(column).distinct().where(F.col(column).isNotNull())
    return found.select(column, search_score(F.col(column), wanted.strip().lower()).alias("score")).where("score is not null").orderBy("score", column).limit(most)


@query("t10_tick_budget", "jobs", "SELECT job_id, (SELECT count(*) FROM jobs WHERE enabled AND next_fire_time <= {now}) > 20 AS backlog FROM jobs WHERE enabled AND next_fire_time <= {now} ORDER BY next_fire_time, job_id LIMIT 20", budget=20)
def tick(jobs: DataFrame, budget: int) -> DataFrame:
    """One tick's jobs and whether more were due than the budget allows."""
    backlog = jobs.where(is_due()).agg((F.count(F.lit(1)) > budget).alias("backlog")).withColumn("one", F.lit(1))
    return poll_due(jobs, budget).withColumn("one", F.lit(1)).join(backlog, "one").select("job_id", "backlog")


@query("t11_wake_delay", "jobs", "SELECT CAST(greatest(1, least(500, coalesce(date_diff('millisecond', {now}, min(next_fire_time)), 500))) AS BIGINT) AS wake_ms FROM jobs WHERE enabled")
def wake_delay(jobs: DataFrame, most: int = 500) -> DataFrame:
    wait = F.coalesce(F.timestamp_diff("MILLISECOND", now(), F.min("next_fire_time")), F.lit(most).cast("long"))
    return jobs.where("enabled").agg(F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), wait)).alias("wake_ms"))
