"""Predicates and derived columns of scheduling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codecs import decode_map
from ..plans.query import TERMINAL, now, query


def is_due(at: Column | None = None) -> Column:
    return F.col("enabled") & (F.col("next_fire_time") <= (now() if at is None else at))


def is_terminal(status: str = "status") -> Column:
    return F.col(status).isin(*TERMINAL)


@query("f01_due", "jobs", "SELECT job_id, next_fire_time FROM jobs WHERE enabled AND next_fire_time <= {now}")
def due(jobs: DataFrame) -> DataFrame:
    """Enabled jobs whose cursor is not after now."""
    return jobs.where(is_due()).select("job_id", "next_fire_time")


@query("f02_due_excluding", "jobs", "SELECT job_id FROM jobs WHERE enabled AND next_fire_time <= {now} AND job_id NOT IN (1, 2, 3, 11)", excluded=[1, 2, 3, 11])
def due_excluding(jobs: DataFrame, excluded: list[int] | DataFrame) -> DataFrame:
    """Due jobs without some ids: a short list, or a DataFrame of ids of any size."""
    rows = jobs.where(is_due()).select("job_id")
    if isinstance(excluded, DataFrame):
        return rows.join(excluded, "job_id", "left_anti")
    return rows.where(~F.col("job_id").isin(excluded)) if excluded else rows


@query("f03_due_of_shards", "jobs", "SELECT job_id FROM jobs WHERE enabled AND next_fire_time <= {now} AND shard_id IN (0, 31)", shards=[0, 31])
@query("f03_due_of_no_shards", "jobs", "SELECT job_id FROM jobs WHERE false", shards=[])
def due_of_shards(jobs: DataFrame, shards: list[int]) -> DataFrame:
    mine = F.col("shard_id").isin(shards) if shards else F.lit(False)
    return jobs.where(is_due() & mine).select("job_id")


@query("f04_misfired", "jobs", "SELECT job_id FROM jobs WHERE enabled AND next_fire_time + grace_s * INTERVAL '1' SECOND < {now}")
def misfired(jobs: DataFrame) -> DataFrame:
    """Jobs whose grace has passed, strictly."""
    return jobs.where(F.col("enabled") & (F.col("next_fire_time") + F.expr("grace_s * INTERVAL '1' SECOND") < now())).select("job_id")


def claimable() -> Column:
    at = now()
    waiting = F.col("status").isin("PENDING", "RETRY")
    unanswered = (F.col("status") == "SENT") & (F.col("ack_deadline") <= at)
    abandoned = (F.col("status") == "CLAIMED") & (F.col("claim_until") <= at)
    return (F.col("available_at") <= at) & (waiting | unanswered | abandoned)


CLAIMABLE = "available_at <= {now} AND (status IN ('PENDING', 'RETRY') OR (status = 'SENT' AND ack_deadline <= {now}) OR (status = 'CLAIMED' AND claim_until <= {now}))"


@query("f05_claimable", "outbox", f"SELECT outbox_id, status FROM outbox WHERE {CLAIMABLE}")
def claimable_rows(outbox: DataFrame) -> DataFrame:
    return outbox.where(claimable()).select("outbox_id", "status")


@query("f06_live_nodes", "nodes", "SELECT node_id FROM nodes WHERE status = 'ONLINE' AND last_heartbeat_at >= {now} - INTERVAL '10' SECOND", seconds=10)
def live_nodes(nodes: DataFrame, seconds: int) -> DataFrame:
    """ONLINE with a heartbeat no older than the timeout, inclusive."""
    return nodes.where((F.col("status") == "ONLINE") & (F.col("last_heartbeat_at") >= now() - F.expr(f"INTERVAL '{seconds}' SECOND"))).select("node_id")


@query("f07_live_leases", "leases", "SELECT shard_id, owner_node_id FROM leases WHERE lease_until > {now}")
def live_leases(leases: DataFrame) -> DataFrame:
    return leases.where(F.col("lease_until") > now()).select("shard_id", "owner_node_id")


@query("f08_renewable_leases", "leases", "SELECT shard_id, fencing_token FROM leases WHERE owner_node_id = 'node-2' AND lease_until >= {now}", owner="node-2")
def renewable_leases(leases: DataFrame, owner: str) -> DataFrame:
    return leases.where((F.col("owner_node_id") == owner) & (F.col("lease_until") >= now())).select("shard_id", "fencing_token")


@query("f09_timed_out", "executions", "SELECT execution_id FROM executions WHERE status NOT IN {terminal} AND (timeout_at IS NULL OR timeout_at <= {now})")
def timed_out(executions: DataFrame) -> DataFrame:
    """Active executions past their time; one without a time is past it."""
    return executions.where(~is_terminal() & (F.col("timeout_at").isNull() | (F.col("timeout_at") <= now()))).select("execution_id")


@query("f10_terminal", "executions", "SELECT execution_id, status IN {terminal} AS terminal FROM executions")
def terminal_flags(executions: DataFrame) -> DataFrame:
    return executions.select("execution_id", is_terminal().alias("terminal"))


@query("f11_due_soon", "jobs", "SELECT job_id FROM jobs WHERE enabled AND next_fire_time BETWEEN {now} AND {now} + INTERVAL '300' SECOND", seconds=300)
def due_soon(jobs: DataFrame, seconds: int) -> DataFrame:
    return jobs.where(F.col("enabled") & F.col("next_fire_time").between(now(), now() + F.expr(f"INTERVAL '{seconds}' SECOND"))).select("job_id")


@query("f12_recent", "executions", "SELECT execution_id FROM executions WHERE coalesce(updated_at, dispatch_time, scheduled_fire_time, created_at) >= TIMESTAMP_NTZ '2001-07-01 00:00:00' - INTERVAL '30' DAY", at="2001-07-01 00:00:00", days=30)
def recent(executions: DataFrame, at: str, days: int) -> DataFrame:
    since = F.expr(f"TIMESTAMP_NTZ '{at}' - INTERVAL '{days}' DAY")
    return executions.where(F.coalesce("updated_at", "dispatch_time", "scheduled_fire_time", "created_at") >= since).select("execution_id")


@query("f13_carried", "targets", "SELECT execution_id, count(*) AS carried FROM (SELECT execution_id, concat(execution_id, CASE WHEN carried THEN '@carry:' ELSE '@shard:' END, shard_index) AS target_id FROM targets) WHERE contains(target_id, '@carry:') GROUP BY execution_id")
def carried_targets(targets: DataFrame) -> DataFrame:
    target_id = F.concat("execution_id", F.when(F.col("carried"), "@carry:").otherwise("@shard:"), "shard_index")
    return targets.where(target_id.contains("@carry:")).groupBy("execution_id").agg(F.count(F.lit(1)).alias("carried"))


@query(
    "f14_fenced_results",
    "executions targets jobs leases",
    """WITH r AS (SELECT execution_id, shard_index, instance_id, CASE WHEN shard_index % 3 = 0 THEN 'inst-x' ELSE instance_id END AS reporter FROM targets)
       SELECT r.execution_id, r.shard_index, r.instance_id = r.reporter AND e.status NOT IN {terminal} AND l.shard_id IS NOT NULL AS accepted FROM r JOIN executions e USING (execution_id) JOIN jobs j USING (job_id)
       LEFT JOIN leases l ON j.shard_id = l.shard_id AND e.owner_node_id = l.owner_node_id AND e.fencing_token = l.fencing_token""",
)
def reported_results(executions: DataFrame, targets: DataFrame, jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """A report of each target, some from an instance that is not its own."""
    reporter = F.when(F.col("shard_index") % 3 == 0, "inst-x").otherwise(F.col("instance_id"))
    return fenced_results(executions, targets.select("execution_id", "shard_index", "instance_id", reporter.alias("reporter")), jobs, leases)


def fenced_results(executions: DataFrame, reports: DataFrame, jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """Which reports (execution_id, shard_index, instance_id, reporter) count.

    The execution is active, its owner and token still hold the lease of its job's shard, and the target's own instance reports.
    """
    held = leases.select("shard_id", "owner_node_id", "fencing_token", F.lit(True).alias("held"))
    keyed = executions.select("execution_id", "job_id", "status", "owner_node_id", "fencing_token").join(jobs.select("job_id", "shard_id"), "job_id").join(held, ["shard_id", "owner_node_id", "fencing_token"], "left")
    accepted = (F.col("instance_id") == F.col("reporter")) & ~is_terminal() & F.col("held").isNotNull()
    return reports.join(keyed, "execution_id").select("execution_id", "shard_index", accepted.alias("accepted"))


@query(
    "f15_instance_status",
    "instances",
    """SELECT instance_id, CASE WHEN status = 'ONLINE' AND last_heartbeat_at >= {now} - INTERVAL '12' SECOND THEN 'ONLINE' ELSE 'OFFLINE' END AS derived_status,
       greatest(0, CAST(date_diff('second', last_heartbeat_at, {now}) AS BIGINT)) AS age_s FROM instances""",
)
def instance_status(instances: DataFrame, seconds: int = 12) -> DataFrame:
    fresh = (F.col("status") == "ONLINE") & (F.col("last_heartbeat_at") >= now() - F.expr(f"INTERVAL '{seconds}' SECOND"))
    age = F.timestamp_diff("SECOND", F.col("last_heartbeat_at"), now())
    return instances.select("instance_id", F.when(fresh, "ONLINE").otherwise("OFFLINE").alias("derived_status"), F.when(age.isNotNull(), F.greatest(F.lit(0).cast("long"), age)).alias("age_s"))


@query(
    "f16_handler_names",
    "jobs",
    """SELECT job_id, CASE WHEN trim(given_executor) <> '' THEN given_executor WHEN starts_with(handler_name, 'remote:') THEN split_part(handler_name, ':', 2) ELSE 'embedded' END AS executor,
       CASE WHEN trim(given_handler) <> '' THEN given_handler WHEN starts_with(handler_name, 'remote:') AND len(string_split(handler_name, ':')) >= 3 THEN regexp_extract(handler_name, '^[^:]*:[^:]*:(.*)$', 1) ELSE handler_name END AS handler
       FROM (SELECT *, replace(regexp_extract(parameters, '(^|&)executorName=([^&]*)', 2), '%20', ' ') AS given_executor, replace(regexp_extract(parameters, '(^|&)handlerName=([^&]*)', 2), '%20', ' ') AS given_handler FROM jobs)""",
)
def handler_names(jobs: DataFrame) -> DataFrame:
    """Executor and handler of a job: its parameters, if they are not blank, then the parts of ``remote:executor:handler``; any other name is an embedded handler."""
    given = decode_map(F.col("parameters"))
    parts = F.split("handler_name", ":", 3)
    remote = F.col("handler_name").startswith("remote:")
    of = lambda name: F.when(F.trim(given[name]) != "", given[name])
    return jobs.select(
        "job_id",
        F.coalesce(of("executorName"), F.when(remote, F.get(parts, 1)), F.lit("embedded")).alias("executor"),
        F.coalesce(of("handlerName"), F.when(remote & (F.size(parts) == 3), F.get(parts, 2)), F.col("handler_name")).alias("handler"),
    )


@query("f17_prefix", "jobs", "SELECT job_id, job_name FROM jobs WHERE job_name LIKE 'Customer#00000001%'", prefix="Customer#00000001")
def with_prefix(jobs: DataFrame, prefix: str) -> DataFrame:
    return jobs.where(F.col("job_name").startswith(prefix)).select("job_id", "job_name")


PLANNED = "SELECT job_id, next_fire_time, CASE WHEN enabled THEN 'SCHEDULED' ELSE 'DISABLED' END AS status FROM jobs WHERE NOT EXISTS (SELECT 1 FROM executions%s) ORDER BY next_fire_time, job_id LIMIT 50"


@query("f18_planned_rows", "jobs executions", PLANNED % " WHERE job_id < 0", job=-1)
@query("f18b_planned_beside_history", "jobs executions", PLANNED % "", job=None)
def planned_if_none(jobs: DataFrame, executions: DataFrame, job: int | None) -> DataFrame:
    """What a list shows where there are no executions yet, and where there are some: nothing then."""
    return planned_rows(jobs, executions if job is None else executions.where(F.col("job_id") <= job))


def planned_rows(jobs: DataFrame, history: DataFrame, most: int = 50) -> DataFrame:
    """What a list of executions shows before there are any: the earliest cursors."""
    first = jobs.select("job_id", "next_fire_time", F.when(F.col("enabled"), "SCHEDULED").otherwise("DISABLED").alias("status")).orderBy("next_fire_time", "job_id").limit(most)
    none = history.limit(1).agg((F.count(F.lit(1)) == 0).alias("none")).where("none").withColumn("one", F.lit(1))
    return first.withColumn("one", F.lit(1)).join(none, "one", "left_semi").drop("one")


@query("x05_executable", "jobs", "SELECT job_id, schedule_type IN ('CRON', 'FIXED_RATE') AS executable FROM jobs")
def executable(jobs: DataFrame) -> DataFrame:
    """Schedules of another type than these two are refused."""
    return jobs.select("job_id", F.col("schedule_type").isin("CRON", "FIXED_RATE").alias("executable"))
