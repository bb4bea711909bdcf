"""Joins and set operations of scheduling relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.query import now, query
from .filters import is_terminal


@query("j01_retry_source", "executions outbox", "SELECT execution_id, e.status AS status, run_attempt, o.attempt AS attempt FROM executions e JOIN outbox o USING (execution_id) WHERE e.status IN ('FAILED', 'PARTIAL', 'TIMEOUT')")
def retry_source(executions: DataFrame, outbox: DataFrame) -> DataFrame:
    failed = executions.where(F.col("status").isin("FAILED", "PARTIAL", "TIMEOUT")).select("execution_id", "status", "run_attempt")
    return failed.join(outbox.select("execution_id", "attempt"), "execution_id")


@query("j02_timeout_backfill", "executions jobs", "SELECT execution_id, coalesce(timeout_at, dispatch_time + timeout_s * INTERVAL '1' SECOND, {now}) AS timeout_at FROM executions LEFT JOIN jobs USING (job_id)")
def timeout_backfill(executions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Missing timeouts from the job; an execution whose job is gone expires now."""
    later = F.col("dispatch_time") + F.expr("timeout_s * INTERVAL '1' SECOND")
    return executions.join(jobs.select("job_id", "timeout_s"), "job_id", "left").select("execution_id", F.coalesce("timeout_at", later, now()).alias("timeout_at"))


@query("j03_lease_guard", "jobs leases", "SELECT job_id FROM jobs j WHERE EXISTS (SELECT 1 FROM leases l WHERE l.shard_id = j.shard_id AND l.owner_node_id = 'node-1' AND l.lease_until >= {now})", owner="node-1")
def lease_guard(jobs: DataFrame, leases: DataFrame, owner: str) -> DataFrame:
    held = leases.where((F.col("owner_node_id") == owner) & (F.col("lease_until") >= now()))
    return jobs.join(held, "shard_id", "left_semi").select("job_id")


@query("j04_live_execution_guard", "outbox executions", "SELECT outbox_id FROM outbox o WHERE EXISTS (SELECT 1 FROM executions e WHERE e.execution_id = o.execution_id AND e.status NOT IN {terminal} AND e.timeout_at > TIMESTAMP_NTZ '1998-01-01 00:00:00')", at="1998-01-01 00:00:00")
def live_execution_guard(outbox: DataFrame, executions: DataFrame, at: str) -> DataFrame:
    live = executions.where(~is_terminal() & (F.col("timeout_at") > F.expr(f"TIMESTAMP_NTZ '{at}'")))
    return outbox.join(live, "execution_id", "left_semi").select("outbox_id")


@query("j05_forbid_guard", "jobs executions", "SELECT job_id FROM jobs WHERE concurrency_policy = 'ALLOW' OR job_id NOT IN (SELECT job_id FROM executions WHERE status NOT IN {terminal})")
def forbid_guard(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Jobs that may start: all that allow overlap, and those that forbid it and have no active execution."""
    active = executions.where(~is_terminal()).select("job_id").distinct()
    return jobs.where("concurrency_policy = 'ALLOW'").select("job_id").unionByName(jobs.where("concurrency_policy <> 'ALLOW'").select("job_id").join(active, "job_id", "left_anti"))


@query("j06_seed_insert", "leases", "SELECT shard_id FROM leases UNION ALL SELECT CAST(i AS BIGINT) AS shard_id FROM range(32) t(i) WHERE i NOT IN (SELECT shard_id FROM leases)")
def seed_shards(leases: DataFrame, shards: int = 32) -> DataFrame:
    """Existing leases and a row for every shard that has none."""
    wanted = leases.sparkSession.range(shards).withColumnRenamed("id", "shard_id")
    return leases.select("shard_id").unionByName(wanted.join(leases, "shard_id", "left_anti"))


@query("j07_shard_lease", "jobs leases", "SELECT job_id, owner_node_id, fencing_token FROM jobs JOIN leases USING (shard_id)")
def shard_leases(jobs: DataFrame, leases: DataFrame) -> DataFrame:
    return jobs.join(leases, "shard_id").select("job_id", "owner_node_id", "fencing_token")


@query("j08_target_locations", "targets instances", "SELECT t.execution_id, t.shard_index, i.gateway_node_id FROM targets t JOIN instances i USING (instance_id) WHERE i.lease_until > {now}")
def target_locations(targets: DataFrame, instances: DataFrame) -> DataFrame:
    live = instances.where(F.col("lease_until") > now()).select("instance_id", "gateway_node_id")
    return targets.select("execution_id", "shard_index", "instance_id").join(live, "instance_id").select("execution_id", "shard_index", "gateway_node_id")


@query(
    "j10_instances_of_executors",
    "jobs instances",
    """SELECT executor_name, count(instance_id) AS bound, count(*) FILTER (WHERE status = 'ONLINE') AS online
       FROM (SELECT DISTINCT executor_name FROM jobs) LEFT JOIN instances USING (executor_name) GROUP BY executor_name""",
)
def instances_of_executors(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    counts = instances.groupBy("executor_name").agg(F.count("instance_id").alias("bound"), F.count_if(F.col("status") == "ONLINE").alias("online"))
    return jobs.select("executor_name").distinct().join(counts, "executor_name", "left").fillna(0, ["bound", "online"])


@query("j11_retry_predecessor", "executions", "SELECT e.execution_id, p.execution_id AS predecessor FROM executions e LEFT JOIN executions p ON p.root_execution_id = e.root_execution_id AND p.run_attempt = e.run_attempt - 1")
def retry_predecessor(executions: DataFrame) -> DataFrame:
    """The attempt before each one; none where that attempt is missing, even if an earlier one is there."""
    before = executions.select("root_execution_id", (F.col("run_attempt") + 1).alias("run_attempt"), F.col("execution_id").alias("predecessor"))
    return executions.join(before, ["root_execution_id", "run_attempt"], "left").select("execution_id", "predecessor")


@query(
    "u01_planned_and_carried",
    "targets",
    "SELECT execution_id, shard_index, 'carried' AS origin FROM targets WHERE carried UNION ALL SELECT execution_id, shard_index, 'planned' AS origin FROM targets WHERE NOT carried",
)
def planned_and_carried(targets: DataFrame) -> DataFrame:
    part = lambda rows, origin: rows.select("execution_id", "shard_index", F.lit(origin).alias("origin"))
    return part(targets.where("carried"), "carried").unionByName(part(targets.where("not carried"), "planned"))


@query(
    "u02_shards_to_retry",
    "executions targets",
    """SELECT execution_id, CAST(s AS INT) AS shard_index FROM executions, range(1, 7) r(s) WHERE s <= expected_targets
       EXCEPT SELECT execution_id, shard_index FROM targets WHERE status = 'SUCCEEDED'""",
)
def shards_to_retry(executions: DataFrame, targets: DataFrame) -> DataFrame:
    """Shards of each execution that have not succeeded."""
    wanted = executions.select("execution_id", F.explode(F.sequence(F.lit(1), "expected_targets")).alias("shard_index"))
    done = targets.where("status = 'SUCCEEDED'").select("execution_id", "shard_index")
    return wanted.join(done, ["execution_id", "shard_index"], "left_anti")


@query("u04_upsert", "jobs", "SELECT job_id, max(version) AS version FROM (SELECT job_id, version FROM jobs UNION ALL SELECT job_id + 100, version + 1 FROM jobs WHERE job_id % 5 = 0) GROUP BY job_id")
def upsert_jobs(jobs: DataFrame) -> DataFrame:
    """Old rows and changed rows, the highest version of each key."""
    old = jobs.select("job_id", "version")
    new = jobs.where("job_id % 5 = 0").select((F.col("job_id") + 100).alias("job_id"), (F.col("version") + 1).alias("version"))
    return upsert(old, new, "job_id", "version")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; a partial aggregate, so no key's history meets in a window."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), version).alias("r")).select(key, "r.*")
