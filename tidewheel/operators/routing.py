"""Shards, rendezvous owners, and texts that name executions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import codecs
from ..functions.hashing import crc_shard, fnv1a64
from ..functions.rendezvous import Rendezvous, fnv1a64 as fnv1a64_of
from ..plans.query import now, query
from .filters import is_terminal


@query("e01_fnv_hash", "jobs")
def job_hash(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", fnv1a64(F.col("job_name")).alias("hash"))


@query("e02_crc_shard", "jobs", shards=100)
def job_shard(jobs: DataFrame, shards: int) -> DataFrame:
    return jobs.select("job_id", crc_shard(F.col("job_name"), shards).alias("shard"))


@query("d25_reshard", "jobs executions", shards=64)
def reshard(jobs: DataFrame, executions: DataFrame, shards: int) -> DataFrame:
    """New shards and versions of all jobs, if the cluster is quiet: while any execution is active, nothing moves."""
    active = executions.where(~is_terminal()).limit(1).agg((F.count(F.lit(1)) > 0).alias("busy")).withColumn("one", F.lit(1))
    moved = F.when(F.col("busy"), F.col("shard_id").cast("int")).otherwise(crc_shard(F.col("job_id").cast("string"), shards))
    met = jobs.withColumn("one", F.lit(1)).join(active, "one")
    return met.select("job_id", moved.alias("shard_id"), (F.col("version") + F.when(F.col("busy"), 0).otherwise(1)).alias("version"), (~F.col("busy")).alias("quiet"))


@query("d25b_reshard_quiet", "jobs executions", shards=64)
def reshard_quiet(jobs: DataFrame, executions: DataFrame, shards: int) -> DataFrame:
    """The same once all executions have ended; the caller then raises the stored revision and drops all leases."""
    return reshard(jobs, executions.where(is_terminal()), shards)


def owners(keys: DataFrame, nodes: DataFrame, key: str, node: str, separator: str, unsigned: bool) -> DataFrame:
    """Each key's node of the highest hash of key, separator and node; a null key has none.

    Only the names of the nodes, which one cluster has, come to the driver and go to every task; a task hashes
    each key once and finds its node by binary search.
    """
    names = [r[0] for r in nodes.select(node).where(F.col(node).isNotNull()).distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Rendezvous(names, not unsigned).best
        for batch in batches:
            found = best(fnv1a64_of([f"{k}{separator}" for k in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], [key, "owner"])

    texts = keys.select(key, F.col(key).cast("string").alias("text"))
    out = StructType([*keys.select(key).schema, StructField("owner", StringType())])
    return texts.mapInArrow(run, out).withColumn("owner", F.when(F.col(key).isNotNull(), F.col("owner")))


@query("w13_shard_owners", "nodes", shards=32)
def shard_owners(nodes: DataFrame, shards: int) -> DataFrame:
    """Rendezvous owner of every shard among live nodes; hashes compare as signed numbers."""
    live = nodes.where((F.col("status") == "ONLINE") & (F.col("last_heartbeat_at") >= now() - F.expr("INTERVAL '15' SECOND")))
    keys = nodes.sparkSession.range(shards).withColumnRenamed("id", "shard_id")
    return owners(keys, live, "shard_id", "node_id", ":", False)


@query("w14_routing_owners", "jobs instances")
def routing_owners(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    """Consistent-hash instance of every routing key; hashes compare as unsigned numbers."""
    live = instances.where((F.col("lease_until") > now()) & (F.col("executor_name") == "exec-1"))
    return owners(jobs.select(F.col("job_name").alias("routing_key")), live, "routing_key", "instance_id", "\x00", True)


@query("d24_reconcile", "nodes leases", shards=32)
def reconcile(nodes: DataFrame, leases: DataFrame, shards: int) -> DataFrame:
    """What to do with each shard's lease, given its preferred owner."""
    met = shard_owners(nodes, shards).join(leases, "shard_id", "left")
    live = F.col("lease_until") > now()
    action = F.when(live & (F.col("owner_node_id") == F.col("owner")), "RENEW").when(live, "RELEASE").otherwise("ACQUIRE")
    return met.select("shard_id", "owner", action.alias("action"))


@query("j09_shard_instances", "executions instances")
def shard_instances(executions: DataFrame, instances: DataFrame) -> DataFrame:
    """Each shard of an execution to the instance with the highest hash."""
    shards = executions.select("execution_id", F.explode(F.sequence(F.lit(0), F.col("expected_targets") - 1)).alias("shard_index"))
    keys = shards.withColumn("routing_key", F.concat_ws(":", "execution_id", "shard_index"))
    live = instances.where((F.col("lease_until") > now()) & (F.col("executor_name") == "exec-1"))
    return owners(keys.select("routing_key"), live, "routing_key", "instance_id", "\x00", True)


@query(
    "e08_execution_ids",
    "executions",
    """SELECT execution_id, concat(job_id, '@', strftime(scheduled_fire_time, '%Y-%m-%dT%H:%M:%SZ')) AS name, concat(root_execution_id, '@attempt:', run_attempt) AS attempt_name FROM executions""",
)
def execution_ids(executions: DataFrame) -> DataFrame:
    return executions.select("execution_id", F.concat("job_id", F.lit("@"), codecs.instant_text(F.col("scheduled_fire_time"))).alias("name"), F.concat("root_execution_id", F.lit("@attempt:"), "run_attempt").alias("attempt_name"))


@query("e09_map_codec", "jobs", "SELECT job_id, concat('group=', group_id, '&name=', replace(job_name, '#', '%23')) AS parameters FROM jobs")
def map_codec(jobs: DataFrame) -> DataFrame:
    made = F.create_map(F.lit("name"), "job_name", F.lit("group"), F.col("group_id").cast("string"))
    return jobs.select("job_id", codecs.encode_map(made).alias("parameters"))


@query(
    "e10_snapshot_codec",
    "jobs",
    """SELECT job_id, concat('{"schemaVersion":1,"payload":"', rtrim(replace(replace(to_base64(encode(p)), '+', '-'), '/', '_'), '='), '"}') AS snapshot, job_name AS name
       FROM (SELECT job_id, job_name, concat('group=', group_id, '&name=', replace(job_name, '#', '%23')) AS p FROM jobs)""",
)
def snapshot_codec(jobs: DataFrame) -> DataFrame:
    """A job's snapshot, and its name read back from it."""
    made = F.create_map(F.lit("name"), "job_name", F.lit("group"), F.col("group_id").cast("string"))
    coded = jobs.select("job_id", codecs.encode_snapshot(made).alias("snapshot"))
    return coded.withColumn("name", codecs.decode_snapshot(F.col("snapshot"))["name"])


@query("e14_retry_source_id", "executions", "SELECT execution_id, CASE WHEN run_attempt <= 2 THEN CAST(root_execution_id AS VARCHAR) ELSE concat(root_execution_id, '@attempt:', run_attempt - 1) END AS source FROM executions")
def retry_source_id(executions: DataFrame) -> DataFrame:
    """Attempt 2 follows the root itself, a later one the attempt before."""
    before = F.concat("root_execution_id", F.lit("@attempt:"), F.col("run_attempt") - 1)
    return executions.select("execution_id", F.when(F.col("run_attempt") <= 2, F.col("root_execution_id").cast("string")).otherwise(before).alias("source"))


@query("e15_status_fold", "history", "SELECT history_id, CASE WHEN upper(action_name) IN ('SUCCEEDED', 'CANCELLED') THEN upper(action_name) ELSE 'FAILED' END AS status FROM history")
def status_fold(history: DataFrame) -> DataFrame:
    name = F.upper("action_name")
    return history.select("history_id", F.when(name.isin("SUCCEEDED", "CANCELLED"), name).otherwise("FAILED").alias("status"))


@query("e16_error_text", "history", "SELECT history_id, substr(coalesce(nullif(props, '{}'), ''), 1, 4000) AS error FROM history")
def error_text(history: DataFrame) -> DataFrame:
    return history.select("history_id", F.substring(F.coalesce(F.nullif("props", F.lit("{}")), F.lit("")), 1, 4000).alias("error"))


@query("e17_idempotency_key", "targets executions jobs", "SELECT t.execution_id, t.shard_index, concat(root_execution_id, ':shard:', shard_index) AS key, CAST(root_execution_id AS VARCHAR) AS root_key, CASE WHEN regexp_extract(parameters, '(^|&)region=([^&]*)', 2) <> '' THEN concat(job_id, ':', regexp_extract(parameters, '(^|&)region=([^&]*)', 2)) END AS parameter_key FROM targets t JOIN executions USING (execution_id) JOIN jobs USING (job_id)")
def idempotency_keys(targets: DataFrame, executions: DataFrame, jobs: DataFrame) -> DataFrame:
    """The key of every target by each strategy."""
    met = targets.select("execution_id", "shard_index").join(executions.select("execution_id", "root_execution_id", "job_id"), "execution_id").join(jobs.select("job_id", "parameters"), "job_id")
    return met.select("execution_id", "shard_index", idempotency_key("SHARD").alias("key"), idempotency_key("ROOT").alias("root_key"), idempotency_key("PARAMETER", "region").alias("parameter_key"))


def idempotency_key(strategy: str, parameter: str = "") -> Column:
    """The key by a strategy: of the whole chain of attempts, of its shard, or of the job and one of its parameters (null without it)."""
    if strategy == "ROOT":
        return F.col("root_execution_id").cast("string")
    if strategy == "SHARD":
        return F.concat("root_execution_id", F.lit(":shard:"), "shard_index")
    if strategy == "PARAMETER":
        return F.concat("job_id", F.lit(":"), codecs.decode_map(F.col("parameters"))[parameter])
    raise ValueError(f"no strategy {strategy}")


@query("d32_random_routing", "executions", instances=3, seed=7)
def random_routing(executions: DataFrame, instances: int, seed: int) -> DataFrame:
    """A uniform instance for each dispatch, the same in every run."""
    return executions.select("execution_id", F.pmod(F.xxhash64("execution_id", F.lit(seed)), F.lit(instances)).alias("instance"))
