"""Scans and projection sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.query import query
from .aggregates import dense_shards, job_gauges, latency_histogram, side_by_side
from .filters import live_nodes


@query("s01_job_scan", "jobs", "SELECT job_id, job_name, enabled, next_fire_time FROM jobs ORDER BY job_id")
def all_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "job_name", "enabled", "next_fire_time").orderBy("job_id")


@query("s02_sharded_scan", "jobs", "SELECT job_id, shard_id, next_fire_time FROM jobs WHERE enabled AND shard_id IN (1, 5, 9) ORDER BY next_fire_time, job_id", shards=[1, 5, 9])
@query("s02b_sharded_scan_all", "jobs", "SELECT job_id, shard_id, next_fire_time FROM jobs WHERE shard_id IN (1, 5, 9) ORDER BY next_fire_time, job_id", shards=[1, 5, 9], disabled=True)
def jobs_of_shards(jobs: DataFrame, shards: list[int], disabled: bool = False) -> DataFrame:
    """Jobs of some shards by next fire time; an empty list has none."""
    mine = F.col("shard_id").isin(shards) if shards else F.lit(False)
    return jobs.where(mine & (F.lit(True) if disabled else F.col("enabled"))).select("job_id", "shard_id", "next_fire_time").orderBy("next_fire_time", "job_id")


@query("s03_point_lookup", "executions", "SELECT * FROM executions WHERE execution_id = 42", key=42)
def find_execution(executions: DataFrame, key: int) -> DataFrame:
    return executions.where(F.col("execution_id") == key)


@query("s04_revision_probe", "metadata", "SELECT metadata_key AS name, CAST(metadata_value AS BIGINT) AS revision FROM metadata WHERE metadata_key = 'jobs.revision'")
def revision(metadata: DataFrame) -> DataFrame:
    """The stored revision, which every change and every delete of a job raises; it tells whether to load anew."""
    return metadata.where("metadata_key = 'jobs.revision'").select(F.col("metadata_key").alias("name"), F.col("metadata_value").cast("long").alias("revision"))


@query("s05_group_scan", "jobs", "SELECT job_id, group_id FROM jobs WHERE group_id = 7 ORDER BY job_id", group=7)
def jobs_of_group(jobs: DataFrame, group: int) -> DataFrame:
    return jobs.where(F.col("group_id") == group).select("job_id", "group_id").orderBy("job_id")


@query("s06_catalog_scan", "instances", "SELECT DISTINCT executor_name FROM instances ORDER BY executor_name")
def executors(instances: DataFrame) -> DataFrame:
    return instances.select("executor_name").distinct().orderBy("executor_name")


@query("s06b_groups", "job_groups", "SELECT group_id, group_name FROM job_groups ORDER BY group_id")
def groups_by_id(job_groups: DataFrame) -> DataFrame:
    return job_groups.select("group_id", "group_name").orderBy("group_id")


@query(
    "s10_metrics_text",
    "outbox",
    "SELECT concat('scheduler_outbox_rows{status=\"', status, '\"} ', n) AS line FROM (SELECT status, count(*) AS n FROM outbox GROUP BY status) ORDER BY line",
)
def metrics_text(outbox: DataFrame, metric: str = "scheduler_outbox_rows") -> DataFrame:
    """Exposition lines of a metric labelled by status."""
    counts = outbox.groupBy("status").count()
    return counts.select(F.format_string(metric + '{status="%s"} %d', "status", "count").alias("line")).orderBy("line")


@query(
    "s11_json_projection",
    "executions",
    """SELECT execution_id, concat('{"executionId":', execution_id, ',"jobId":', job_id, ',"status":"', status, '","runAttempt":', run_attempt, '}') AS json FROM executions""",
)
def execution_json(executions: DataFrame) -> DataFrame:
    row = F.struct(F.col("execution_id").alias("executionId"), F.col("job_id").alias("jobId"), "status", F.col("run_attempt").alias("runAttempt"))
    return executions.select("execution_id", F.to_json(row).alias("json"))


def json_sql(kind: str, key: str, fields: dict[str, str]) -> str:
    """SQL of a JSON text: names and columns, texts with a trailing '."""
    parts = ", ',', ".join(f"""'"{name}":"', {column[:-1]}, '"'""" if column.endswith("'") else f"""'"{name}":', {column}""" for name, column in fields.items())
    return f"SELECT {key} AS id, concat('{{', {parts}, '}}') AS json FROM {kind}"


def json_rows(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.to_json(F.struct(*[F.col(c.rstrip("'")).alias(name) for name, c in fields.items()])).alias("json"))


#: Names of the JSON forms; a trailing ' marks a text.
JOB = {"id": "job_id", "name": "job_name'", "enabled": "enabled", "misfirePolicy": "misfire_policy'", "concurrencyPolicy": "concurrency_policy'", "version": "version"}
TARGET = {"executionId": "execution_id", "shardIndex": "shard_index", "instanceId": "instance_id'", "gatewayNodeId": "gateway_node_id'", "status": "status'", "acknowledged": "acknowledged"}
NODE = {"nodeId": "node_id'", "status": "status'", "roles": "roles'"}
AUDIT = {"auditId": "history_id", "jobId": "job_id", "action": "action_name'"}


@query("s11b_job_json", "jobs", json_sql("jobs", "job_id", JOB), key="job_id", fields=JOB)
@query("s11c_target_json", "targets", json_sql("targets", "execution_id", TARGET), key="execution_id", fields=TARGET)
@query("s11d_node_json", "nodes", json_sql("nodes", "node_id", NODE), key="node_id", fields=NODE)
@query("s11e_audit_json", "history", json_sql("history", "history_id", AUDIT), key="history_id", fields=AUDIT)
def json_of(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    return json_rows(rows, key, fields)


#: Metric, help, and the column of the gauges that it shows.
GAUGES = [
    ("jobs_total", "Number of known jobs.", "total"),
    ("jobs_enabled", "Number of enabled jobs.", "enabled"),
    ("nodes_online", "Number of online nodes.", "online"),
    ("next_fire_time_epoch_seconds", "Earliest next fire time across known jobs.", "next_fire_s"),
    ("jobs_due_total", "Enabled jobs whose next fire time is due.", "due"),
    ("jobs_overdue_max_seconds", "Maximum overdue age among enabled due jobs.", "max_overdue_s"),
    ("dispatch_outbox_pending", "", "pending"),
    ("dispatch_outbox_dead", "", "dead"),
    ("executions_running", "", "running"),
    ("executions_failed", "", "failed"),
    ("dispatch_outbox_oldest_age_seconds", "Age of the oldest active outbox record.", "oldest_age_s"),
]


@query("s10b_exposition", "jobs nodes outbox executions", shards=32)
def exposition(jobs: DataFrame, nodes: DataFrame, outbox: DataFrame, executions: DataFrame, shards: int) -> DataFrame:
    """The whole exposition text by line: gauges with help and type, the delay histogram, and due jobs of every shard."""
    counts = jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"))
    live = live_nodes(nodes, 10).agg(F.count(F.lit(1)).alias("online"))
    row = side_by_side(job_gauges(jobs, outbox, executions), counts, live)
    row = row.withColumn("next_fire_s", F.coalesce(F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("next_fire")), F.lit(0).cast("long")))
    lines = [F.lit("# TYPE scheduler_up gauge"), F.lit('scheduler_up{plugin="metrics"} 1')]
    for name, about, column in GAUGES:
        lines += [F.lit(f"# HELP scheduler_{name} {about}")] * bool(about) + [F.lit(f"# TYPE scheduler_{name} gauge"), F.concat(F.lit(f"scheduler_{name} "), F.col(column).cast("string"))]
    one = row.select(F.posexplode(F.array(*lines)).alias("place", "line")).select(F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), "line")
    hist = latency_histogram(executions)
    name = "scheduler_schedule_delay_seconds"
    bound = F.when(F.col("le") > 1e300, "+Inf").otherwise(F.col("le").cast("string"))
    two = hist.select(F.lit(1).alias("part"), F.row_number().over(W.orderBy("le")).cast("long").alias("place"), F.concat(F.lit(name + '_bucket{le="'), bound, F.lit('"} '), "n").alias("line"))
    ends = hist.groupBy().agg(F.max("sum_s").alias("s"), F.max("observed").alias("n"), F.max("max_s").alias("m"))
    tail = F.array(F.concat(F.lit(f"{name}_sum "), F.coalesce("s", F.lit(0.0)).cast("string")), F.concat(F.lit(f"{name}_count "), "n"), F.concat(F.lit(f"{name}_max "), F.coalesce("m", F.lit(0.0)).cast("string")))
    three = ends.select(F.posexplode(tail).alias("place", "line")).select(F.lit(2).alias("part"), F.col("place").cast("long").alias("place"), "line")
    four = dense_shards(jobs, shards).select(F.lit(3).alias("part"), F.col("shard_id").alias("place"), F.concat(F.lit('scheduler_shard_due_jobs{shard="'), "shard_id", F.lit('"} '), "n").alias("line"))
    return one.unionByName(two).unionByName(three).unionByName(four).orderBy("part", "place")
