"""Scheduling relations over the driver's tables.

Each relation is one SELECT that Spark and DuckDB both run, so that a query and its SQL read the
same rows. All times are without zone and stand for UTC; ``now`` is the literal T0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

T0 = "2024-01-31 00:00:00"
_NOW = f"CAST('{T0}' AS TIMESTAMP_NTZ)"

RELATIONS = {
    "executions": f"""
SELECT o_orderkey AS execution_id, o_orderkey - o_orderkey % 3 AS root_execution_id, CAST(o_orderkey % 3 + 1 AS INT) AS run_attempt, o_custkey AS job_id,
  o_orderdate AS scheduled_fire_time, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate + (o_orderkey % 61 - 3) * INTERVAL '1' SECOND END AS dispatch_time,
  CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'DISPATCHING' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 1 THEN 'DISPATCHED' WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderkey % 4 = 0 THEN 'FAILED' WHEN o_orderkey % 4 = 1 THEN 'TIMEOUT' WHEN o_orderkey % 4 = 2 THEN 'CANCELLED' ELSE 'PARTIAL' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ANY_SUCCESS' WHEN '2' THEN 'QUORUM' ELSE 'ALL_SUCCESS' END AS completion_policy,
  CAST(1 + o_orderkey % 6 AS INT) AS expected_targets, CAST(o_orderkey % 4 AS INT) AS accepted_targets,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN {_NOW} + (o_orderkey % 1200 - 600) * INTERVAL '1' SECOND ELSE o_orderdate + (o_orderkey % 61 + 300) * INTERVAL '1' SECOND END AS timeout_at,
  o_orderkey % 13 = 0 AS retry_scheduled, concat('node-', o_orderkey % 5) AS owner_node_id, o_orderkey % 7 + 1 AS fencing_token,
  o_orderdate AS created_at, o_orderdate + (o_orderkey % 400) * INTERVAL '1' SECOND AS updated_at
FROM orders""",
    "targets": """
SELECT l_orderkey AS execution_id, l_linenumber AS shard_index, concat('inst-', l_suppkey) AS instance_id, concat('gw-', l_suppkey % 4) AS gateway_node_id,
  CASE WHEN l_returnflag = 'A' THEN 'SUCCEEDED' WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'F' THEN 'TIMEOUT' ELSE 'RUNNING' END AS status,
  l_linenumber % 2 = 0 OR l_returnflag <> 'N' AS acknowledged, l_partkey % 10 = 0 AS carried, CAST(l_partkey % 3 AS INT) AS attempt
FROM lineitem""",
    "jobs": f"""
SELECT c_custkey AS job_id, c_name AS job_name, CAST(c_nationkey AS BIGINT) AS group_id, c_custkey % 32 AS shard_id, (1 + c_custkey % 7) * 300 AS interval_s,
  CASE WHEN c_custkey % 3 = 0 THEN 'SKIP' WHEN c_custkey % 3 = 1 THEN 'FIRE_ONCE' ELSE 'CATCH_UP' END AS misfire_policy, c_custkey % 4 * 600 AS grace_s,
  CAST(1 + c_custkey % 5 AS INT) AS max_catch_up, CASE WHEN c_custkey % 2 = 0 THEN 'FORBID' ELSE 'ALLOW' END AS concurrency_policy, c_custkey % 10 <> 0 AS enabled,
  {_NOW} + (600 - (c_custkey * 37) % 7200) * INTERVAL '1' SECOND AS next_fire_time, 60 + c_custkey % 600 AS timeout_s,
  CASE WHEN c_custkey % 3 = 0 THEN 'UNICAST' WHEN c_custkey % 3 = 1 THEN 'BROADCAST' ELSE 'SHARDING' END AS dispatch_mode, CAST(1 + c_custkey % 4 AS INT) AS shard_count,
  concat('exec-', c_custkey % 7) AS executor_name, CASE WHEN c_custkey % 3 = 0 THEN concat('remote:exec-', c_custkey % 7, ':run:fast') WHEN c_custkey % 3 = 1 THEN 'clean-up' ELSE 'remote:broken' END AS handler_name,
  CASE c_custkey % 4 WHEN 0 THEN 'executorName=forced&handlerName=other' WHEN 1 THEN 'executorName=%20&handlerName=' WHEN 2 THEN 'region=eu' ELSE '' END AS parameters,
  CASE c_custkey % 6 WHEN 0 THEN '0 */20 9-10 * * MON-FRI' WHEN 1 THEN '0 0 12 * * *' WHEN 2 THEN '0 30 6 1 * *' WHEN 3 THEN '0 0 0 L 2 *' WHEN 4 THEN '30 15 8 ? * MON#2' ELSE '0 0 0 30 2 *' END AS schedule_value,
  CASE c_custkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Kolkata' ELSE 'UTC' END AS zone, c_custkey % 9 AS version,
  CASE c_custkey % 8 WHEN 0 THEN 'FIXED_DELAY' WHEN 1 THEN 'CRON' ELSE 'FIXED_RATE' END AS schedule_type
FROM customer""",
    "outbox": f"""
SELECT o_orderkey AS outbox_id, o_orderkey AS execution_id, o_custkey AS job_id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'PENDING' WHEN o_orderkey % 6 = 1 THEN 'CLAIMED' WHEN o_orderkey % 6 = 2 THEN 'SENT' WHEN o_orderkey % 6 = 3 THEN 'RETRY' WHEN o_orderkey % 6 = 4 THEN 'DONE' ELSE 'DEAD' END AS status,
  CAST(o_orderkey % 5 AS INT) AS attempt, CASE WHEN o_orderkey % 3 = 0 THEN 'LOCAL' ELSE 'REMOTE' END AS dispatch_type, {_NOW} + (o_orderkey % 900 - 600) * INTERVAL '1' SECOND AS available_at,
  CASE WHEN o_orderkey % 6 IN (1, 2) THEN concat('node-', o_orderkey % 5) END AS claim_owner,
  CASE WHEN o_orderkey % 6 = 1 THEN {_NOW} + (o_orderkey % 200 - 100) * INTERVAL '1' SECOND END AS claim_until,
  CASE WHEN o_orderkey % 6 = 2 THEN {_NOW} + (o_orderkey % 240 - 120) * INTERVAL '1' SECOND END AS ack_deadline,
  {_NOW} - (o_orderkey % 3600) * INTERVAL '1' SECOND AS dispatch_time, {_NOW} - (o_orderkey % 5000) * INTERVAL '1' SECOND AS updated_at,
  CASE WHEN o_orderkey % 6 = 5 THEN 'gave up' ELSE '' END AS last_error
FROM orders""",
    "nodes": f"""
SELECT concat('node-', s_suppkey) AS node_id, CASE WHEN s_suppkey % 4 < 2 THEN 'ONLINE' WHEN s_suppkey % 4 = 2 THEN 'DRAINING' ELSE 'OFFLINE' END AS status,
  {_NOW} - (s_suppkey % 20) * INTERVAL '1' SECOND AS last_heartbeat_at, CASE WHEN s_suppkey % 3 = 0 THEN 'GATEWAY,SCHEDULER' ELSE 'SCHEDULER' END AS roles, s_suppkey % 5 AS slot,
  CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN CAST(s_suppkey % 32 AS VARCHAR(20)) ELSE concat(s_suppkey % 32, ',', (s_suppkey + 11) % 32, CASE WHEN s_suppkey % 7 = 0 THEN ',31' ELSE '' END) END AS shards
FROM supplier""",
    "instances": f"""
SELECT concat('exec-', s_suppkey % 5) AS executor_name, concat('inst-', s_suppkey) AS instance_id, CASE WHEN s_suppkey % 7 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status,
  {_NOW} - (s_suppkey % 20) * INTERVAL '1' SECOND AS last_heartbeat_at, concat('gw-', s_suppkey % 4) AS gateway_node_id, concat('session-', s_suppkey % 3) AS session_id, {_NOW} + (s_suppkey % 9 - 3) * INTERVAL '1' SECOND AS lease_until,
  concat(' h', s_suppkey % 3, ' ,, h0,h', s_suppkey % 2) AS handler_names
FROM supplier""",
    "leases": f"""
SELECT s_suppkey AS shard_id, concat('node-', s_suppkey % 5) AS owner_node_id, {_NOW} + (s_suppkey % 7 - 2) * INTERVAL '10' SECOND AS lease_until, s_suppkey % 7 + 1 AS fencing_token
FROM supplier WHERE s_suppkey < 32""",
    "metadata": "SELECT 'jobs.revision' AS metadata_key, CAST(40 + r_regionkey AS VARCHAR(20)) AS metadata_value FROM region WHERE r_regionkey = 1",
    "job_groups": "SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS group_name, concat('exec-', n_nationkey % 9) AS executor_name FROM nation",
    "history": "SELECT event_id AS history_id, user_id AS job_id, ts AS occurred_at, event_type AS action_name, value, props FROM events",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation, or a table of the driver, as a DataFrame; filters and columns reach the scan."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = next(t for t in TABLES if re.search(rf"FROM {t}\b", RELATIONS[name]))
    return spark.sql(RELATIONS[name].replace(f"FROM {base}", "FROM {base}"), base=relation(spark, sf_dir, base))


def for_duckdb(sql: str) -> str:
    """SQL with the relations it names as leading WITH parts."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\b", sql)]
    sql = sql.strip()
    parts = [f"{n} AS ({RELATIONS[n]})" for n in used]
    if not parts:
        return sql.replace("TIMESTAMP_NTZ", "TIMESTAMP")
    body = sql[5:].lstrip() if sql.upper().startswith("WITH ") else None
    text = f"WITH {', '.join(parts)}" + (f", {body}" if body else f" {sql}")
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")
