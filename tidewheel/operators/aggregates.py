"""Aggregates of scheduling relations: counts, fan-in, histograms, percentiles, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.query import now, query
from .filters import is_due, is_terminal

#: Upper bounds of the latency histogram in seconds; the last bucket has none.
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0, 30.0)


def seconds_between(start: str, end: Column) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), end)


def count_of(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


@query("a01_outbox_status", "outbox", "SELECT status, count(*) AS n FROM outbox GROUP BY status")
@query("a02_execution_status", "executions", "SELECT status, count(*) AS n FROM executions GROUP BY status")
def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a03_due_by_shard", "jobs", "SELECT shard_id, count(*) AS n FROM jobs WHERE enabled AND next_fire_time <= {now} GROUP BY shard_id")
def due_by_shard(jobs: DataFrame) -> DataFrame:
    return jobs.where(is_due()).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))


@query("a04_dense_shards", "jobs", "SELECT CAST(i AS BIGINT) AS shard_id, count(job_id) AS n FROM range(64) t(i) LEFT JOIN (SELECT * FROM jobs WHERE enabled AND next_fire_time <= {now}) ON shard_id = i GROUP BY i", shards=64)
def dense_shards(jobs: DataFrame, shards: int) -> DataFrame:
    """Due jobs of every shard, with zeros."""
    every = jobs.sparkSession.range(shards).withColumnRenamed("id", "shard_id")
    return every.join(due_by_shard(jobs), "shard_id", "left").fillna(0, ["n"])


@query("a05_oldest_dispatch", "outbox", "SELECT min(dispatch_time) AS oldest FROM outbox WHERE status NOT IN ('DONE', 'DEAD')")
def oldest_dispatch(outbox: DataFrame) -> DataFrame:
    return outbox.where(~F.col("status").isin("DONE", "DEAD")).agg(F.min("dispatch_time").alias("oldest"))


@query("a06_owned_dispatches", "outbox", "SELECT claim_owner, count(*) AS n FROM outbox WHERE status IN ('CLAIMED', 'SENT') GROUP BY claim_owner")
def owned_dispatches(outbox: DataFrame) -> DataFrame:
    return outbox.where(F.col("status").isin("CLAIMED", "SENT")).groupBy("claim_owner").agg(F.count(F.lit(1)).alias("n"))


@query("a07_targets_by_gateway", "targets", "SELECT gateway_node_id, count(*) AS n FROM targets WHERE status NOT IN {terminal} GROUP BY gateway_node_id")
def targets_by_gateway(targets: DataFrame) -> DataFrame:
    return targets.where(~is_terminal()).groupBy("gateway_node_id").agg(F.count(F.lit(1)).alias("n"))


@query("a08_leases_by_owner", "leases", "SELECT owner_node_id, count(*) AS n FROM leases WHERE lease_until > {now} GROUP BY owner_node_id")
def leases_by_owner(leases: DataFrame) -> DataFrame:
    return leases.where(F.col("lease_until") > now()).groupBy("owner_node_id").agg(F.count(F.lit(1)).alias("n"))


FAN_IN_SQL = """
CASE WHEN completion_policy = 'ANY_SUCCESS' AND ok > 0 THEN 'SUCCEEDED' WHEN completion_policy = 'QUORUM' AND ok >= expected_targets // 2 + 1 THEN 'SUCCEEDED'
  WHEN ok + bad < expected_targets THEN CASE WHEN running > 0 THEN 'RUNNING' ELSE 'DISPATCHED' END
  WHEN completion_policy IN ('ANY_SUCCESS', 'QUORUM') THEN 'FAILED' WHEN bad = 0 THEN 'SUCCEEDED' WHEN ok = 0 THEN 'FAILED' ELSE 'PARTIAL' END"""


def fan_in_status() -> Column:
    """Status of an open parent from its targets: ok, bad and running counts against its policy, first rule first."""
    policy, ok, bad, expected = F.col("completion_policy"), F.col("ok"), F.col("bad"), F.col("expected_targets")
    return (
        F.when((policy == "ANY_SUCCESS") & (ok > 0), "SUCCEEDED")
        .when((policy == "QUORUM") & (ok >= F.floor(expected / 2) + 1), "SUCCEEDED")
        .when(ok + bad < expected, F.when(F.col("running") > 0, "RUNNING").otherwise("DISPATCHED"))
        .when(policy.isin("ANY_SUCCESS", "QUORUM"), "FAILED")
        .when(bad == 0, "SUCCEEDED")
        .when(ok == 0, "FAILED")
        .otherwise("PARTIAL")
    )


@query(
    "a09_fan_in",
    "executions targets",
    f"""WITH t AS (SELECT execution_id, count(*) FILTER (WHERE status = 'SUCCEEDED') AS ok, count(*) FILTER (WHERE status IN ('FAILED', 'TIMEOUT')) AS bad,
          count(*) FILTER (WHERE status = 'RUNNING') AS running FROM targets GROUP BY execution_id)
        SELECT execution_id, status AS stored_status, {FAN_IN_SQL} AS fan_in_status, CASE WHEN status IN {{terminal}} THEN status ELSE {FAN_IN_SQL} END AS next_status
        FROM (SELECT e.execution_id, e.status, e.completion_policy, e.expected_targets, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, coalesce(running, 0) AS running FROM executions e LEFT JOIN t USING (execution_id))""",
)
def fan_in(executions: DataFrame, targets: DataFrame) -> DataFrame:
    """Parents by their completion policy; a terminal parent keeps its status, a cancelled target counts nowhere."""
    counts = targets.groupBy("execution_id").agg(
        count_of(F.col("status") == "SUCCEEDED", "ok"), count_of(F.col("status").isin("FAILED", "TIMEOUT"), "bad"), count_of(F.col("status") == "RUNNING", "running")
    )
    met = executions.select("execution_id", "status", "completion_policy", "expected_targets").join(counts, "execution_id", "left").fillna(0, ["ok", "bad", "running"])
    return met.select("execution_id", F.col("status").alias("stored_status"), fan_in_status().alias("fan_in_status"), F.when(is_terminal(), F.col("status")).otherwise(fan_in_status()).alias("next_status"))


@query(
    "a10_delivery_complete",
    "executions targets",
    """SELECT e.execution_id, coalesce(n = e.expected_targets AND acked, false) AS complete FROM executions e
       LEFT JOIN (SELECT execution_id, count(*) AS n, bool_and(acknowledged) AS acked FROM targets GROUP BY execution_id) t USING (execution_id)""",
)
def delivery_complete(executions: DataFrame, targets: DataFrame) -> DataFrame:
    acks = targets.groupBy("execution_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("acknowledged").alias("acked"))
    done = (F.col("n") == F.col("expected_targets")) & F.col("acked")
    return executions.join(acks, "execution_id", "left").select("execution_id", F.coalesce(done, F.lit(False)).alias("complete"))


@query(
    "a11_target_summary",
    "targets",
    """SELECT execution_id, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed,
       count(*) FILTER (WHERE status = 'TIMEOUT') AS timed_out, count(*) FILTER (WHERE carried) AS carried FROM targets GROUP BY execution_id""",
)
def target_summary(targets: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return targets.groupBy("execution_id").agg(count_of(is_("SUCCEEDED"), "succeeded"), count_of(is_("FAILED"), "failed"), count_of(is_("TIMEOUT"), "timed_out"), count_of(F.col("carried"), "carried"))


@query(
    "a12_overview",
    "jobs nodes instances",
    """SELECT (SELECT count(*) FROM jobs) AS total, (SELECT count(*) FROM jobs WHERE enabled) AS enabled, (SELECT count(*) FROM jobs WHERE NOT enabled) AS disabled,
       (SELECT min(next_fire_time) FROM jobs WHERE enabled) AS next_fire, (SELECT count(*) FROM nodes WHERE status = 'ONLINE') AS nodes_online,
       (SELECT count(*) FROM instances) AS instances_all, (SELECT count(*) FROM instances WHERE status = 'ONLINE') AS instances_online""",
)
def overview(jobs: DataFrame, nodes: DataFrame, instances: DataFrame) -> DataFrame:
    one = jobs.agg(F.count(F.lit(1)).alias("total"), count_of(F.col("enabled"), "enabled"), count_of(~F.col("enabled"), "disabled"), F.min(F.when(F.col("enabled"), F.col("next_fire_time"))).alias("next_fire"))
    two = nodes.agg(count_of(F.col("status") == "ONLINE", "nodes_online"))
    three = instances.agg(F.count(F.lit(1)).alias("instances_all"), count_of(F.col("status") == "ONLINE", "instances_online"))
    return side_by_side(one, two, three)


OPEN = "status NOT IN ('DONE', 'DEAD')"
GAUGES_SQL = f"""SELECT (SELECT count(*) FROM jobs WHERE enabled AND next_fire_time <= {{now}}) AS due,
  coalesce((SELECT max(date_diff('millisecond', next_fire_time, {{now}})) FROM jobs WHERE enabled AND next_fire_time <= {{now}}), 0) / 1000.0 AS max_overdue_s, (SELECT min(next_fire_time) FROM jobs) AS next_fire,
  (SELECT count(*) FROM outbox WHERE {OPEN}) AS pending, (SELECT count(*) FROM outbox WHERE status = 'DEAD') AS dead,
  (SELECT count(*) FROM executions WHERE status = 'RUNNING') AS running, (SELECT count(*) FROM executions WHERE status IN ('FAILED', 'TIMEOUT')) AS failed,
  greatest(0, coalesce(date_diff('millisecond', (SELECT min(dispatch_time) FROM outbox WHERE {OPEN}), {{now}}), 0)) / 1000.0 AS oldest_age_s"""


@query("a13_job_gauges", "jobs outbox executions", GAUGES_SQL)
def job_gauges(jobs: DataFrame, outbox: DataFrame, executions: DataFrame) -> DataFrame:
    """The gauge of the next fire spans all jobs, unlike the overview's; three single rows side by side."""
    zero = F.lit(0).cast("long")
    overdue = F.when(is_due(), F.timestamp_diff("MILLISECOND", F.col("next_fire_time"), now()))
    one = jobs.agg(count_of(is_due(), "due"), (F.coalesce(F.max(overdue), zero) / 1000.0).alias("max_overdue_s"), F.min("next_fire_time").alias("next_fire"))
    open_ = ~F.col("status").isin("DONE", "DEAD")
    age = F.timestamp_diff("MILLISECOND", F.min(F.when(open_, F.col("dispatch_time"))), now())
    two = outbox.agg(count_of(open_, "pending"), count_of(F.col("status") == "DEAD", "dead"), (F.greatest(zero, F.coalesce(age, zero)) / 1000.0).alias("oldest_age_s"))
    three = executions.agg(count_of(F.col("status") == "RUNNING", "running"), count_of(F.col("status").isin("FAILED", "TIMEOUT"), "failed"))
    return side_by_side(one, two, three)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Single rows as one."""
    first, *others = [r.withColumn("_one", F.lit(1)) for r in rows]
    for r in others:
        first = first.join(r, "_one")
    return first.drop("_one")


def latency_ms() -> Column:
    """Delay of dispatch, not below zero; null for what has not been dispatched."""
    delay = F.timestamp_diff("MILLISECOND", F.col("scheduled_fire_time"), F.col("dispatch_time"))
    return F.when(delay.isNotNull(), F.greatest(F.lit(0).cast("long"), delay))


LATENCY_SQL = "CASE WHEN dispatch_time IS NOT NULL THEN greatest(0, date_diff('millisecond', scheduled_fire_time, dispatch_time)) END"


@query(
    "a14_latency_histogram",
    "executions",
    f"WITH d AS (SELECT {LATENCY_SQL} AS ms FROM executions) SELECT CAST(b AS DOUBLE) AS le, count(*) FILTER (WHERE ms / 1000.0 <= b) AS n, count(ms) AS observed, sum(ms) / 1000.0 AS sum_s, max(ms) / 1000.0 AS max_s FROM d, (VALUES (0.01), (0.05), (0.1), (0.25), (0.5), (1.0), (5.0), (30.0), (1e308)) t(b) GROUP BY b",
)
def latency_histogram(executions: DataFrame) -> DataFrame:
    """Cumulative counts by upper bound in seconds, with count, sum and maximum; one pass, one row of sums, unpivoted after it."""
    bounds = [*BOUNDS, 1e308]
    value = latency_ms() / 1000.0
    whole = [F.count("ms").alias("observed"), (F.sum("ms") / 1000.0).alias("sum_s"), (F.max("ms") / 1000.0).alias("max_s")]
    sums = executions.withColumn("ms", latency_ms()).agg(*[F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(bounds)], *whole)
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])
    return sums.select(F.explode(pairs).alias("p"), "observed", "sum_s", "max_s").select("p.le", "p.n", "observed", "sum_s", "max_s")


def exact_ranks(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles p50, p95, ... of a non-negative value, with n and top, for each group; nulls do not count.

    Values are counted, and the counts summed in buckets of a twentieth of a doubling, so that a group has some hundreds at
    most. Only the buckets that hold a wanted rank are sorted by value.
    """
    bucket = F.floor(F.log2(F.col(value) + 1.0) * 20).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    sums = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in"), F.max(value).alias("_top"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    upto = F.sum("_in").over(group.orderBy("_bucket"))
    totals = sums.withColumns({"_before": upto - F.col("_in"), "n": F.sum("_in").over(group), "top": F.max("_top").over(group)})
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.ceil(F.lit(p) * F.col("n") / 100).alias("rank")) for p in percents])
    held = totals.select("*", F.explode(wanted).alias("_w")).where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_in")))
    met = counts.join(held.drop("_in", "_top"), [*by, "_bucket"])
    run = F.sum("_n").over(W.partitionBy(*by, "_bucket", "_w.p").orderBy(value))
    met = met.withColumn("_upto", F.col("_before") + run).where(F.col("_upto") >= F.col("_w.rank"))
    found = [F.min(F.when(F.col("_w.p") == p, F.col(value))).alias(f"p{p}") for p in percents]
    return met.groupBy(*by).agg(F.max("n").alias("n"), *found, F.max("top").alias("top"))


@query(
    "a15_exact_percentiles",
    "executions",
    f"""SELECT CAST(quantile_disc(v, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(v, 0.99) AS BIGINT) AS p99, max(v) AS top
       FROM (SELECT {LATENCY_SQL} AS v FROM executions)""",
)
def exact_percentiles(executions: DataFrame) -> DataFrame:
    return exact_ranks(executions.select(latency_ms().alias("v")), [], "v", [50, 95, 99]).select("p50", "p95", "p99", "top")


@query(
    "a16_scheduling_latency",
    "executions",
    f"""SELECT status, count(v) AS n, CAST(quantile_disc(v, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(v, 0.99) AS BIGINT) AS p99, max(v) AS top
       FROM (SELECT status, {LATENCY_SQL} AS v FROM executions) GROUP BY status HAVING count(v) > 0""",
)
def scheduling_latency(executions: DataFrame) -> DataFrame:
    """Delay of dispatch behind schedule by status: count of what was dispatched, and exact percentiles in ms."""
    return exact_ranks(executions.select("status", latency_ms().alias("v")), ["status"], "v", [50, 95, 99])


@query("a17_duplicate_ids", "lineitem", "SELECT count(*) AS duplicates FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)", keys=["l_orderkey", "l_linenumber"])
def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicates"))


@query("a18_success_rate", "executions", "SELECT round(100.0 * count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*) FILTER (WHERE status IN ('SUCCEEDED', 'FAILED', 'TIMEOUT', 'CANCELLED')), 1) AS success_percent FROM executions")
def success_rate(executions: DataFrame) -> DataFrame:
    """Percent of finished executions that succeeded; PARTIAL is not in the denominator."""
    ended = F.count_if(F.col("status").isin("SUCCEEDED", "FAILED", "TIMEOUT", "CANCELLED"))
    return executions.agg(F.round(F.lit(100.0) * F.count_if(F.col("status") == "SUCCEEDED") / ended, 1).alias("success_percent"))


@query("a19_average_delay", "executions", f"SELECT job_id, CAST(round(avg({LATENCY_SQL})) AS BIGINT) AS delay_ms FROM executions GROUP BY job_id")
def average_delay(executions: DataFrame) -> DataFrame:
    return executions.groupBy("job_id").agg(F.round(F.avg(latency_ms())).cast("long").alias("delay_ms"))


@query("a20_recent_failures", "executions", "SELECT count(*) FILTER (WHERE updated_at >= TIMESTAMP_NTZ '2001-07-01 00:00:00' - INTERVAL '24' HOUR) AS day, count(*) FILTER (WHERE updated_at >= TIMESTAMP_NTZ '2001-07-01 00:00:00' - INTERVAL '240' HOUR) AS ten_days FROM executions WHERE status IN ('FAILED', 'TIMEOUT')", at="2001-07-01 00:00:00")
def recent_failures(executions: DataFrame, at: str) -> DataFrame:
    since = lambda h: F.col("updated_at") >= F.expr(f"TIMESTAMP_NTZ '{at}' - INTERVAL '{h}' HOUR")
    return executions.where(F.col("status").isin("FAILED", "TIMEOUT")).agg(count_of(since(24), "day"), count_of(since(240), "ten_days"))


@query(
    "a21_hourly_trend",
    "history",
    """WITH h AS (SELECT least(6, CAST(floor(date_diff('second', TIMESTAMP_NTZ '2024-01-15 06:00:00', occurred_at) / 3600.0) AS BIGINT)) AS bucket FROM history
         WHERE occurred_at BETWEEN TIMESTAMP_NTZ '2024-01-15 06:00:00' AND TIMESTAMP_NTZ '2024-01-15 12:00:00')
       SELECT CAST(i AS BIGINT) AS bucket, count(h.bucket) AS n FROM range(7) t(i) LEFT JOIN h ON h.bucket = i GROUP BY i""",
    at="2024-01-15 12:00:00",
)
def hourly_trend(history: DataFrame, at: str) -> DataFrame:
    """Seven hourly buckets up to now; the last holds only what happens at now itself."""
    end = F.expr(f"TIMESTAMP_NTZ '{at}'")
    start = end - F.expr("INTERVAL '6' HOUR")
    hour = F.floor(F.timestamp_diff("SECOND", start, F.col("occurred_at")) / 3600.0)
    counts = history.where(F.col("occurred_at").between(start, end)).groupBy(F.least(F.lit(6).cast("long"), hour).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return history.sparkSession.range(7).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").fillna(0, ["n"])


@query("a22_status_shares", "executions", "SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM executions WHERE status IN ('SUCCEEDED', 'RUNNING', 'FAILED', 'TIMEOUT', 'MISFIRED') GROUP BY status")
def status_shares(executions: DataFrame) -> DataFrame:
    counts = status_counts(executions.where(F.col("status").isin("SUCCEEDED", "RUNNING", "FAILED", "TIMEOUT", "MISFIRED")))
    return counts.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


@query(
    "a23_shards_per_node",
    "nodes",
    """WITH c AS (SELECT node_id, len(list_filter(string_split(shards, ','), lambda x: x <> '')) AS n FROM nodes), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, node_id) AS k FROM c WHERE n > 0)
       SELECT CASE WHEN k <= 5 THEN node_id ELSE 'other' END AS node, CAST(sum(n) AS BIGINT) AS shards FROM r GROUP BY 1""",
)
def shards_per_node(nodes: DataFrame, top: int = 5) -> DataFrame:
    """Shards of the five nodes that own most, the rest folded into one row; nodes without shards are left out."""
    counts = nodes.select(F.col("node_id").alias("node"), F.size(shard_set()).cast("long").alias("shards")).where("shards > 0")
    first = counts.orderBy(F.col("shards").desc(), "node").limit(top)
    rest = counts.join(first.select("node"), "node", "left_anti").agg(F.sum("shards").alias("shards")).where("shards > 0")
    return first.unionByName(rest.select(F.lit("other").alias("node"), "shards"))


def shard_set() -> Column:
    return F.filter(F.split("shards", ","), lambda x: x != "")


@query("a24_distinct_shards", "nodes", "SELECT count(DISTINCT x) AS shards FROM (SELECT unnest(string_split(shards, ',')) AS x FROM nodes) WHERE x <> ''")
def distinct_shards(nodes: DataFrame) -> DataFrame:
    """Shards that any node owns."""
    return nodes.select(F.explode(shard_set()).alias("x")).agg(F.countDistinct("x").alias("shards"))


@query("a25_active_jobs", "executions", "SELECT DISTINCT job_id FROM executions WHERE status NOT IN {terminal}")
def active_jobs(executions: DataFrame) -> DataFrame:
    return executions.where(~is_terminal()).select("job_id").distinct()


def normalised_names(column: str) -> Column:
    """Trimmed, non-empty, sorted names of a comma list."""
    return F.array_sort(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""))


@query("e18_handler_list", "instances", "SELECT instance_id, array_to_string(list_sort(list_filter(list_transform(string_split(handler_names, ','), lambda x: trim(x)), lambda x: x <> '')), ',') AS handlers FROM instances")
def handler_list(instances: DataFrame) -> DataFrame:
    return instances.select("instance_id", F.array_join(normalised_names("handler_names"), ",").alias("handlers"))


@query(
    "a26_shared_handlers",
    "instances",
    """WITH live AS (SELECT executor_name, instance_id, handler_names FROM (SELECT *, count(*) FILTER (WHERE status = 'ONLINE') OVER (PARTITION BY executor_name) AS n FROM instances) WHERE n = 0 OR status = 'ONLINE'),
       x AS (SELECT DISTINCT executor_name, instance_id, trim(unnest(string_split(handler_names, ','))) AS handler FROM live)
       SELECT executor_name, handler FROM x JOIN (SELECT executor_name, count(*) AS n FROM live GROUP BY executor_name) USING (executor_name) WHERE handler <> '' GROUP BY executor_name, handler, n HAVING count(*) = n""",
)
def shared_handlers(instances: DataFrame) -> DataFrame:
    """Handlers that every online instance of an executor has, or every instance if none is online."""
    online = instances.groupBy("executor_name").agg(count_of(F.col("status") == "ONLINE", "online"), F.count(F.lit(1)).alias("all"))
    live = instances.join(online, "executor_name").where((F.col("online") == 0) | (F.col("status") == "ONLINE"))
    need = F.when(F.col("online") == 0, F.col("all")).otherwise(F.col("online"))
    names = live.select("executor_name", need.alias("need"), F.explode(F.array_distinct(normalised_names("handler_names"))).alias("handler"))
    return names.groupBy("executor_name", "handler", "need").count().where("count = need").select("executor_name", "handler")


@query("a27_max_version", "jobs", "SELECT max(version) AS version FROM jobs")
def max_version(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.max("version").alias("version"))


@query(
    "a28_drain_ready",
    "nodes outbox targets leases",
    """SELECT node_id, status = 'DRAINING' AND NOT EXISTS (SELECT 1 FROM outbox o WHERE o.claim_owner = node_id AND o.status IN ('CLAIMED', 'SENT'))
       AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.owner_node_id = node_id AND l.lease_until > {now})
       AND NOT EXISTS (SELECT 1 FROM targets t WHERE replace(t.gateway_node_id, 'gw', 'node') = node_id AND t.status NOT IN {terminal}) AS ready FROM nodes""",
)
def drain_ready(nodes: DataFrame, outbox: DataFrame, targets: DataFrame, leases: DataFrame) -> DataFrame:
    """A draining node is ready when it owns no dispatch, no lease and no active target."""
    owned = owned_dispatches(outbox).select(F.col("claim_owner").alias("node_id"))
    held = leases_by_owner(leases).select(F.col("owner_node_id").alias("node_id"))
    active = targets_by_gateway(targets).select(F.regexp_replace("gateway_node_id", "^gw", "node").alias("node_id"))
    busy = owned.unionByName(held).unionByName(active).distinct().withColumn("busy", F.lit(True))
    return nodes.join(busy, "node_id", "left").select("node_id", ((F.col("status") == "DRAINING") & F.col("busy").isNull()).alias("ready"))


@query(
    "r06_alert_windows",
    "history",
    "SELECT date_trunc('hour', occurred_at) AS start, action_name, count(*) AS n, count(*) > 5 AS firing FROM history GROUP BY 1, 2",
)
def alert_windows(history: DataFrame, most: int = 5) -> DataFrame:
    """Events of a kind in each hour, and whether their number passes the alert's bound."""
    counts = history.groupBy(F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("start"), "action_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("firing", F.col("n") > most)


#: Alerts on the increase of a counter: the counter, minutes of the window, and what the increase must pass.
INCREASES = {"delivery_exhausted": ("purchase", 10, 0), "lease_renewal_failure": ("refund", 5, 0), "registration_rejected": ("view", 10, 5), "forwarding_failure": ("click", 5, 5)}


@query(
    "r06b_alerts",
    "jobs outbox executions history",
    f"""WITH g AS ({GAUGES_SQL}), s AS (SELECT coalesce(max(n), 0) AS n FROM (SELECT count(*) AS n FROM jobs WHERE enabled AND next_fire_time <= {{now}} GROUP BY shard_id)),
        c AS (SELECT coalesce(max(abs(date_diff('millisecond', dispatch_time + (date_diff('millisecond', dispatch_time, available_at) // 2) * INTERVAL '1' MILLISECOND, updated_at))), 0) AS ms FROM outbox WHERE available_at >= dispatch_time),
        q AS (SELECT quantile_disc(v, 0.99) / 1000.0 AS p99 FROM (SELECT {LATENCY_SQL} AS v FROM executions))
        SELECT 'scheduler_p99_delay' AS alert, CAST(p99 AS DOUBLE) AS value, p99 > 1 AS firing FROM q UNION ALL SELECT 'jobs_overdue' AS alert, CAST(max_overdue_s AS DOUBLE) AS value, max_overdue_s > 10 AS firing FROM g
        UNION ALL SELECT 'shard_backlog' AS alert, CAST(n AS DOUBLE) AS value, n > 1000 AS firing FROM s UNION ALL SELECT 'outbox_stalled' AS alert, CAST(oldest_age_s AS DOUBLE) AS value, oldest_age_s > 60 AS firing FROM g
        UNION ALL SELECT 'clock_drift' AS alert, CAST(ms AS DOUBLE) AS value, ms > 1000 AS firing FROM c"""
    + "".join(f" UNION ALL SELECT '{name}' AS alert, CAST(count(*) AS DOUBLE) AS value, count(*) > {most} AS firing FROM history WHERE action_name = '{kind}' AND occurred_at > {{now}} - INTERVAL '{minutes}' MINUTE AND occurred_at <= {{now}}" for name, (kind, minutes, most) in INCREASES.items()),
)
def alerts(jobs: DataFrame, outbox: DataFrame, executions: DataFrame, history: DataFrame) -> DataFrame:
    """The nine alert rules at now, each with the value that it judges; counters are counts of events of a kind."""
    gauges = job_gauges(jobs, outbox, executions)
    p99 = exact_percentiles(executions).select((F.col("p99") / 1000.0).alias("p99_s"))
    backlog = due_by_shard(jobs).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("backlog"))
    middle = F.expr("timestampadd(MILLISECOND, timestampdiff(MILLISECOND, dispatch_time, available_at) div 2, dispatch_time)")
    drift = outbox.where("available_at >= dispatch_time").agg(F.coalesce(F.max(F.abs(F.timestamp_diff("MILLISECOND", middle, F.col("updated_at")))), F.lit(0).cast("long")).alias("drift_ms"))
    inside = lambda kind, minutes: (F.col("action_name") == kind) & (F.col("occurred_at") > now() - F.expr(f"INTERVAL '{minutes}' MINUTE")) & (F.col("occurred_at") <= now())
    risen = history.agg(*[F.count_if(inside(kind, minutes)).alias(name) for name, (kind, minutes, _) in INCREASES.items()])
    rules = {"scheduler_p99_delay": ("p99_s", 1), "jobs_overdue": ("max_overdue_s", 10), "shard_backlog": ("backlog", 1000), "outbox_stalled": ("oldest_age_s", 60), "clock_drift": ("drift_ms", 1000)}
    rules |= {name: (name, most) for name, (_, _, most) in INCREASES.items()}
    lines = F.array(*[F.struct(F.lit(a).alias("alert"), F.col(c).cast("double").alias("value"), (F.col(c) > most).alias("firing")) for a, (c, most) in rules.items()])
    return side_by_side(gauges, p99, backlog, drift, risen).select(F.explode(lines).alias("l")).select("l.*")
