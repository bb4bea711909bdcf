"""State transitions: the next version of a table from its rows and the commands on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.query import NOW, TERMINAL, now, query
from .filters import CLAIMABLE, claimable, is_terminal
from ..functions.codecs import instant_text
from .temporal import FIRES_SQL, advances, backoff_ms

ACTIVE = ("DISPATCHING", "DISPATCHED", "RUNNING")


def may_become(old: Column, new: Column) -> Column:
    """Same status always; terminal rows are frozen; nothing returns to DISPATCHING; DISPATCHED only from it."""
    return (old == new) | (~old.isin(*TERMINAL) & (new != "DISPATCHING") & ((new != "DISPATCHED") | (old == "DISPATCHING")))


REPORTED = "CASE WHEN execution_id % 5 = 0 THEN 'DISPATCHED' WHEN execution_id % 5 = 1 THEN 'RUNNING' WHEN execution_id % 5 = 2 THEN 'SUCCEEDED' WHEN execution_id % 5 = 3 THEN 'DISPATCHING' ELSE status END"
LEGAL = "(status = reported OR (status NOT IN {terminal} AND reported <> 'DISPATCHING' AND (reported <> 'DISPATCHED' OR status = 'DISPATCHING')))"


@query("d01_transition_guard", "executions", f"SELECT execution_id, {LEGAL} AS allowed FROM (SELECT execution_id, status, {REPORTED} AS reported FROM executions)")
def transition_guard(executions: DataFrame) -> DataFrame:
    return executions.select("execution_id", may_become(F.col("status"), F.expr(REPORTED)).alias("allowed"))


REPORTS = f"SELECT execution_id, {REPORTED} AS reported FROM executions UNION ALL SELECT execution_id + 50000000 AS execution_id, 'DISPATCHED' AS reported FROM executions WHERE execution_id % 50 = 0"


@query(
    "d02_save_merge",
    "executions",
    f"""WITH r AS ({REPORTS}), m AS (SELECT r.*, e.status, e.expected_targets, e.accepted_targets, e.timeout_at, e.updated_at, e.execution_id IS NULL AS unseen FROM r LEFT JOIN executions e USING (execution_id)),
        l AS (SELECT *, unseen OR {LEGAL} AS legal FROM m)
        SELECT execution_id, CASE WHEN legal THEN reported ELSE status END AS status, CASE WHEN legal THEN greatest(expected_targets, 3) ELSE expected_targets END AS expected_targets,
        CASE WHEN legal THEN greatest(accepted_targets, 2) ELSE accepted_targets END AS accepted_targets, CASE WHEN legal THEN coalesce(timeout_at, {{now}} + INTERVAL '60' SECOND) ELSE timeout_at END AS timeout_at,
        CASE WHEN legal THEN {{now}} ELSE updated_at END AS updated_at FROM l""",
)
def reported_merge(executions: DataFrame) -> DataFrame:
    """A report for each execution, and some for executions that are not there yet."""
    seen = executions.select("execution_id", F.expr(REPORTED).alias("reported"))
    new = executions.where("execution_id % 50 = 0").select((F.col("execution_id") + 50000000).alias("execution_id"), F.lit("DISPATCHED").alias("reported"))
    reports = seen.unionByName(new).select("*", F.lit(3).alias("expected"), F.lit(2).alias("accepted"), (now() + F.expr("INTERVAL '60' SECOND")).alias("until"))
    return save_merge(executions, reports)


def save_merge(executions: DataFrame, reports: DataFrame) -> DataFrame:
    """The reported executions after their reports (execution_id, reported, expected, accepted, until).

    A legal report raises the counts and sets a first timeout; an illegal one changes nothing at all; an unseen execution is inserted.
    """
    known = executions.select("execution_id", "status", "expected_targets", "accepted_targets", "timeout_at", "updated_at", F.lit(True).alias("known"))
    legal = F.col("known").isNull() | may_become(F.col("status"), F.col("reported"))
    pick = lambda new, old: F.when(legal, new).otherwise(F.col(old)).alias(old)
    return reports.join(known, "execution_id", "left").select(
        "execution_id",
        pick(F.col("reported"), "status"),
        pick(F.greatest("expected_targets", "expected"), "expected_targets"),
        pick(F.greatest("accepted_targets", "accepted"), "accepted_targets"),
        pick(F.coalesce("timeout_at", "until"), "timeout_at"),
        pick(now(), "updated_at"),
    )


EXPECTS = "next_fire_time + (CASE WHEN job_id % 4 = 0 THEN 1 ELSE 0 END) * INTERVAL '1' SECOND"


@query("d03_cursor_cas", "jobs", f"SELECT job_id, {EXPECTS} = next_fire_time AS applied FROM jobs")
def cursor_cas(jobs: DataFrame) -> DataFrame:
    """An advance applies where the cursor is still the expected one."""
    commands = jobs.select("job_id", F.expr(EXPECTS).alias("expected"))
    return jobs.join(commands, "job_id").select("job_id", (F.col("expected") == F.col("next_fire_time")).alias("applied"))


NEXT = "CASE WHEN n = 0 OR (misfire_policy <> 'CATCH_UP' AND next_fire_time + interval_s * INTERVAL '1' SECOND <= {now}) THEN {now} + interval_s * INTERVAL '1' SECOND ELSE next_fire_time + n * interval_s * INTERVAL '1' SECOND END"


ADVANCES = f"SELECT job_id, {EXPECTS} AS expected, next_fire_time + interval_s * INTERVAL '1' SECOND AS wanted, concat('node-', CASE WHEN job_id % 7 = 0 THEN 9 ELSE shard_id % 5 END) AS owner, shard_id % 7 + CASE WHEN job_id % 5 = 0 THEN 0 ELSE 1 END AS token FROM jobs"


@query(
    "d04_fenced_cas",
    "jobs leases",
    f"""WITH c AS ({ADVANCES}), m AS (SELECT j.job_id, j.next_fire_time, j.version, c.wanted, coalesce(c.expected = j.next_fire_time AND j.next_fire_time <= {{now}} AND l.shard_id IS NOT NULL, false) AS applied
        FROM jobs j JOIN c USING (job_id) LEFT JOIN leases l ON l.shard_id = j.shard_id AND l.owner_node_id = c.owner AND l.fencing_token = c.token AND l.lease_until >= {{now}})
        SELECT job_id, applied, CASE WHEN applied THEN wanted ELSE next_fire_time END AS next_fire_time, version + CASE WHEN applied THEN 1 ELSE 0 END AS version FROM m""",
)
def commanded_cas(jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """An advance for each job, some with a cursor, an owner or a token that is no longer right."""
    commands = jobs.select(
        "job_id",
        F.expr(EXPECTS).alias("expected"),
        (F.col("next_fire_time") + F.expr("interval_s * INTERVAL '1' SECOND")).alias("wanted"),
        F.concat(F.lit("node-"), F.when(F.col("job_id") % 7 == 0, F.lit(9).cast("long")).otherwise(F.col("shard_id") % 5)).alias("owner"),
        (F.col("shard_id") % 7 + F.when(F.col("job_id") % 5 == 0, 0).otherwise(1)).alias("token"),
    )
    return fenced_cas(jobs, commands, leases)


def fenced_cas(jobs: DataFrame, commands: DataFrame, leases: DataFrame) -> DataFrame:
    """Next version of the commanded jobs, and whether the command applied.

    It does where the cursor is the expected one and due, and the shard's unexpired lease has the command's owner and token.
    """
    live = leases.where(F.col("lease_until") >= now()).select("shard_id", F.col("owner_node_id").alias("owner"), F.col("fencing_token").alias("token"), F.lit(True).alias("held"))
    met = jobs.join(commands, "job_id").join(live, ["shard_id", "owner", "token"], "left")
    applied = F.coalesce((F.col("expected") == F.col("next_fire_time")) & (F.col("next_fire_time") <= now()) & F.col("held"), F.lit(False))
    met = met.withColumn("applied", applied)
    return met.select("job_id", "applied", F.when(F.col("applied"), F.col("wanted")).otherwise(F.col("next_fire_time")).alias("next_fire_time"), (F.col("version") + F.when(F.col("applied"), 1).otherwise(0)).alias("version"))


NEXT = "CASE WHEN n = 0 OR (misfire_policy <> 'CATCH_UP' AND next_fire_time + interval_s * INTERVAL '1' SECOND <= {now}) THEN {now} + interval_s * INTERVAL '1' SECOND ELSE next_fire_time + n * interval_s * INTERVAL '1' SECOND END"
ADVANCED = f"SELECT *, {FIRES_SQL} AS n, job_id IN (SELECT job_id FROM executions WHERE status NOT IN {{terminal}}) AS active FROM jobs WHERE enabled AND next_fire_time <= {{now}}"


def advanced(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Due jobs with fire_times, next_cursor, and blocked: whether a running execution of a job that forbids overlap suppresses its commands."""
    active = executions.where(~is_terminal()).select("job_id").distinct().withColumn("active", F.lit(True))
    met = advances(jobs).join(active, "job_id", "left")
    return met.withColumn("blocked", (F.col("concurrency_policy") == "FORBID") & F.col("active").isNotNull())


@query("d05_advance_one", "jobs executions", f"SELECT job_id, {NEXT} AS next_cursor, version + 1 AS version, CASE WHEN concurrency_policy = 'FORBID' AND active THEN 0 ELSE n END AS commands FROM ({ADVANCED}) WHERE job_id = 22", job=22)
def advance_one(jobs: DataFrame, executions: DataFrame, job: int) -> DataFrame:
    """The batch advance of a single job; the filter reaches both scans."""
    return advance_and_enqueue(jobs.where(F.col("job_id") == job), executions.where(F.col("job_id") == job))


@query("d06_advance_and_enqueue", "jobs executions", f"SELECT job_id, {NEXT} AS next_cursor, version + 1 AS version, CASE WHEN concurrency_policy = 'FORBID' AND active THEN 0 ELSE n END AS commands FROM ({ADVANCED})")
def advance_and_enqueue(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Cursors and versions move for every due job, also where its commands are suppressed."""
    met = advanced(jobs, executions)
    return met.select("job_id", "next_cursor", (F.col("version") + 1).alias("version"), F.when(F.col("blocked"), 0).otherwise(F.size("fire_times")).cast("long").alias("commands"))


@query(
    "d06b_enqueued_rows",
    "jobs executions",
    f"""WITH a AS ({ADVANCED}), f AS (SELECT a.*, next_fire_time + k * interval_s * INTERVAL '1' SECOND AS fire_time FROM a, range(6) r(k) WHERE k < n AND NOT (concurrency_policy = 'FORBID' AND active))
        SELECT concat(job_id, '@', strftime(fire_time, '%Y-%m-%dT%H:%M:%SZ')) AS execution_id, job_id, fire_time AS scheduled_fire_time, 'DISPATCHING' AS execution_status, 'PENDING' AS outbox_status, 0 AS attempt,
        {{now}} AS available_at, {{now}} + timeout_s * INTERVAL '1' SECOND AS timeout_at, CASE WHEN starts_with(handler_name, 'remote:') THEN 'REMOTE' ELSE 'LOCAL' END AS dispatch_type FROM f""",
)
def enqueued_rows(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """What the batch advance inserts: an execution and its outbox row for each command that is not suppressed, side by side."""
    fired = advanced(jobs, executions).where(~F.col("blocked")).withColumn("fire_time", F.explode("fire_times"))
    return fired.select(
        F.concat("job_id", F.lit("@"), instant_text(F.col("fire_time"))).alias("execution_id"),
        "job_id",
        F.col("fire_time").alias("scheduled_fire_time"),
        F.lit("DISPATCHING").alias("execution_status"),
        F.lit("PENDING").alias("outbox_status"),
        F.lit(0).alias("attempt"),
        now().alias("available_at"),
        (now() + F.expr("timeout_s * INTERVAL '1' SECOND")).alias("timeout_at"),
        F.when(F.col("handler_name").startswith("remote:"), "REMOTE").otherwise("LOCAL").alias("dispatch_type"),
    )


@query(
    "d07_claim",
    "outbox executions",
    f"""SELECT outbox_id, attempt + 1 AS attempt, 'CLAIMED' AS status, 'node-7' AS claim_owner, {{now}} + INTERVAL '30' SECOND AS claim_until, {{now}} AS updated_at FROM outbox o WHERE dispatch_type IN ('REMOTE') AND {CLAIMABLE}
        AND EXISTS (SELECT 1 FROM executions e WHERE e.execution_id = o.execution_id AND e.status IN ('DISPATCHING', 'DISPATCHED', 'RUNNING') AND e.timeout_at > {{now}}) ORDER BY available_at, outbox_id LIMIT 50""",
    claimant="node-7",
    types=["REMOTE"],
)
def claim(outbox: DataFrame, executions: DataFrame, claimant: str, types: list[str], seconds: int = 30, most: int = 50) -> DataFrame:
    """The first claimable rows of some dispatch types become CLAIMED, if their execution is active and not past its time."""
    live = executions.where(F.col("status").isin(*ACTIVE) & (F.col("timeout_at") > now())).select("execution_id")
    first = outbox.where(F.col("dispatch_type").isin(types) & claimable()).join(live, "execution_id", "left_semi").orderBy("available_at", "outbox_id").limit(most)
    until = (now() + F.expr(f"INTERVAL '{seconds}' SECOND")).alias("claim_until")
    return first.select("outbox_id", (F.col("attempt") + 1).alias("attempt"), F.lit("CLAIMED").alias("status"), F.lit(claimant).alias("claim_owner"), until, now().alias("updated_at"))


@query("d08_mark_sent", "outbox", "SELECT outbox_id, CASE WHEN status = 'CLAIMED' AND claim_owner = 'node-1' AND attempt = 1 THEN 'SENT' ELSE status END AS status FROM outbox", owner="node-1", attempt=1)
def mark_sent(outbox: DataFrame, owner: str, attempt: int) -> DataFrame:
    mine = (F.col("status") == "CLAIMED") & (F.col("claim_owner") == owner) & (F.col("attempt") == attempt)
    return outbox.select("outbox_id", F.when(mine, "SENT").otherwise(F.col("status")).alias("status"))


@query("d09_acknowledge", "outbox", "SELECT outbox_id, CASE WHEN status IN ('SENT', 'CLAIMED') THEN 'DONE' ELSE status END AS status FROM outbox")
def acknowledge(outbox: DataFrame) -> DataFrame:
    return outbox.select("outbox_id", F.when(F.col("status").isin("SENT", "CLAIMED"), "DONE").otherwise(F.col("status")).alias("status"))


@query(
    "d10_delivery_retry",
    "outbox",
    """SELECT outbox_id, CASE WHEN NOT mine THEN status WHEN attempt >= 3 THEN 'DEAD' ELSE 'RETRY' END AS status, CASE WHEN mine AND attempt < 3 THEN {now} + CAST(least(30000, 1000 * pow(2, attempt)) AS BIGINT) * INTERVAL '1' MILLISECOND ELSE available_at END AS available_at,
       CASE WHEN NOT mine THEN claim_owner END AS claim_owner, CASE WHEN mine THEN 'refused' ELSE last_error END AS last_error FROM (SELECT *, status = 'CLAIMED' AND claim_owner = 'node-1' AND attempt IN (1, 2, 3) AS mine FROM outbox)""",
    owner="node-1",
    attempts=[1, 2, 3],
)
def delivery_retry(outbox: DataFrame, owner: str, attempts: list[int], most: int = 3, error: str = "refused") -> DataFrame:
    """A failed delivery of the claim's own owner and attempt: RETRY after the backoff, DEAD when the attempts are used up; others stay."""
    mine = (F.col("status") == "CLAIMED") & F.coalesce(F.col("claim_owner") == owner, F.lit(False)) & F.col("attempt").isin(attempts)
    again = mine & (F.col("attempt") < most)
    later = F.expr(f"timestampadd(MILLISECOND, least(30000L, 1000L * shiftleft(1L, least(attempt, 20))), {NOW})")
    return outbox.select(
        "outbox_id",
        F.when(~mine, F.col("status")).when(again, "RETRY").otherwise("DEAD").alias("status"),
        F.when(again, later).otherwise(F.col("available_at")).alias("available_at"),
        F.when(~mine, F.col("claim_owner")).alias("claim_owner"),
        F.when(mine, error).otherwise(F.col("last_error")).alias("last_error"),
    )


@query("d11_defer", "outbox", "SELECT outbox_id, 'RETRY' AS status, greatest(0, attempt - 1) AS attempt FROM outbox WHERE status = 'CLAIMED'")
def defer(outbox: DataFrame) -> DataFrame:
    """Back to RETRY without using up the delivery budget."""
    return outbox.where("status = 'CLAIMED'").select("outbox_id", F.lit("RETRY").alias("status"), F.greatest(F.lit(0), F.col("attempt") - 1).alias("attempt"))


@query("d12_requeue_dead", "outbox", "SELECT outbox_id, status = 'DEAD' AS requeued, CASE WHEN status = 'DEAD' THEN 'RETRY' ELSE status END AS status, CASE WHEN status = 'DEAD' THEN 0 ELSE attempt END AS attempt, CASE WHEN status = 'DEAD' THEN '' ELSE last_error END AS last_error FROM outbox")
def requeue_dead(outbox: DataFrame) -> DataFrame:
    dead = F.col("status") == "DEAD"
    pick = lambda new, old: F.when(dead, F.lit(new)).otherwise(F.col(old)).alias(old)
    return outbox.select("outbox_id", dead.alias("requeued"), pick("RETRY", "status"), pick(0, "attempt"), pick("", "last_error"))


@query("d13_cancel_dispatch", "outbox", "SELECT outbox_id, CASE WHEN status = 'DONE' THEN 'DONE' ELSE 'DEAD' END AS status FROM outbox")
def cancel_dispatch(outbox: DataFrame) -> DataFrame:
    return outbox.select("outbox_id", F.when(F.col("status") == "DONE", "DONE").otherwise("DEAD").alias("status"))


@query(
    "d14_business_retry",
    "executions outbox",
    """SELECT e.execution_id, concat(e.root_execution_id, '@attempt:', e.run_attempt + 1) AS next_id, e.run_attempt < 3 AS triggered,
       CAST(least(60000, floor(1000 * pow(2.0, e.run_attempt - 1) + 0.5)) AS BIGINT) AS delay_ms
       FROM executions e JOIN outbox o USING (execution_id) WHERE e.status IN ('FAILED', 'PARTIAL', 'TIMEOUT') AND NOT e.retry_scheduled""",
)
def business_retry(executions: DataFrame, outbox: DataFrame, most: int = 3) -> DataFrame:
    """One retry for each failed source; the source's slot is used even where no attempt is left."""
    source = executions.where(F.col("status").isin("FAILED", "PARTIAL", "TIMEOUT") & ~F.col("retry_scheduled"))
    met = source.join(outbox.select("execution_id"), "execution_id")
    next_id = F.concat("root_execution_id", F.lit("@attempt:"), F.col("run_attempt") + 1)
    return met.select("execution_id", next_id.alias("next_id"), (F.col("run_attempt") < most).alias("triggered"), backoff_ms(F.col("run_attempt"), 1000, 2.0, 60000).alias("delay_ms"))


@query("d15_manual_enqueue", "outbox", "SELECT outbox_id, outbox_id NOT IN (SELECT outbox_id FROM outbox) AS accepted FROM (SELECT outbox_id + 50000000 * (outbox_id % 2) AS outbox_id FROM outbox)")
def manual_enqueue(outbox: DataFrame) -> DataFrame:
    """Ids that exist already are refused."""
    wanted = outbox.select((F.col("outbox_id") + 50000000 * (F.col("outbox_id") % 2)).alias("outbox_id"))
    known = outbox.select("outbox_id", F.lit(True).alias("known"))
    return wanted.join(known, "outbox_id", "left").select("outbox_id", F.col("known").isNull().alias("accepted"))


@query(
    "d17_target_results",
    "history",
    """SELECT history_id, CASE WHEN k = 1 THEN 'APPLIED' WHEN action_name = f THEN 'ALREADY_APPLIED' ELSE 'REJECTED' END AS outcome
       FROM (SELECT history_id, action_name, row_number() OVER w AS k, first_value(action_name) OVER w AS f FROM history WINDOW w AS (PARTITION BY job_id ORDER BY occurred_at, history_id))""",
)
def target_results(history: DataFrame) -> DataFrame:
    """The first result of a target applies; the same again has been applied; any other is late and rejected."""
    first = history.groupBy("job_id").agg(F.min(F.struct("occurred_at", "history_id", "action_name")).alias("f"))
    met = history.join(first, "job_id")
    outcome = F.when(F.col("history_id") == F.col("f.history_id"), "APPLIED").when(F.col("action_name") == F.col("f.action_name"), "ALREADY_APPLIED").otherwise("REJECTED")
    return met.select("history_id", outcome.alias("outcome"))


CLOSED_SQL = """
SELECT 'execution' AS kind, CAST(x.execution_id AS VARCHAR) AS id, '%s' AS status FROM x
UNION ALL SELECT 'target' AS kind, concat(execution_id, ':', shard_index, ':', instance_id) AS id, '%s' AS status FROM targets WHERE status NOT IN {terminal} AND execution_id IN (SELECT execution_id FROM x)
UNION ALL SELECT 'outbox' AS kind, CAST(outbox_id AS VARCHAR) AS id, 'DEAD' AS status FROM outbox WHERE status NOT IN ('DONE', 'DEAD') AND execution_id IN (SELECT execution_id FROM x)"""


def closed(hit: DataFrame, targets: DataFrame, outbox: DataFrame, status: str) -> DataFrame:
    """kind, id and next status of all rows that end with some executions: themselves, their open targets, their open outbox rows (DEAD)."""
    text = lambda *c: F.concat_ws(":", *c).alias("id")
    one = hit.select(F.lit("execution").alias("kind"), text("execution_id"), F.lit(status).alias("status"))
    two = targets.where(~is_terminal()).join(hit, "execution_id", "left_semi").select(F.lit("target").alias("kind"), text("execution_id", "shard_index", "instance_id"), F.lit(status).alias("status"))
    three = outbox.where(~F.col("status").isin("DONE", "DEAD")).join(hit, "execution_id", "left_semi").select(F.lit("outbox").alias("kind"), text("outbox_id"), F.lit("DEAD").alias("status"))
    return one.unionByName(two).unionByName(three)


@query("d19_timeout_cascade", "executions targets outbox", "WITH x AS (SELECT execution_id FROM executions WHERE status NOT IN {terminal} AND (timeout_at IS NULL OR timeout_at <= {now}))" + CLOSED_SQL % ("TIMEOUT", "TIMEOUT"))
def timeout_cascade(executions: DataFrame, targets: DataFrame, outbox: DataFrame) -> DataFrame:
    """What the timeout of executions closes, row by row."""
    late = executions.where(~is_terminal() & (F.col("timeout_at").isNull() | (F.col("timeout_at") <= now()))).select("execution_id")
    return closed(late, targets, outbox, "TIMEOUT")


@query("d20_cancel_cascade", "executions targets outbox", "WITH x AS (SELECT execution_id FROM executions WHERE status NOT IN {terminal} AND job_id % 3 = 1)" + CLOSED_SQL % ("CANCELLED", "CANCELLED"))
def cancel_some(executions: DataFrame, targets: DataFrame, outbox: DataFrame) -> DataFrame:
    """The cancellation of the executions of every third job."""
    return cancel_cascade(executions, targets, outbox, executions.where("job_id % 3 = 1").select("execution_id"))


def cancel_cascade(executions: DataFrame, targets: DataFrame, outbox: DataFrame, wanted: DataFrame) -> DataFrame:
    """What the cancellation of some executions closes; one that has ended stays, with its targets and outbox rows."""
    hit = executions.where(~is_terminal()).join(wanted, "execution_id", "left_semi").select("execution_id")
    return closed(hit, targets, outbox, "CANCELLED")


OLD_SQL = "WITH x AS (SELECT execution_id FROM executions WHERE status IN {terminal} AND updated_at < TIMESTAMP_NTZ '1999-01-01 00:00:00' ORDER BY updated_at, execution_id LIMIT 100)"


@query(
    "d21_retention",
    "executions targets outbox",
    OLD_SQL + """ SELECT 'execution' AS kind, execution_id, count(*) AS n FROM executions WHERE execution_id NOT IN (SELECT execution_id FROM x) GROUP BY execution_id
       UNION ALL SELECT 'target' AS kind, execution_id, count(*) AS n FROM targets WHERE execution_id NOT IN (SELECT execution_id FROM x) GROUP BY execution_id
       UNION ALL SELECT 'outbox' AS kind, execution_id, count(*) AS n FROM outbox WHERE execution_id NOT IN (SELECT execution_id FROM x) GROUP BY execution_id""",
)
def retained_rows(executions: DataFrame, targets: DataFrame, outbox: DataFrame) -> DataFrame:
    """Rows of each table that retention leaves, by execution."""
    left = dict(zip(("execution", "target", "outbox"), retention(executions, targets, outbox, "1999-01-01 00:00:00")))
    one, two, three = (rows.groupBy("execution_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "execution_id", "n") for kind, rows in left.items())
    return one.unionByName(two).unionByName(three)


def retention(executions: DataFrame, targets: DataFrame, outbox: DataFrame, before: str) -> list[DataFrame]:
    """The three tables without the oldest ended executions; how many go at once is the feature's own limit."""
    from .windows import retention_order

    gone = retention_order(executions, before).select("execution_id")
    return [rows.join(gone, "execution_id", "left_anti") for rows in (executions, targets, outbox)]


@query(
    "d23_renew_lease",
    "leases",
    "SELECT shard_id, fencing_token, owner_node_id = 'node-3' AND fencing_token = 4 AND lease_until >= {now} AS applied, CASE WHEN owner_node_id = 'node-3' AND fencing_token = 4 AND lease_until >= {now} THEN {now} + INTERVAL '30' SECOND ELSE lease_until END AS lease_until FROM leases",
    owner="node-3",
    token=4,
)
def renew_lease(leases: DataFrame, owner: str, token: int, seconds: int = 30) -> DataFrame:
    """Leases after a renewal by an owner with a token: only its own unexpired lease of that token lasts longer."""
    mine = (F.col("owner_node_id") == owner) & (F.col("fencing_token") == token) & (F.col("lease_until") >= now())
    return leases.select("shard_id", "fencing_token", mine.alias("applied"), F.when(mine, now() + F.expr(f"INTERVAL '{seconds}' SECOND")).otherwise(F.col("lease_until")).alias("lease_until"))


@query(
    "d23b_release_lease",
    "leases",
    "SELECT shard_id, fencing_token, owner_node_id = 'node-3' AND fencing_token = 4 AS applied, CASE WHEN owner_node_id = 'node-3' AND fencing_token = 4 THEN TIMESTAMP_NTZ '1970-01-01 00:00:00' ELSE lease_until END AS lease_until FROM leases",
    owner="node-3",
    token=4,
)
def release_lease(leases: DataFrame, owner: str, token: int) -> DataFrame:
    """A release ends the owner's lease of that token, expired or not; the row and its token stay, so that the next owner's token is larger."""
    mine = (F.col("owner_node_id") == owner) & (F.col("fencing_token") == token)
    return leases.select("shard_id", "fencing_token", mine.alias("applied"), F.when(mine, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).otherwise(F.col("lease_until")).alias("lease_until"))


def lease_outcome(rows: DataFrame) -> DataFrame:
    """Outcome of one request for each lease: a free lease has token 1, a live one stays with its owner, an expired one takes the next token."""
    live = F.col("lease_until") > now()
    token = F.when(F.col("fencing_token").isNull(), 1).when(live & (F.col("owner_node_id") == F.col("wants")), F.col("fencing_token")).when(~live, F.col("fencing_token") + 1)
    return rows.select("shard_id", "wants", token.cast("long").alias("token"))


@query(
    "d22_acquire_lease",
    "leases",
    """SELECT i AS shard_id, concat('node-', i % 3) AS wants, CAST(CASE WHEN fencing_token IS NULL THEN 1 WHEN lease_until > {now} AND owner_node_id = concat('node-', i % 3) THEN fencing_token WHEN lease_until <= {now} THEN fencing_token + 1 END AS BIGINT) AS token
       FROM range(40) t(i) LEFT JOIN leases ON shard_id = i""",
)
def acquire_leases(leases: DataFrame, shards: int = 40) -> DataFrame:
    wants = leases.sparkSession.range(shards).select(F.col("id").alias("shard_id"), F.concat(F.lit("node-"), F.col("id") % 3).alias("wants"))
    return lease_outcome(wants.join(leases, "shard_id", "left"))


@query("d27_idempotency_cleanup", "outbox", "SELECT outbox_id FROM outbox WHERE outbox_id NOT IN (SELECT outbox_id FROM outbox WHERE status IN ('DONE', 'DEAD') AND updated_at < {now} - INTERVAL '3000' SECOND ORDER BY updated_at, outbox_id LIMIT 500)")
def idempotency_cleanup(claims: DataFrame, seconds: int = 3000, most: int = 500) -> DataFrame:
    """Claims that stay after one clean-up, which takes the oldest that ended long enough ago, so many at once."""
    old = F.col("status").isin("DONE", "DEAD") & (F.col("updated_at") < now() - F.expr(f"INTERVAL '{seconds}' SECOND"))
    gone = claims.where(old).orderBy("updated_at", "outbox_id").limit(most)
    return claims.select("outbox_id").join(gone, "outbox_id", "left_anti")


@query("d28_enable", "jobs", "SELECT job_id, job_id % 2 = 0 AS enabled, version + 1 AS version FROM jobs WHERE job_id % 3 = 0")
def enable_some(jobs: DataFrame) -> DataFrame:
    return enable(jobs, jobs.where("job_id % 3 = 0").select("job_id", (F.col("job_id") % 2 == 0).alias("wanted")))


def enable(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Commanded jobs (job_id, wanted) after their command; the version rises on every call, also where nothing changes."""
    return jobs.join(commands, "job_id").select("job_id", F.col("wanted").alias("enabled"), (F.col("version") + 1).alias("version"))


@query("d28b_revision", "jobs metadata", "SELECT metadata_key, CAST(metadata_value AS BIGINT) + (SELECT count(*) FROM jobs WHERE job_id % 3 = 0) + (SELECT count(*) FROM jobs WHERE job_id % 10 = 1) AS revision FROM metadata WHERE metadata_key = 'jobs.revision'")
def revision_after(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """The stored revision rises by one for each command that found its job: here enabling and deleting some."""
    calls = jobs.agg((F.count_if(F.col("job_id") % 3 == 0) + F.count_if(F.col("job_id") % 10 == 1)).alias("calls")).withColumn("metadata_key", F.lit("jobs.revision"))
    return metadata.join(calls, "metadata_key").select("metadata_key", (F.col("metadata_value").cast("long") + F.col("calls")).alias("revision"))


FANNED = """SELECT j.job_id, t.k AS shard_index, CAST(NULL AS VARCHAR) AS instance_id, concat(j.job_id, '@shard:', t.k) AS target_id FROM jobs j, range(4) t(k) WHERE dispatch_mode = 'SHARDING' AND t.k < shard_count
  UNION ALL SELECT job_id, NULL AS shard_index, NULL AS instance_id, CAST(job_id AS VARCHAR) AS target_id FROM jobs WHERE dispatch_mode = 'UNICAST'
  UNION ALL SELECT j.job_id, NULL AS shard_index, i.instance_id, concat(j.job_id, '@instance:', i.instance_id) AS target_id FROM jobs j JOIN instances i USING (executor_name) WHERE dispatch_mode = 'BROADCAST' AND i.lease_until > {now} AND i.status = 'ONLINE'"""


@query("d29_fan_out", "jobs instances", f"SELECT job_id, CAST(shard_index AS BIGINT) AS shard_index, instance_id, target_id FROM ({FANNED})")
def fan_out(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    """Target rows of a dispatch of every job: the execution itself, one for each shard, or one for each live instance."""
    none = lambda kind: F.lit(None).cast(kind)
    one = jobs.where("dispatch_mode = 'UNICAST'").select("job_id", none("long").alias("shard_index"), none("string").alias("instance_id"), F.col("job_id").cast("string").alias("target_id"))
    cut = jobs.where("dispatch_mode = 'SHARDING'").select("job_id", F.explode(F.sequence(F.lit(0), F.col("shard_count") - 1)).alias("shard_index"))
    cut = cut.select("job_id", F.col("shard_index").cast("long").alias("shard_index"), none("string").alias("instance_id"), F.concat("job_id", F.lit("@shard:"), "shard_index").alias("target_id"))
    live = instances.where((F.col("lease_until") > now()) & (F.col("status") == "ONLINE")).select("executor_name", "instance_id")
    every = dealt_pairs(jobs.where("dispatch_mode = 'BROADCAST'").select("job_id", "executor_name"), live)
    every = every.select("job_id", none("long").alias("shard_index"), "instance_id", F.concat("prefix", "instance_id").alias("target_id"))
    return one.unionByName(cut).unionByName(every)


def dealt_pairs(jobs: DataFrame, live: DataFrame, shares: int = 64, blocks: int = 128, parts: int = 256) -> DataFrame:
    """Every job with each live instance of its executor, and the prefix of their target's name.

    The pairs of one executor grow with the product of the two sides, so its jobs are dealt over shares, and each share
    meets all its instances, packed in blocks. The blocks are dealt over parts before they are copied for the shares, as
    one task would make all copies otherwise. The number of parts is given, as the two sides are so small before they meet
    that adaptive execution would merge the shares into one task; nothing is broadcast. A block meets all jobs of a share
    before the next block comes, so that rows stored in this order repeat few names at a time and take less room.
    """
    keys = ["executor_name", "share"]
    share = F.pmod(F.xxhash64("job_id"), F.lit(shares)).cast("int")
    jobs = jobs.select("job_id", "executor_name", share.alias("share"), F.concat("job_id", F.lit("@instance:")).alias("prefix"))
    live = live.withColumn("block", F.pmod(F.xxhash64("instance_id"), F.lit(blocks))).repartition(parts, "executor_name", "block")
    packed = live.groupBy("executor_name", "block").agg(F.collect_list(F.struct("instance_id")).alias("packed"))
    names = F.transform("packed", lambda one: one["instance_id"])  # packed as structs, as a list of plain names would lack null ones
    packed = packed.select("executor_name", names.alias("names"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    pairs = packed.repartition(parts, *keys).hint("merge").join(jobs.repartition(parts, *keys), keys)
    return pairs.select("job_id", "prefix", F.explode("names").alias("instance_id"))


@query("d29b_dispatch_accepted", "executions targets", "SELECT execution_id, expected_targets, count(t.execution_id) AS accepted_targets, count(t.execution_id) > 0 AND count(t.execution_id) >= expected_targets AS accepted FROM executions LEFT JOIN (SELECT * FROM targets WHERE acknowledged) t USING (execution_id) GROUP BY execution_id, expected_targets")
def dispatch_accepted(executions: DataFrame, targets: DataFrame) -> DataFrame:
    """A dispatch is accepted only if all its requested targets, and one at least, have accepted it."""
    taken = targets.where("acknowledged").groupBy("execution_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return executions.join(taken, "execution_id", "left").select("execution_id", "expected_targets", n.alias("accepted_targets"), ((n > 0) & (n >= F.col("expected_targets"))).alias("accepted"))


@query(
    "d30_retry_with_carry",
    "executions targets",
    """WITH s AS (SELECT execution_id, root_execution_id, run_attempt, expected_targets FROM executions WHERE status IN ('FAILED', 'PARTIAL', 'TIMEOUT')),
       d AS (SELECT DISTINCT execution_id, shard_index FROM targets WHERE status = 'SUCCEEDED')
       SELECT s.execution_id AS source, concat(root_execution_id, '@attempt:', run_attempt + 1) AS execution_id, CAST(k AS INT) AS shard_index, d.execution_id IS NOT NULL AS carried, CASE WHEN d.execution_id IS NOT NULL THEN 'SUCCEEDED' ELSE 'DISPATCHING' END AS status,
       concat(root_execution_id, '@attempt:', run_attempt + 1, CASE WHEN d.execution_id IS NOT NULL THEN '@carry:shard:' ELSE '@shard:' END, k) AS target_id
       FROM s JOIN range(1, 7) r(k) ON k <= expected_targets LEFT JOIN d ON d.execution_id = s.execution_id AND d.shard_index = k""",
)
def retry_with_carry(executions: DataFrame, targets: DataFrame, all_targets: bool = False) -> DataFrame:
    """Target rows of the next attempt of every failed execution: planned for the shards that failed, carried for those that succeeded.

    A retry of all targets carries none.
    """
    source = executions.where(F.col("status").isin("FAILED", "PARTIAL", "TIMEOUT"))
    shards = source.select("execution_id", F.concat("root_execution_id", F.lit("@attempt:"), F.col("run_attempt") + 1).alias("next_id"), F.explode(F.sequence(F.lit(1), "expected_targets")).alias("shard_index"))
    done = targets.where((F.col("status") == "SUCCEEDED") & F.lit(not all_targets)).select("execution_id", "shard_index").distinct().withColumn("done", F.lit(True))
    carried = F.col("done").isNotNull()
    name = F.concat("next_id", F.when(carried, "@carry:shard:").otherwise("@shard:"), "shard_index")
    met = shards.join(done, ["execution_id", "shard_index"], "left")
    return met.select(F.col("execution_id").alias("source"), F.col("next_id").alias("execution_id"), "shard_index", carried.alias("carried"), F.when(carried, "SUCCEEDED").otherwise("DISPATCHING").alias("status"), name.alias("target_id"))


BEATS = "SELECT executor_name, instance_id, concat('gw-', CASE WHEN {0} % 5 = 0 THEN 9 ELSE {0} % 4 END) AS gateway_node_id, concat('session-', CASE WHEN {0} % 6 = 0 THEN 9 ELSE {0} % 3 END) AS session_id, CASE WHEN {0} % 2 = 0 THEN 'heartbeat' ELSE 'offline' END AS kind FROM instances"


@query(
    "d34_heartbeat",
    "instances",
    f"""WITH b AS ({BEATS.format("CAST(substr(instance_id, 6) AS BIGINT)")})
        SELECT i.executor_name, i.instance_id, b.kind IS NOT NULL AS applied, CASE b.kind WHEN 'heartbeat' THEN 'ONLINE' WHEN 'offline' THEN 'OFFLINE' ELSE i.status END AS status,
        CASE WHEN b.kind = 'heartbeat' THEN {{now}} ELSE i.last_heartbeat_at END AS last_heartbeat_at, CASE b.kind WHEN 'heartbeat' THEN {{now}} + INTERVAL '15' SECOND WHEN 'offline' THEN i.last_heartbeat_at ELSE i.lease_until END AS lease_until
        FROM instances i LEFT JOIN b USING (executor_name, instance_id, gateway_node_id, session_id)""",
)
def beats(instances: DataFrame) -> DataFrame:
    """A heartbeat or an offline mark for each instance, some from another gateway or session."""
    return locations_after(instances, instances.sparkSession.sql(BEATS.format("CAST(substr(instance_id, 6) AS BIGINT)").replace("FROM instances", "FROM {instances}"), instances=instances))


def locations_after(instances: DataFrame, events: DataFrame, seconds: int = 15) -> DataFrame:
    """Locations after events that name executor, instance, gateway and session; an event of another gateway or session changes nothing.

    A heartbeat brings a location online with a new lease; an offline mark ends the lease when the instance was last seen.
    """
    met = instances.join(events, ["executor_name", "instance_id", "gateway_node_id", "session_id"], "left")
    beat, gone = F.col("kind") == "heartbeat", F.col("kind") == "offline"
    return met.select(
        "executor_name",
        "instance_id",
        F.col("kind").isNotNull().alias("applied"),
        F.when(beat, "ONLINE").when(gone, "OFFLINE").otherwise(F.col("status")).alias("status"),
        F.when(beat, now()).otherwise(F.col("last_heartbeat_at")).alias("last_heartbeat_at"),
        F.when(beat, now() + F.expr(f"INTERVAL '{seconds}' SECOND")).when(gone, F.col("last_heartbeat_at")).otherwise(F.col("lease_until")).alias("lease_until"),
    )


@query(
    "d34b_register",
    "instances",
    """WITH r AS (SELECT executor_name, concat('inst-', CAST(substr(instance_id, 6) AS BIGINT) + CASE WHEN CAST(substr(instance_id, 6) AS BIGINT) % 3 = 0 THEN 100000 ELSE 0 END) AS instance_id FROM instances)
       SELECT executor_name, instance_id, 'gw-new' AS gateway_node_id, 'session-new' AS session_id, 'ONLINE' AS status, {now} + INTERVAL '15' SECOND AS lease_until FROM r
       UNION ALL SELECT executor_name, instance_id, gateway_node_id, session_id, status, lease_until FROM instances i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.executor_name = i.executor_name AND r.instance_id = i.instance_id)""",
)
def register_some(instances: DataFrame) -> DataFrame:
    """Two of three instances register again, the others under a new id."""
    number = F.substring("instance_id", 6, 20).cast("long")
    return register(instances, instances.select("executor_name", F.concat(F.lit("inst-"), number + F.when(number % 3 == 0, 100000).otherwise(0)).alias("instance_id"), F.lit("gw-new").alias("gateway_node_id"), F.lit("session-new").alias("session_id")))


def register(instances: DataFrame, registrations: DataFrame, seconds: int = 15) -> DataFrame:
    """Locations after registrations: each is online at its new gateway and session, whatever was there before."""
    new = registrations.select("executor_name", "instance_id", "gateway_node_id", "session_id", F.lit("ONLINE").alias("status"), (now() + F.expr(f"INTERVAL '{seconds}' SECOND")).alias("lease_until"))
    return new.unionByName(instances.select(*new.columns).join(registrations, ["executor_name", "instance_id"], "left_anti"))


@query("d35_node_status", "nodes", "SELECT node_id, CASE WHEN slot = 0 THEN 'DRAINING' WHEN slot = 1 THEN 'OFFLINE' WHEN slot = 2 THEN 'ONLINE' ELSE status END AS status, CASE WHEN slot IN (0, 1, 2) THEN {now} ELSE last_heartbeat_at END AS last_heartbeat_at FROM nodes")
def node_commands(nodes: DataFrame) -> DataFrame:
    wanted = F.element_at(F.create_map(*[F.lit(x) for x in (0, "DRAINING", 1, "OFFLINE", 2, "ONLINE")]), F.col("slot").cast("int"))
    return node_status(nodes, nodes.where("slot < 3").select("node_id", wanted.alias("wanted")))


def node_status(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """Nodes after status commands (node_id, wanted), which overwrite whatever was there and count as a sign of life."""
    return nodes.join(commands, "node_id", "left").select("node_id", F.coalesce("wanted", "status").alias("status"), F.when(F.col("wanted").isNotNull(), now()).otherwise(F.col("last_heartbeat_at")).alias("last_heartbeat_at"))


@query("d36_executor_delete_guard", "jobs job_groups instances", "SELECT executor_name, executor_name IN (SELECT executor_name FROM jobs) OR executor_name IN (SELECT executor_name FROM job_groups) OR bool_or(status = 'ONLINE') AS in_use FROM instances GROUP BY executor_name")
def executor_delete_guard(jobs: DataFrame, groups: DataFrame, instances: DataFrame) -> DataFrame:
    """An executor is in use while a job or a group names it or an instance is online."""
    used = jobs.select("executor_name").unionByName(groups.select("executor_name")).distinct().withColumn("used", F.lit(True))
    online = instances.groupBy("executor_name").agg(F.bool_or(F.col("status") == "ONLINE").alias("online"))
    return online.join(used, "executor_name", "left").select("executor_name", (F.col("used").isNotNull() | F.col("online")).alias("in_use"))


@query("d18_target_save", "targets", "SELECT execution_id, shard_index, instance_id, carried, acknowledged, attempt + 1 AS attempt, CASE WHEN acknowledged OR status IN {terminal} THEN status ELSE 'DISPATCHED' END AS status FROM targets")
def target_save(targets: DataFrame) -> DataFrame:
    """Dispatching again is another attempt, and never takes back an acknowledgement or a result."""
    kept = F.col("acknowledged") | is_terminal()
    return targets.select("execution_id", "shard_index", "instance_id", "carried", "acknowledged", (F.col("attempt") + 1).alias("attempt"), F.when(kept, F.col("status")).otherwise("DISPATCHED").alias("status"))


@query("d31_round_robin", "executions", "SELECT execution_id, (row_number() OVER (PARTITION BY job_id ORDER BY scheduled_fire_time, execution_id) - 1) % 3 AS instance FROM executions", instances=3)
def round_robin(executions: DataFrame, instances: int) -> DataFrame:
    """Each routing key's dispatches in order of arrival go round the instances.

    A key's dispatches are numbered day by day, after those of the days before, so that a hot key is not sorted in one task.
    """
    rows = executions.select("execution_id", "job_id", "scheduled_fire_time", F.to_date("scheduled_fire_time").alias("day"))
    days = rows.groupBy("job_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("job_id", "day", (F.sum("n").over(W.partitionBy("job_id").orderBy(F.col("day").asc_nulls_first())) - F.col("n")).alias("before"))
    mine = F.row_number().over(W.partitionBy("job_id", "day").orderBy(F.col("scheduled_fire_time").asc_nulls_first(), "execution_id"))
    met = rows.withColumn("mine", mine).join(before.withColumnsRenamed({"job_id": "_job", "day": "_day"}), F.col("job_id").eqNullSafe(F.col("_job")) & F.col("day").eqNullSafe(F.col("_day")))
    return met.select("execution_id", F.pmod(F.col("before") + F.col("mine") - 1, F.lit(instances)).alias("instance"))
