"""Fire times: fixed rate, cron, misfires, catch-up and the next cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cron
from ..plans.query import NOW, now, query
from .filters import is_due


def seconds(column: str) -> Column:
    return F.expr(f"{column} * INTERVAL '1' SECOND")


@query("e04_fixed_rate_next", "jobs", "SELECT job_id, next_fire_time + interval_s * INTERVAL '1' SECOND AS following FROM jobs")
def fixed_rate_next(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", (F.col("next_fire_time") + seconds("interval_s")).alias("following"))


@query("e05_daily_cron", "jobs", "SELECT job_id, concat('0 ', minute(next_fire_time), ' ', hour(next_fire_time), ' * * *') AS cron FROM jobs")
def daily_cron(jobs: DataFrame) -> DataFrame:
    """The cron text of a daily time; its seconds are dropped."""
    return jobs.select("job_id", F.format_string("0 %d %d * * *", F.minute("next_fire_time"), F.hour("next_fire_time")).alias("cron"))


MISFIRED = "next_fire_time + grace_s * INTERVAL '1' SECOND < {now}"
FIRES_SQL = f"CASE WHEN NOT ({MISFIRED}) OR misfire_policy = 'FIRE_ONCE' THEN 1 WHEN misfire_policy = 'SKIP' THEN 0 ELSE least(max_catch_up, date_diff('second', next_fire_time, {{now}}) // interval_s + 1) END"


def fire_times() -> Column:
    """What a due job fires: its cursor, nothing, or the times up to now that catch-up allows."""
    late = F.col("next_fire_time") + seconds("grace_s") < now()
    due = F.array("next_fire_time")
    every = F.expr(f"slice(sequence(next_fire_time, {NOW}, interval_s * INTERVAL '1' SECOND), 1, max_catch_up)")
    none = F.filter(due, lambda x: F.lit(False))
    return F.when(~late | (F.col("misfire_policy") == "FIRE_ONCE"), due).when(F.col("misfire_policy") == "SKIP", none).otherwise(every)


def advances(jobs: DataFrame) -> DataFrame:
    """Due jobs with their fire times and next cursor.

    The cursor follows the last fire, or now if nothing fires or the follower would still be due outside catch-up;
    after now means now plus the interval, so a phase may drift.
    """
    rows = jobs.where(is_due()).withColumn("fire_times", fire_times())
    last = F.element_at("fire_times", -1) + seconds("interval_s")
    later = now() + seconds("interval_s")
    cursor = F.when(F.size("fire_times") == 0, later).when((F.col("misfire_policy") != "CATCH_UP") & (last <= now()), later).otherwise(last)
    return rows.withColumn("next_cursor", cursor)


@query("t07_misfire_decision", "jobs", f"SELECT job_id, CAST({FIRES_SQL} AS INT) AS fires FROM jobs WHERE enabled AND next_fire_time <= {{now}}")
def misfire_decision(jobs: DataFrame) -> DataFrame:
    return advances(jobs).select("job_id", F.size("fire_times").alias("fires"))


@query("t08_catch_up", "jobs", f"SELECT job_id, next_fire_time + k * interval_s * INTERVAL '1' SECOND AS fire_time FROM jobs, range(6) r(k) WHERE enabled AND next_fire_time <= {{now}} AND k < ({FIRES_SQL})")
def catch_up(jobs: DataFrame) -> DataFrame:
    return advances(jobs).select("job_id", F.explode("fire_times").alias("fire_time"))


@query(
    "t09_next_cursor",
    "jobs",
    f"""WITH f AS (SELECT *, {FIRES_SQL} AS n FROM jobs WHERE enabled AND next_fire_time <= {{now}})
        SELECT job_id, CASE WHEN n = 0 OR (misfire_policy <> 'CATCH_UP' AND next_fire_time + interval_s * INTERVAL '1' SECOND <= {{now}}) THEN {{now}} + interval_s * INTERVAL '1' SECOND
          ELSE next_fire_time + n * interval_s * INTERVAL '1' SECOND END AS next_cursor FROM f""",
)
def next_cursor(jobs: DataFrame) -> DataFrame:
    return advances(jobs).select("job_id", "next_cursor")


@query("t03_cron_fires_utc", "jobs", "SELECT job_id, d + m * INTERVAL '1' MINUTE AS fire_time FROM jobs, range({now} - INTERVAL '1' DAY, {now} + INTERVAL '5' DAY, INTERVAL '1' DAY) r(d), range(0, 1440, 20) s(m) WHERE m BETWEEN 540 AND 659 AND dayofweek(d) BETWEEN 1 AND 5 AND d + m * INTERVAL '1' MINUTE > next_fire_time AND d + m * INTERVAL '1' MINUTE <= next_fire_time + INTERVAL '3' DAY", text="0 */20 9-10 * * MON-FRI", zone="UTC", days=3)
def cron_fires(jobs: DataFrame, text: str, zone: str, days: int) -> DataFrame:
    """Fires of one cron schedule for every job, from each one's cursor."""
    rows = jobs.select("job_id", "next_fire_time")
    return cron.fires(rows, cron.parse(text), zone, "next_fire_time", days).select("job_id", "fire_time")


@query("t03b_own_cron_fires", "jobs", days=70)
def own_cron_fires(jobs: DataFrame, days: int) -> DataFrame:
    """Fires of every job's own schedule in its own zone, from its cursor."""
    rows = cron.parsed(jobs.select("job_id", "next_fire_time", "schedule_value", "zone"), "schedule_value")
    return cron.fires(rows, "cron", F.col("zone"), "next_fire_time", days).select("job_id", "fire_time", "local_time")


@query("e03_next_after", "jobs")
def next_after(jobs: DataFrame) -> DataFrame:
    """The next fire of every job's own schedule after its cursor; null where it has none."""
    rows = jobs.select("job_id", "next_fire_time", "schedule_value", "zone")
    first = cron.next_fires(rows, "schedule_value", "zone", "next_fire_time", 1).groupBy("job_id").agg(F.min("fire_time").alias("following"))
    return jobs.select("job_id").join(first, "job_id", "left")


@query("t06_schedule_preview", "jobs", None, most=5)
def preview(jobs: DataFrame, most: int) -> DataFrame:
    """The next fires of each job with their local time; the most is clamped to 1 to 20, as the feature has it."""
    most = max(1, min(cron.MOST, most))
    all_fires = cron.next_fires(jobs.select("job_id", "next_fire_time", "schedule_value", "zone"), "schedule_value", "zone", "next_fire_time", most)
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("fire_time"))
    return all_fires.withColumn("k", rank).where(F.col("k") <= most).select("job_id", "k", "fire_time", "local_time")


@query("e06_retry_backoff", "executions", "SELECT execution_id, CAST(least(60000, CASE WHEN run_attempt < 2 THEN 0 ELSE floor(1000 * pow(2.5, run_attempt - 2) + 0.5) END) AS BIGINT) AS delay_ms FROM executions")
def retry_backoff(executions: DataFrame, initial: int = 1000, multiplier: float = 2.5, most: int = 60000) -> DataFrame:
    return executions.select("execution_id", backoff_ms(F.col("run_attempt") - 1, initial, multiplier, most).alias("delay_ms"))


def backoff_ms(attempt: Column, initial: int, multiplier: float, most: int) -> Column:
    """Delay after an attempt from 1 on, half rounded up; none before the first."""
    grown = F.floor(F.lit(initial) * F.pow(F.lit(multiplier), attempt - 1) + 0.5)
    return F.when(attempt < 1, F.lit(0).cast("long")).otherwise(F.least(F.lit(most).cast("long"), grown))


@query("e07_delivery_backoff", "outbox", "SELECT outbox_id, CAST(least(30000, 1000 * pow(2, least(attempt, 20))) AS BIGINT) AS delay_ms FROM outbox")
def delivery_backoff(outbox: DataFrame, most: int = 30000) -> DataFrame:
    return outbox.select("outbox_id", F.least(F.lit(most).cast("long"), F.expr("1000L * shiftleft(1L, least(attempt, 20))")).alias("delay_ms"))


@query("e11_duration_text", "executions", "SELECT execution_id, CASE WHEN ms < 1000 THEN concat(ms, ' ms') WHEN ms < 60000 THEN concat(printf('%.1f', ms / 1000.0), ' s') ELSE concat(ms // 60000, ' m ', ms % 60000 // 1000, ' s') END AS took FROM (SELECT execution_id, date_diff('millisecond', created_at, updated_at) AS ms FROM executions)")
def duration_text(executions: DataFrame) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.col("created_at"), F.col("updated_at"))
    minutes = F.format_string("%d m %d s", F.expr("ms div 60000"), F.expr("ms % 60000 div 1000"))
    rows = executions.select("execution_id", ms.alias("ms"))
    return rows.select("execution_id", F.when(F.col("ms") < 1000, F.format_string("%d ms", "ms")).when(F.col("ms") < 60000, F.format_string("%.1f s", F.col("ms") / 1000.0)).otherwise(minutes).alias("took"))


@query("e12_age_seconds", "outbox", "SELECT outbox_id, greatest(0, date_diff('millisecond', available_at, {now})) / 1000.0 AS age_s FROM outbox")
def age_seconds(outbox: DataFrame) -> DataFrame:
    age = F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", F.col("available_at"), now())) / 1000.0
    return outbox.select("outbox_id", F.when(F.col("available_at").isNotNull(), age).alias("age_s"))


@query("e13_clock_offset", "outbox", "SELECT outbox_id, date_diff('millisecond', dispatch_time + (date_diff('millisecond', dispatch_time, available_at) // 2) * INTERVAL '1' MILLISECOND, updated_at) AS offset_ms FROM outbox WHERE available_at >= dispatch_time")
def clock_offset(outbox: DataFrame) -> DataFrame:
    """Server time less the midpoint of the times before and after asking."""
    half = F.expr("timestampdiff(MILLISECOND, dispatch_time, available_at) div 2")
    middle = F.col("dispatch_time") + half * F.expr("INTERVAL '0.001' SECOND")
    return outbox.where("available_at >= dispatch_time").select("outbox_id", F.timestamp_diff("MILLISECOND", middle, F.col("updated_at")).alias("offset_ms"))
