"""Targets of broadcast jobs: all pairs, dealt over tasks."""

from collections import Counter

from pyspark.sql import functions as F

from tidewheel.operators.transitions import dealt_pairs, fan_out
from tidewheel.plans import registry
from tidewheel.plans.relations import relation

LARGE = "/root/testdata/sf0.1"
LATER = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"


def test_pairs_of_one_executor_are_dealt_over_tasks(spark):
    """3000 jobs and 400 instances of one executor, in one partition each, made all 1200000 rows in one task."""
    jobs = spark.range(3000, numPartitions=1).selectExpr("id AS job_id", "'BROADCAST' AS dispatch_mode", "1 AS shard_count", "concat('exec-', id div 3000) AS executor_name")
    live = spark.range(400, numPartitions=1).select(F.concat(F.lit("inst-"), "id").alias("instance_id"), F.expr("concat('exec-', id div 400)").alias("executor_name"), F.expr(LATER).alias("lease_until"), F.lit("ONLINE").alias("status"))
    rows = fan_out(jobs, live)
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 1200000 and max(tasks) < 120000
    assert rows.select("job_id", "instance_id").distinct().count() == 1200000
    assert rows.where("target_id <> concat(job_id, '@instance:', instance_id) OR shard_index IS NOT NULL").isEmpty()


def test_pairs_of_odd_rows(spark):
    """repeated jobs and instances count each time; a null name stays, an executor without instances or a null one has no rows."""
    jobs = spark.createDataFrame([(j, "BROADCAST", 1, e) for j, e in [(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "none"), (None, "a")]], "job_id long, dispatch_mode string, shard_count int, executor_name string")
    given = [("a", "x"), ("a", "x"), ("a", ""), ("a", None), ("b", "y"), (None, "z")]
    live = spark.createDataFrame(given, "executor_name string, instance_id string").withColumns({"lease_until": F.expr(LATER), "status": F.lit("ONLINE")})
    got = Counter(map(tuple, fan_out(jobs, live).collect()))
    named = lambda j, i: None if j is None or i is None else f"{j}@instance:{i}"
    assert got == Counter((j["job_id"], None, i, named(j["job_id"], i)) for j in jobs.collect() for e, i in given if e is not None and e == j["executor_name"])


def test_pairs_of_a_large_table(spark):
    """counts and sums of hashes by executor on sf0.1, against a plain join."""
    jobs, live = relation(spark, LARGE, "jobs").where("dispatch_mode = 'BROADCAST'"), relation(spark, LARGE, "instances").where("status = 'ONLINE' AND lease_until > TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    plain = jobs.join(live, "executor_name").select("job_id", "instance_id", F.concat("job_id", F.lit("@instance:"), "instance_id").alias("target_id"))
    got = registry.QUERIES["d29_fan_out"](spark, LARGE).where("instance_id IS NOT NULL").select("job_id", "instance_id", "target_id")
    sums = lambda rows: rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("job_id", "instance_id", "target_id").cast("decimal(38)"))).first()
    assert sums(got) == sums(plain)


def made(spark, n_jobs, n_instances):
    """Broadcast jobs and live instances of one executor, whose name is no constant to the optimiser."""
    name = lambda n: F.expr(f"concat('exec-', id div {n})").alias("executor_name")
    jobs = spark.range(n_jobs, numPartitions=1).select(F.col("id").alias("job_id"), F.lit("BROADCAST").alias("dispatch_mode"), F.lit(1).alias("shard_count"), name(n_jobs))
    return jobs, spark.range(n_instances, numPartitions=1).select(F.concat(F.lit("inst-"), "id").alias("instance_id"), name(n_instances), F.expr(LATER).alias("lease_until"), F.lit("ONLINE").alias("status"))


def test_copies_of_instances_are_made_by_many_tasks(spark):
    """one task made every share's copy of all instances; only the last stage had many tasks."""
    spark.sparkContext.setJobGroup("copies", "d29_fan_out")
    try:
        fan_out(*made(spark, 100, 5000)).write.format("noop").mode("overwrite").save()
        seen = spark.sparkContext.statusTracker()
        stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("copies") for s in seen.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(s.numCompletedTasks >= 100 for s in stages if s) == 2, stages


def test_stored_pairs_take_little_room(spark, tmp_path):
    """F1: all instances of a job were stored in one go, so that names hardly repeated within a compressed block: 11.4 bytes a row."""
    jobs, live = made(spark, 100, 30000)
    pairs = dealt_pairs(jobs.select("job_id", "executor_name"), live.select("executor_name", "instance_id"), shares=8, parts=8)
    pairs.select("job_id", "instance_id", F.concat("prefix", "instance_id").alias("target_id")).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 3000000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 9 * 3000000
