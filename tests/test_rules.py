"""Literal rows for guards and fences, and models in Python of the queries that DuckDB cannot run."""

import datetime
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, filters, joins, routing, transitions, windows
from tidewheel.plans import registry
from tidewheel.plans.relations import relation

DATA = "/root/testdata/sf0.001"
NOW_T = datetime.datetime(2024, 1, 31)
EARLY, NOW, LATE = "2024-01-30 23:00:00", "2024-01-31 00:00:00", "2024-01-31 01:00:00"


def table(spark, rows, ddl):
    """Rows as a DataFrame; columns declared ``time`` are texts of UTC times."""
    names = [c.split() for c in ddl.split(", ")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if t == 'time' else t}" for n, t in names))
    return df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if t == "time" else F.col(n) for n, t in names])


def by(df, key, *values):
    return {r[key]: tuple(str(r[v]) if "20" in str(r[v]) and ":" in str(r[v]) else r[v] for v in values) for r in df.collect()}


def test_illegal_report_changes_nothing(spark):
    executions = table(spark, [(1, "RUNNING", 2, 1, None, EARLY), (2, "SUCCEEDED", 2, 1, None, EARLY), (3, "DISPATCHING", 5, 4, LATE, EARLY)], "execution_id int, status string, expected_targets int, accepted_targets int, timeout_at time, updated_at time")
    reports = table(spark, [(1, "SUCCEEDED", 3, 2, LATE), (2, "RUNNING", 9, 9, LATE), (3, "DISPATCHED", 3, 2, EARLY), (4, "DISPATCHED", 1, 0, LATE)], "execution_id int, reported string, expected int, accepted int, until time")
    got = by(transitions.save_merge(executions, reports), "execution_id", "status", "expected_targets", "accepted_targets", "timeout_at", "updated_at")
    assert got == {1: ("SUCCEEDED", 3, 2, LATE, NOW), 2: ("SUCCEEDED", 2, 1, None, EARLY), 3: ("DISPATCHED", 5, 4, LATE, NOW), 4: ("DISPATCHED", 1, 0, LATE, NOW)}


def test_fences(spark):
    """One command applies; a wrong cursor, owner, token, an expired lease and a cursor in the future do not."""
    jobs = table(spark, [(k, k if k < 6 else 1, LATE if k == 5 else EARLY, 7) for k in range(1, 7)], "job_id int, shard_id int, next_fire_time time, version int")
    leases = table(spark, [(k, "a", 3, EARLY if k == 4 else LATE) for k in range(1, 6)], "shard_id int, owner_node_id string, fencing_token int, lease_until time")
    commands = table(spark, [(1, LATE, LATE, "a", 3), (2, EARLY, LATE, "b", 3), (3, EARLY, LATE, "a", 2), (4, EARLY, LATE, "a", 3), (5, LATE, LATE, "a", 3), (6, EARLY, LATE, "a", 3)], "job_id int, expected time, wanted time, owner string, token int")
    got = by(transitions.fenced_cas(jobs, commands, leases), "job_id", "applied", "next_fire_time", "version")
    assert got == {k: (k == 6, LATE if k in (5, 6) else EARLY, 8 if k == 6 else 7) for k in range(1, 7)}
    renewed = by(transitions.renew_lease(leases, "a", 3), "shard_id", "applied")
    assert renewed == {k: (k != 4,) for k in range(1, 6)}
    assert not any(v[0] for v in by(transitions.renew_lease(leases, "a", 2), "shard_id", "applied").values())
    assert by(transitions.release_lease(leases, "a", 3), "shard_id", "applied", "fencing_token") == {k: (True, 3) for k in range(1, 6)}


def test_claim_guards(spark):
    rows = [(k, k, "REMOTE", "PENDING", 0, EARLY, None, None) for k in range(1, 5)] + [(5, 5, "LOCAL", "PENDING", 0, EARLY, None, None), (6, 5, "REMOTE", "CLAIMED", 2, EARLY, EARLY, None), (7, 5, "REMOTE", "SENT", 2, EARLY, None, LATE)]
    outbox = table(spark, rows, "outbox_id int, execution_id int, dispatch_type string, status string, attempt int, available_at time, claim_until time, ack_deadline time")
    executions = table(spark, [(1, "RUNNING", LATE), (2, "RUNNING", EARLY), (3, "RUNNING", None), (4, "FAILED", LATE), (5, "DISPATCHING", LATE)], "execution_id int, status string, timeout_at time")
    got = by(transitions.claim(outbox, executions, "me", ["REMOTE"]), "outbox_id", "attempt", "claim_owner", "claim_until")
    assert got == {1: (1, "me", "2024-01-31 00:00:30"), 6: (3, "me", "2024-01-31 00:00:30")}


def test_versions_rise_on_every_call(spark):
    jobs = table(spark, [(1, True, 4), (2, False, 4)], "job_id int, enabled boolean, version int")
    wanted = table(spark, [(1, True), (2, True), (9, True)], "job_id int, wanted boolean")
    assert by(transitions.enable(jobs, wanted), "job_id", "enabled", "version") == {1: (True, 5), 2: (True, 5)}


def test_what_was_not_dispatched_has_no_delay(spark):
    rows = [(1, "F", NOW, LATE), (1, "F", NOW, None), (2, "F", LATE, NOW), (3, "P", NOW, None)]
    executions = table(spark, rows, "job_id int, status string, scheduled_fire_time time, dispatch_time time")
    assert by(aggregates.average_delay(executions), "job_id", "delay_ms") == {1: (3600000,), 2: (0,), 3: (None,)}
    assert by(aggregates.scheduling_latency(executions), "status", "n", "p50", "top") == {"F": (2, 0, 3600000)}
    hist = by(aggregates.latency_histogram(executions), "le", "n", "observed", "sum_s", "max_s")
    assert hist[0.01] == (1, 2, 3600.0, 3600.0) and hist[1e308] == (2, 2, 3600.0, 3600.0)


@pytest.mark.parametrize("seed", range(4))
def test_ranks(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.integers(0, 5, 500), rng.lognormal(9, 3, 4000).astype(int), [7_000_000_000]])
    groups = rng.integers(0, 3, len(values))
    rows = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "g int, v bigint")
    for r in aggregates.exact_ranks(rows, ["g"], "v", [1, 50, 99, 100]).collect():
        own = np.sort(values[groups == r["g"]])
        assert r["n"] == len(own) and [r[f"p{p}"] for p in (1, 50, 99, 100)] == [own[-(-p * len(own) // 100) - 1] for p in (1, 50, 99, 100)]
    assert tuple(aggregates.exact_ranks(rows.limit(0), [], "v", [50]).first()) == (None, None, None)


def test_predecessor_is_the_attempt_before(spark):
    rows = table(spark, [(1, 1, 1), (3, 1, 3), (4, 1, 4), (9, 9, 1)], "execution_id int, root_execution_id int, run_attempt int")
    assert by(joins.retry_predecessor(rows), "execution_id", "predecessor") == {1: (None,), 3: (None,), 4: (3,), 9: (None,)}


def test_handlers_given_as_parameters(spark):
    rows = [(1, "remote:a:b:c", ""), (2, "remote:a", ""), (3, "plain", "executorName=x&handlerName=y"), (4, "remote:a:b", "executorName=%20"), (5, "plain", None)]
    got = by(filters.handler_names(table(spark, rows, "job_id int, handler_name string, parameters string")), "job_id", "executor", "handler")
    assert got == {1: ("a", "b:c"), 2: ("a", "remote:a"), 3: ("x", "y"), 4: ("a", "b"), 5: ("embedded", "plain")}


def fnv(text, signed):
    h, raw = 0xCBF29CE484222325, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x100000001B3) % (1 << 64)
    return h - (1 << 64) if signed and h >> 63 else h


def best(key, nodes, separator, signed):
    return max(((fnv(f"{key}{separator}{n}", signed), n) for n in nodes))[1] if nodes else None


def test_owners_against_a_model(spark):
    """w13, w14, j09 and d24 of the driver's tables."""
    nodes = relation(spark, DATA, "nodes").collect()
    live = sorted(n["node_id"] for n in nodes if n["status"] == "ONLINE" and (NOW_T - n["last_heartbeat_at"]).total_seconds() <= 15)
    want = {k: best(k, live, ":", True) for k in range(32)}
    assert {r["shard_id"]: r["owner"] for r in registry.QUERIES["w13_shard_owners"](spark, DATA).collect()} == want
    leases = {r["shard_id"]: r for r in relation(spark, DATA, "leases").collect()}
    action = lambda k: "ACQUIRE" if k not in leases or leases[k]["lease_until"] <= NOW_T else "RENEW" if leases[k]["owner_node_id"] == want[k] else "RELEASE"
    assert {r["shard_id"]: (r["owner"], r["action"]) for r in registry.QUERIES["d24_reconcile"](spark, DATA).collect()} == {k: (want[k], action(k)) for k in range(32)}
    instances = sorted(r["instance_id"] for r in relation(spark, DATA, "instances").collect() if r["lease_until"] > NOW_T and r["executor_name"] == "exec-1")
    jobs = [r["job_name"] for r in relation(spark, DATA, "jobs").collect()]
    assert {r["routing_key"]: r["owner"] for r in registry.QUERIES["w14_routing_owners"](spark, DATA).collect()} == {j: best(j, instances, "\x00", False) for j in jobs}
    keys = [f"{r['execution_id']}:{k}" for r in relation(spark, DATA, "executions").collect() for k in range(r["expected_targets"])]
    assert Counter((r["routing_key"], r["owner"]) for r in registry.QUERIES["j09_shard_instances"](spark, DATA).collect()) == Counter((k, best(k, instances, "\x00", False)) for k in keys)


def test_reshard_against_a_model(spark):
    def shard(key):
        crc = zlib.crc32(str(key).encode())
        return (crc - (1 << 32) if crc >> 31 else crc) % 64

    jobs = relation(spark, DATA, "jobs").collect()
    quiet = {r["job_id"]: tuple(r) for r in registry.QUERIES["d25b_reshard_quiet"](spark, DATA).collect()}
    assert quiet == {j["job_id"]: (j["job_id"], shard(j["job_id"]), j["version"] + 1, True) for j in jobs}
    busy = {r["job_id"]: tuple(r) for r in registry.QUERIES["d25_reshard"](spark, DATA).collect()}
    assert busy == {j["job_id"]: (j["job_id"], j["shard_id"], j["version"], False) for j in jobs}


def test_random_routing_is_even_and_the_same_again(spark):
    one, two = ({r["execution_id"]: r["instance"] for r in registry.QUERIES["d32_random_routing"](spark, DATA).collect()} for _ in range(2))
    share = Counter(one.values())
    assert one == two and set(share) == {0, 1, 2} and min(share.values()) > 0.25 * len(one)
    other = {r["execution_id"]: r["instance"] for r in routing.random_routing(relation(spark, DATA, "executions"), 3, 8).collect()}
    assert other != one


def test_round_robin_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(k, 1 if rng.random() < 0.8 else k % 9, f"2024-01-{1 + rng.randrange(28):02} 00:00:{rng.randrange(3):02}" if rng.random() < 0.95 else None) for k in range(3000)]
    got = by(transitions.round_robin(table(spark, rows, "execution_id int, job_id int, scheduled_fire_time time"), 3), "execution_id", "instance")
    turn = Counter()
    for k, job, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        assert got[k] == (turn[job] % 3,)
        turn[job] += 1


def test_exposition(spark):
    lines = [r["line"] for r in registry.QUERIES["s10b_exposition"](spark, DATA).collect()]
    assert len(lines) == 2 + 33 - 4 + 9 + 3 + 32 and lines[1] == 'scheduler_up{plugin="metrics"} 1'
    jobs = relation(spark, DATA, "jobs")
    assert f"scheduler_jobs_total {jobs.count()}" in lines and f"scheduler_jobs_due_total {jobs.where(filters.is_due()).count()}" in lines
    assert sum(int(x.rsplit(" ", 1)[1]) for x in lines if x.startswith("scheduler_shard_due_jobs")) == jobs.where(filters.is_due()).count()
    bounds = [x for x in lines if "_bucket" in x]
    assert len(bounds) == 9 and 'le="+Inf"' in bounds[-1] and bounds == sorted(bounds, key=lambda x: int(x.rsplit(" ", 1)[1]))


@pytest.mark.parametrize(
    "wanted, expected",
    [
        ("asia/tokyo", [("Asia/Tokyo", 0)]),
        (" America/n", [("America/New_York", 1)]),
        ("york", [("America/New_York", 2)]),
        ("new_y", [("America/New_York", 3)]),
        ("kyo", [("Asia/Tokyo", 3)]),
        ("new york", [("America/New_York", 4)]),
        ("as-t", [("Asia/Tokyo", 4)]),
        ("a", [("America/New_York", 1), ("Asia/Tokyo", 1), ("Etc/GMT+5", None)]),
        ("+5", [("Etc/GMT+5", 3)]),
        ("", [("UTC", 0), ("Asia/Tokyo", 3), ("America/New_York", 7), ("Etc/GMT+5", 100)]),
        ("zzz", []),
    ],
)
def test_zone_search(spark, wanted, expected):
    zones = spark.createDataFrame([(z,) for z in ("Etc/GMT+5", "UTC", "Asia/Tokyo", "America/New_York", "Asia/Tokyo", None)], "zone string")
    got = [(r["zone"], r["score"]) for r in windows.name_search(zones, "zone", wanted).collect()]
    assert got == [e for e in expected if e[1] is not None]
    assert [(r["zone"], r["score"]) for r in windows.name_search(zones, "zone", wanted, 1).collect()] == got[:1]
