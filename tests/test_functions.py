"""Golden vectors and independent models of cron, hashes, codecs and fire times."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import codecs, cron
from tidewheel.functions.hashing import crc_shard, fnv1a64
from tidewheel.operators.temporal import advances, next_after, own_cron_fires, preview

UTC = "timestamp_ntz"


def next_fires(spark, text, zone, after, n=1, days=40):
    rows = spark.createDataFrame([(after,)], "a string").select(F.col("a").cast(UTC).alias("a"))
    out = cron.fires(rows, cron.parse(text), zone, "a", days).orderBy("fire_time").limit(n)
    return [r["fire_time"].isoformat(" ") for r in out.collect()]


@pytest.mark.parametrize(
    "text, zone, after, expected",
    [
        ("0 0 9 * * *", "Asia/Shanghai", "2026-07-06 00:59:59", ["2026-07-06 01:00:00"]),
        ("*/5 * * * * *", "UTC", "2026-07-06 01:00:01", ["2026-07-06 01:00:05"]),
        ("0 10,20 8-9 * * *", "UTC", "2026-07-06 08:10:00", ["2026-07-06 08:20:00"]),
        ("0 0 0 L * *", "UTC", "2026-07-01 00:00:00", ["2026-07-31 00:00:00"]),
        ("0 0 9 * * MON#2", "UTC", "2026-07-01 00:00:00", ["2026-07-13 09:00:00"]),
        ("0 30 2 * * *", "America/New_York", "2026-03-08 06:59:59", ["2026-03-09 06:30:00"]),
        ("0 30 1 * * *", "America/New_York", "2026-11-01 05:00:00", ["2026-11-01 05:30:00", "2026-11-01 06:30:00"]),
        ("0 0 0 LW * *", "UTC", "2026-05-01 12:00:00", ["2026-05-29 00:00:00"]),
        ("0 0 0 15W * *", "UTC", "2026-08-01 00:00:00", ["2026-08-14 00:00:00"]),
        ("0 0 0 * * 5L", "UTC", "2026-07-01 00:00:00", ["2026-07-31 00:00:00"]),
    ],
)
def test_cron(spark, text, zone, after, expected):
    # one-day windows where seconds would make many rows
    assert next_fires(spark, text, zone, after, len(expected), 1 if text.startswith("*/5") else 40) == expected


@pytest.mark.parametrize(
    "text, zone, most, expected",
    [
        ("0 0 9 1 * *", "UTC", 3, ["2024-02-01 09:00:00", "2024-03-01 09:00:00", "2024-04-01 09:00:00"]),
        ("0 0 0 L * *", "UTC", 3, ["2024-02-29 00:00:00", "2024-03-31 00:00:00", "2024-04-30 00:00:00"]),
        ("0 0 9 * * MON#2", "UTC", 2, ["2024-02-12 09:00:00", "2024-03-11 09:00:00"]),
        ("0 0 9 * * MON", "Asia/Shanghai", 3, ["2024-02-05 01:00:00", "2024-02-12 01:00:00", "2024-02-19 01:00:00"]),
        ("0 0 0 29 2 *", "UTC", 20, [f"{y}-02-29 00:00:00" for y in range(2024, 2108, 4) if y != 2100]),
        ("0 0 0 29 2 MON", "UTC", 2, ["2044-02-29 00:00:00", "2072-02-29 00:00:00"]),
        ("0 0 0 30 2 *", "UTC", 5, []),
        ("0 30 2 8-14 3 SUN", "America/New_York", 5, []),
        ("30 59 * * * *", "UTC", 2, ["2024-01-31 10:59:30", "2024-01-31 11:59:30"]),
    ],
)
def test_preview_has_its_count(spark, text, zone, most, expected):
    rows = [(1, "2024-01-31 10:30:00"), (2, "2024-01-31 10:30:00"), (3, None)]
    jobs = spark.createDataFrame(rows, "job_id int, t string").select("job_id", F.col("t").cast(UTC).alias("next_fire_time"), F.lit(text).alias("schedule_value"), F.lit(zone).alias("zone"))
    got = sorted((r["job_id"], r["k"], str(r["fire_time"])) for r in preview(jobs, most).collect())
    assert got == [(j, k + 1, t) for j in (1, 2) for k, t in enumerate(expected)]


def model_fires(text, zone, after, until):
    """Every fire in (after, until], second by second of the local clock of each instant, minute steps for speed."""
    from zoneinfo import ZoneInfo

    c, out, at = cron.parse(text), [], after.replace(second=0)
    while at <= until:
        local = at.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        if local.minute in c.minutes and local.hour in c.hours and c.matching()[(local.date() - dt.date(2000, 1, 1)).days]:
            out += [at + dt.timedelta(seconds=s) for s in c.seconds if after < at + dt.timedelta(seconds=s) <= until]
        at += dt.timedelta(minutes=1)
    return out


ROWS = [
    ("0 */20 9-10 * * MON-FRI", "America/New_York", "2024-03-08 00:00:10"),
    ("0 30 1,2 * * *", "America/New_York", "2024-03-09 06:29:59"),
    ("15,45 10 */6 1-12 11 *", "Europe/Berlin", "2024-10-31 12:00:00"),
    ("0 0 0 L-2 * *", "Asia/Kolkata", "2024-02-20 18:30:00"),
    ("0 0 12 15W * *", "UTC", "2024-06-01 00:00:00"),
    ("0 5 0 ? * TUE#3", "Australia/Lord_Howe", "2024-04-01 00:00:00"),
    ("not a cron text", "UTC", "2024-04-01 00:00:00"),
    ("0 0 0 30 2 *", "UTC", "2024-04-01 00:00:00"),
]


def test_own_schedules_against_a_model(spark):
    """A text and a zone in each row, next to a minute-by-minute model."""
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "job_id int, schedule_value string, zone string, t string").withColumn("next_fire_time", F.col("t").cast(UTC))
    want = {}
    for k, (text, zone, after) in enumerate(ROWS):
        begin = dt.datetime.fromisoformat(after)
        want[k] = model_fires(text, zone, begin, begin + dt.timedelta(days=21)) if text[0].isdigit() else []
    got = {k: [] for k in want}
    for r in own_cron_fires(rows, 21).collect():
        got[r["job_id"]].append(r["fire_time"])
    assert {k: sorted(v) for k, v in got.items()} == want
    first = {r["job_id"]: r["following"] for r in next_after(rows).collect()}
    assert all(first[k] == v[0] for k, v in want.items() if v) and first[6] is None and first[7] is None and len(first) == len(ROWS)
    shown = {k: [] for k in want}
    for r in preview(rows, 3).collect():
        shown[r["job_id"]].append(r["fire_time"])
    assert all(sorted(shown[k])[: len(v[:3])] == v[:3] for k, v in want.items()) and [len(shown[k]) for k in shown] == [3] * 6 + [0, 0]


@pytest.mark.parametrize("text", ["0 0 9 * *", "60 * * * * *", "0 0 0 32 * *", "0 5-1 * * * *", "x * * * * *"])
def test_cron_rejects(text):
    with pytest.raises(ValueError):
        cron.parse(text)


def fnv(text):
    h, raw = 0xCBF29CE484222325, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x100000001B3) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_hashes(spark):
    keys = ["", "a", "job-1", "7:node-3", "ключ", "漢字", "🙂x", *(f"k{i}" for i in range(300))]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fnv1a64(F.col("k")).alias("h"), *[crc_shard(F.col("k"), n).alias(f"s{n}") for n in (7, 32, 100)]).collect()
    for r in rows:
        assert r["h"] == fnv(r["k"])
        crc = zlib.crc32(r["k"].encode())
        signed = crc - (1 << 32) if crc >> 31 else crc
        assert [r["s7"], r["s32"], r["s100"]] == [signed % 7, signed % 32, signed % 100]


def test_codecs(spark):
    one = spark.range(1)
    m = F.create_map(F.lit("b k"), F.lit("1&2"), F.lit("a"), F.lit("é="))
    got = one.select(codecs.encode_map(m).alias("t")).select("t", codecs.decode_map(F.col("t")).alias("m"), codecs.decode_map(F.lit("")).alias("none")).first()
    assert got["t"] == "a=%C3%A9%3D&b+k=1%262" and got["m"] == {"a": "é=", "b k": "1&2"} and got["none"] == {}
    times = ["2026-01-02 03:04:05", "2026-01-02 03:04:05.120000", "2026-01-02 03:04:05.000120"]
    shown = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(codecs.instant_text(F.col("t").cast(UTC))).collect()]
    assert shown == ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.120Z", "2026-01-02T03:04:05.000120Z"]
    texts = {"PT5S": 5000, "PT1H2M3.5S": 3723500, "P1DT1S": 86401000, "PT0.001S": 1}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codecs.duration_ms(F.col("t")).alias("ms")).collect()
    assert {r["t"]: r["ms"] for r in got} == texts


@pytest.mark.parametrize(
    "due, grace, policy, most, fires, following",
    [
        (-10, 20, "FIRE_ONCE", 3, [-10], 5),
        (-20, 0, "SKIP", 3, [], 5),
        (-20, 0, "FIRE_ONCE", 3, [-20], 5),
        (-20, 0, "CATCH_UP", 3, [-20, -15, -10], -5),
        (0, 0, "CATCH_UP", 3, [0], 5),
    ],
)
def test_advances(spark, due, grace, policy, most, fires, following):
    zero = dt.datetime(2024, 1, 31)
    at = lambda s: zero + dt.timedelta(seconds=s)
    row = spark.createDataFrame([(1, at(due).isoformat(" "), grace, policy, most, 5, True)], "job_id int, t string, grace_s int, misfire_policy string, max_catch_up int, interval_s int, enabled boolean")
    got = advances(row.withColumn("next_fire_time", F.col("t").cast(UTC))).first()
    assert got["fire_times"] == [at(s) for s in fires] and got["next_cursor"] == at(following)
