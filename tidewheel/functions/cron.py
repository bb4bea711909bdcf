"""Cron schedules: second, minute, hour, day of month, month, day of week.

A text is parsed into sets of values, which are a struct column: one text for a whole table, or a text and a zone in each row, where every
distinct text is parsed once. Local dates are matched first; the instants of those that match come from candidates in UTC,
a quarter of an hour apart, whose local date and hour are matched; minutes and seconds are added inside
the quarter, because offsets change only at its edges. A local time that a clock change skips has no
instant and does not fire; one that is repeated has two and fires twice. A text that is no cron text has no fires.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Days after which dates and weekdays of the calendar repeat.
CYCLE = 146_097
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "SUN MON TUE WED THU FRI SAT".split()
#: Fires of a row that can be asked for.
MOST = 20
FIELDS = "seconds array<int>, minutes array<int>, hours array<int>, days array<int>, day_rule string, day_n int, months array<int>, weekdays array<int>, week_rule string, week_day int, week_n int, horizon int"


@dataclass(frozen=True)
class Cron:
    seconds: tuple[int, ...]
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    day_rule: str
    day_n: int
    months: tuple[int, ...]
    weekdays: tuple[int, ...]  # 0 is Sunday
    week_rule: str
    week_day: int
    week_n: int

    def horizon(self, most: int) -> int:
        """Days that hold so many matching dates after any day that ``most`` fires are left if clock changes skip half of them; 0 if no date matches."""
        at = np.flatnonzero(self.matching())
        if not len(at):
            return 0
        ahead = 2 * most + 1
        turns = np.concatenate([at + k * CYCLE for k in range(2 + ahead // len(at))])
        return int((turns[ahead : ahead + len(at)] - turns[: len(at)]).max()) + 2

    def matching(self) -> np.ndarray:
        """Which dates of a calendar cycle match."""
        month, day, week, last = calendar()
        if self.day_rule == "last":
            in_month = day == last - self.day_n
        elif self.day_rule:
            aim = last if self.day_rule == "last weekday" else np.minimum(self.day_n, last)
            on = (week + aim - day) % 7  # the weekday of the date aimed at
            near = aim + np.select([(on == 6) & (aim == 1), on == 6, (on == 0) & (aim == last), on == 0], [2, -1, -2, 1], 0)
            in_month = day == near
        else:
            in_month = np.isin(day, self.days)
        if self.week_rule:
            in_week = (week == self.week_day) & ((day + 6) // 7 == self.week_n if self.week_rule == "nth" else day + 7 > last)
        else:
            in_week = np.isin(week, self.weekdays)
        return np.isin(month, self.months) & in_month & in_week


@lru_cache(maxsize=1)
def calendar() -> tuple[np.ndarray, ...]:
    """Month, day, weekday (0 is Sunday) and last day of the month of every date of a cycle."""
    dates = np.datetime64("2000-01-01") + np.arange(CYCLE)
    months = dates.astype("datetime64[M]")
    length = ((months + 1).astype("datetime64[D]") - months.astype("datetime64[D]")).astype(int)
    return months.astype(int) % 12 + 1, (dates - months.astype("datetime64[D]")).astype(int) + 1, (dates.astype(int) + 4) % 7, length


def _values(text: str, low: int, high: int, names: list[str] = (), base: int = 0) -> tuple[int, ...]:
    def number(x: str) -> int:
        value = names.index(x.upper()) + base if x.upper() in names else int(x)
        if not low <= value <= high:
            raise ValueError(f"{x} is not within {low} and {high}")
        return value

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            first, last = low, high
        elif "-" in span:
            first, last = map(number, span.split("-", 1))
        else:
            first = number(span)
            last = high if step else first
        if first > last or step and int(step) < 1:
            raise ValueError(f"{part} is no range")
        out.update(range(first, last + 1, int(step or 1)))
    return tuple(sorted(out))


def parse(text: str) -> Cron:
    """ValueError unless the text has six valid fields."""
    fields = text.split()
    if len(fields) != 6:
        raise ValueError("a cron text has six fields")
    second, minute, hour, day, month, weekday = fields
    day_rule, day_n, days = "", 0, ()
    if day.upper().startswith("L"):
        rest = day.upper()[1:]
        day_rule, day_n = ("last weekday", 0) if rest == "W" else ("last", int(rest[1:]) if rest.startswith("-") else 0)
        if rest not in ("", "W") and not rest.startswith("-"):
            raise ValueError(f"{day} is no day of month")
    elif day.upper().endswith("W"):
        day_rule, day_n = "near", _values(day[:-1], 1, 31)[0]
    else:
        days = _values(day, 1, 31)
    week_rule, week_day, week_n, weekdays = "", 0, 0, ()
    if "#" in weekday:
        name, nth = weekday.split("#")
        week_rule, week_day, week_n = "nth", _values(name, 0, 7, DAYS)[0] % 7, int(nth)
    elif weekday.upper().endswith("L") and weekday not in ("*",):
        week_rule, week_day = "last", _values(weekday[:-1], 0, 7, DAYS)[0] % 7
    else:
        weekdays = tuple(sorted({d % 7 for d in _values(weekday, 0, 7, DAYS)}))
    return Cron(_values(second, 0, 59), _values(minute, 0, 59), _values(hour, 0, 23), days, day_rule, day_n, _values(month, 1, 12, MONTHS, 1), weekdays, week_rule, week_day, week_n)


def constant(cron: Cron) -> Column:
    """A parsed text as a struct column."""
    fields = asdict(cron) | {"horizon": cron.horizon(MOST)}
    return F.struct(*[(F.array(*map(F.lit, v)).cast("array<int>") if isinstance(v, tuple) else F.lit(v)).alias(k) for k, v in fields.items()])


def parsed(rows: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """Adds cron, the parsed text of each row, null for a text that is none; every distinct text is parsed once."""

    @F.pandas_udf(FIELDS)
    def fields(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FIELDS.split(", ")]

        def one(t: str | None) -> list:
            try:
                c = parse(t or "")
            except ValueError:
                return [None] * len(names)
            known = asdict(c) | {"horizon": c.horizon(most)}
            return [list(v) if isinstance(v := known[n], tuple) else v for n in names]

        return pd.DataFrame([one(t) for t in texts], columns=names).astype(object)

    # declared not deterministic, as Spark would push a filter on the result below distinct and parse every row's text there
    known = rows.select(F.col(text).alias("_text")).distinct().withColumn("cron", fields.asNondeterministic()("_text"))
    known = known.withColumn("cron", F.when(F.col("cron.horizon").isNotNull(), F.col("cron")))
    return rows.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def day_matches(cron: Column, day: Column) -> Column:
    """Whether a local date fires; day of month and day of week must both hold."""
    of_month, of_week, last = F.dayofmonth(day), F.dayofweek(day) - 1, F.last_day(day)
    rule, n = cron["day_rule"], cron["day_n"]
    aim = F.when(rule == "last weekday", last).otherwise(F.make_date(F.year(day), F.month(day), F.least(n, F.dayofmonth(last))))
    on = F.dayofweek(aim)
    near = F.when(on == 7, F.when(F.dayofmonth(aim) == 1, 2).otherwise(-1)).when(on == 1, F.when(aim == last, -2).otherwise(1)).otherwise(0)
    in_month = F.when(rule == "", F.array_contains(cron["days"], of_month)).when(rule == "last", day == F.date_sub(last, n)).otherwise(day == F.date_add(aim, near))
    named = (of_week == cron["week_day"]) & F.when(cron["week_rule"] == "nth", F.ceil(of_month / 7) == cron["week_n"]).otherwise(F.date_add(day, 7) > last)
    in_week = F.when(cron["week_rule"] == "", F.array_contains(cron["weekdays"], of_week)).otherwise(named)
    return F.array_contains(cron["months"], F.month(day)) & in_month & in_week


def fires(rows: DataFrame, cron: Cron | str, zone: str | Column, after: str, days: int | Column) -> DataFrame:
    """Adds fire_time and local_time: every fire of each row after its UTC time ``after``, within so many days.

    cron is a parsed text, or the name of a column of parsed texts.
    """
    held = rows.withColumns({"_cron": constant(cron) if isinstance(cron, Cron) else F.col(cron), "_zone": F.lit(zone), "_days": F.lit(days).cast("int")})
    start = F.to_date(F.col(after))
    dated = held.select("*", F.explode(F.sequence(F.date_sub(start, 1), F.date_add(start, F.col("_days") + 1))).alias("_date")).where(day_matches(F.col("_cron"), F.col("_date")))
    at = ["_cron", "_zone", "_date"]
    # rows of one schedule share its dates, whose instants are worked out once: those from 3 hours before a date to 3 after that are on it
    quarters = dated.select(*at).distinct().withColumn("_midnight", F.to_utc_timestamp(F.col("_date").cast("timestamp_ntz"), F.col("_zone"))).select("*", F.explode(F.sequence(F.lit(-12), F.lit(107))).alias("_q"))
    local = quarters.withColumn("_utc", F.expr("timestampadd(MINUTE, 15 * _q, _midnight)")).withColumn("_local", F.from_utc_timestamp("_utc", F.col("_zone")).cast("timestamp_ntz"))
    local = local.where((F.to_date("_local") == F.col("_date")) & F.array_contains(F.col("_cron.hours"), F.hour("_local")))
    minute = F.explode(F.filter(F.col("_cron.minutes"), lambda m: (m >= F.minute("_local")) & (m < F.minute("_local") + 15)))
    ticks = local.select("*", minute.alias("_m")).select("*", F.explode("_cron.seconds").alias("_s"))
    add = F.expr("make_dt_interval(0, 0, _m - minute(_local), _s)")
    ticks = ticks.select(*at, (F.col("_utc") + add).cast("timestamp_ntz").alias("fire_time"), (F.col("_local") + add).alias("local_time"))
    limit = F.col(after) + F.expr("make_dt_interval(_days)")
    met = dated.join(ticks, at).where((F.col("fire_time") > F.col(after)) & (F.col("fire_time") <= limit))
    return met.select(*rows.columns, "fire_time", "local_time")


def next_fires(rows: DataFrame, text: str, zone: str, after: str, most: int) -> DataFrame:
    """Adds fire_time and local_time: at least the next ``most`` fires of each row after its UTC time ``after``, if it has so many.

    text and zone are columns. Fires are worked out once for each text, zone and day that ``after`` falls on: those of that day and ``most`` more. A text's
    horizon follows from the dates that it matches in a cycle of the calendar. What has too few fires there, because clock
    changes skip more than half of its dates, is looked up again over sixteen times the days, and what still has over three cycles. That ends the
    search: a zone's rules are regular from its last listed change on, within the first cycle, and a date that fires at all then
    does so 13 times a cycle (29 February on one weekday), so that two cycles hold 20 fires.
    """
    if not 1 <= most <= MOST:
        raise ValueError(f"from 1 to {MOST} fires can be asked for")
    dated = rows.withColumn("_start", F.date_trunc("DAY", F.col(after)).cast("timestamp_ntz"))
    keys = ["_start", text, zone]
    left = parsed(dated.where(F.col(after).isNotNull()).select(*keys).distinct(), text, most).where("cron.horizon > 0")
    later = F.col("fire_time") > F.col("_start") + F.expr("INTERVAL '1' DAY")
    rank = F.row_number().over(W.partitionBy(*keys, later).orderBy("fire_time"))
    found = None
    for horizon in (F.col("cron.horizon"), F.least(16 * F.col("cron.horizon"), F.lit(3 * CYCLE)), F.lit(3 * CYCLE)):
        every = fires(left, "cron", F.col(zone), "_start", horizon)
        enough = every.where(later).groupBy(*keys).count().where(F.col("count") >= most).select(*keys)
        # a fire at the start of the day itself is after no time of that day
        here = every.withColumn("_k", rank).where(~later | (F.col("_k") <= most)).select(*keys, "fire_time", "local_time")
        missing = left.join(enough, keys, "left_anti")
        if missing.isEmpty():
            found = here if found is None else found.unionByName(here)
            break
        done = here.join(enough, keys, "left_semi")
        found = done if found is None else found.unionByName(done)
        left = missing
    else:
        found = found.unionByName(here.join(enough, keys, "left_anti"))
    return dated.join(found, keys).where(F.col("fire_time") > F.col(after)).drop("_start")
