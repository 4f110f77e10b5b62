"""The three clocks of a fact, and what lies in a window on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCKS = ("happened", "said", "written")
INTERVALS = "array<struct<start_at:timestamp,end_at:timestamp>>"


def intervals(clock: str, written: str = "written_at", said: str = "said_at", occurred: str = "occurred") -> Column:
    """A fact's intervals on a clock: it was said when written unless it says otherwise,
    and happened when said unless it occurred at times of its own. Intervals without a
    start or turned round are not times."""
    if clock not in CLOCKS:
        raise ValueError(f"no clock {clock!r}")
    at = F.col(written) if clock == "written" else F.coalesce(F.col(said), F.col(written))
    moment = F.array(F.struct(at.alias("start_at"), at.alias("end_at"))).cast(INTERVALS)
    if clock != "happened":
        return moment
    good = F.filter(F.col(occurred), lambda i: i["start_at"].isNotNull() & (i["end_at"].isNull() | (i["end_at"] >= i["start_at"])))
    return F.when(F.size(good) > 0, good.cast(INTERVALS)).otherwise(moment)


def reaches_since(i: Column, since: Column) -> Column:
    s, e = i["start_at"], i["end_at"]
    return since.isNull() | e.isNull() | ((e == s) & (since <= s)) | ((e > s) & (since < e))


def starts_before(i: Column, until: Column) -> Column:
    return until.isNull() | (i["start_at"] < until)


def in_window(since: Column, until: Column, since_clock: str = "happened", until_clock: str = "happened", **columns: str) -> Column:
    """Whether a fact lies in the window. On one clock a single interval has to meet
    both bounds; on two clocks each bound is met on its own."""
    if since_clock == until_clock:
        return F.exists(intervals(since_clock, **columns), lambda i: reaches_since(i, since) & starts_before(i, until))
    a = F.exists(intervals(since_clock, **columns), lambda i: reaches_since(i, since))
    return a & F.exists(intervals(until_clock, **columns), lambda i: starts_before(i, until))


def last_start(column: Column) -> Column:
    """The latest start among intervals."""
    return F.array_max(F.transform(column, lambda i: i["start_at"]))


def decayed(score: Column, written: Column, now: Column, half_life_s: float) -> Column:
    """``score`` halved for every half-life since ``written``; a time to come doesn't raise it, and a half-life of 0 or less is off."""
    if half_life_s <= 0:
        return score
    age = (F.unix_micros(now) - F.unix_micros(written)) / 1e6
    return score * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life_s)
