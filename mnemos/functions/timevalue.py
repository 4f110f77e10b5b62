"""Time literals of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_LONGEST_NS = 2**63 - 1
_DURATION = re.compile(r"(\d+)([smhdw])$")
_DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?)?)?)?$")


class TimeError(ValueError):
    pass


@dataclass(frozen=True)
class Interval:
    """Half open; equal ends are an instant, no end is open."""

    start: datetime
    end: datetime | None

    def overlaps(self, since: datetime | None, until: datetime | None) -> bool:
        lower = since is None or self.end is None or (since <= self.start if self.end == self.start else since < self.end)
        return lower and (until is None or self.start < until)


@dataclass(frozen=True)
class Duration:
    seconds: int
    text: str

    def resolve(self, now: datetime) -> Interval:
        at = now - timedelta(seconds=self.seconds)
        return Interval(at, at)


@dataclass(frozen=True)
class Date:
    start: datetime
    end: datetime
    text: str

    def resolve(self, now: datetime) -> Interval:
        return Interval(self.start, self.end)


@dataclass(frozen=True)
class Range:
    first: Date
    last: Date | None

    def resolve(self, now: datetime) -> Interval:
        return Interval(self.first.start, self.last.end if self.last else None)


def parse_duration(text: str) -> Duration:
    m = _DURATION.match(text)
    if not m:
        raise TimeError(f"not a duration: {text!r}")
    seconds = int(m[1]) * UNITS[m[2]]
    if seconds * 10**9 > _LONGEST_NS:
        raise TimeError(f"out of range (at most {_LONGEST_NS // 10**9 // UNITS[m[2]]}{m[2]})")
    return Duration(seconds, text)


def parse_date(text: str) -> Date:
    """A day, a month, a year or an instant; without an offset it is in UTC."""
    m = _DATE.match(text)
    if not m:
        raise TimeError(f"not a date: {text!r}")
    year, month, day, hh, mm, ss, frac, zone = m.groups()
    try:
        start = datetime(int(year), int(month or 1), int(day or 1), int(hh or 0), int(mm or 0), int(ss or 0), int(((frac or "") + "000000")[:6]), timezone.utc)
        if hh is None:
            if day:
                end = start + timedelta(days=1)
            elif month:
                end = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
            else:
                end = start.replace(year=start.year + 1)
            return Date(start, end, text)
        if zone and zone != "Z":
            hours, minutes = int(zone[1:3]), int(zone[4:])
            if hours > 23 or minutes > 59:
                raise TimeError("an offset is under 24 hours")
            start -= timedelta(hours=hours, minutes=minutes) * (1 if zone[0] == "+" else -1)
        return Date(start, start, text)
    except (ValueError, OverflowError) as e:
        raise TimeError(str(e)) from e
