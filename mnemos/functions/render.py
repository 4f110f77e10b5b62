"""Answers as lines of text."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, MONTH, YEAR = "yyyy-MM-dd", "yyyy-MM", "yyyy"


def span(start: Column, end: Column) -> Column:
    """A span in the widest calendar unit that both its ends are whole in: one unit, or the
    first and the last; an instant is its day, a span without end its first day and "..". Times are UTC."""
    whole = lambda u: (F.date_trunc(u, start) == start) & (F.date_trunc(u, end) == end)
    last = end - F.expr("interval 1 microsecond")

    def both(pattern: str) -> Column:
        a, b = F.date_format(start, pattern), F.date_format(last, pattern)
        return F.when(a == b, a).otherwise(F.concat(a, F.lit(".."), b))

    return (
        F.when(start.isNull(), F.lit(None).cast("string"))
        .when(end.isNull(), F.concat(F.date_format(start, DAY), F.lit("..")))
        .when(end <= start, F.date_format(start, DAY))
        .when(whole("year"), both(YEAR))
        .when(whole("month"), both(MONTH))
        .otherwise(both(DAY))
    )


def hit_line(value: str = "value", score: str = "score", written: str = "written_at", said: str = "said_at", occurred: str = "occurred") -> Column:
    """One line a hit: when it was said and, if that reads otherwise, when it happened; what it says; how relevant it is."""
    day = F.date_format(F.coalesce(said, written), DAY)
    happened = F.array_join(F.transform(F.col(occurred), lambda i: span(i["start_at"], i["end_at"])), " and ")
    apart = (F.size(occurred) > 0) & (happened != day)
    dates = F.when(apart, F.concat(F.lit("said "), day, F.lit(", happened "), happened)).otherwise(day)
    return F.format_string("- [%s] %s (relevance %.3f)", dates, F.col(value), F.col(score))


def span_text(start: datetime, end: datetime | None) -> str:
    """``span`` for values on the driver."""
    day = lambda t: t.strftime("%Y-%m-%d")
    if end is None:
        return f"{day(start)}.."
    if end <= start:
        return day(start)
    monthly = all(t == t.replace(day=1, hour=0, minute=0, second=0, microsecond=0) for t in (start, end))
    size = 10 if not monthly else 4 if start.month == end.month == 1 else 7
    first, last = day(start)[:size], day(end - timedelta(microseconds=1))[:size]
    return first if first == last else f"{first}..{last}"


def _count(n: int, noun: str) -> str:
    return f"{n} {noun}" + ("" if n == 1 else "s")


def _utc(t: datetime | None) -> datetime | None:
    return t if t is None else t.replace(tzinfo=t.tzinfo or timezone.utc)


def answer(a) -> str:
    """An ``Answer`` as text: the time of a when first, then hits or the catalogue, then warnings."""
    lines = [f"when: {span_text(a.span.start, a.span.end)}"] if a.span else []
    if a.catalogue is not None:
        lines += _catalogue(a)
    elif a.rows is not None:
        hits = [r["line"] for r in a.rows.select("place", hit_line().alias("line")).orderBy("place").collect()]
        lines += hits or ["Nothing that is stored matches."]
    elif a.empty_graph:
        lines.append("Nothing matches: this graph is empty so far.")
    return "\n".join(lines + [f"warning: {w}" for w in a.warnings])


def _catalogue(a) -> list[str]:
    c = a.catalogue
    about = f"describe recall@{c['graph']} {c['scope']}".rstrip()
    if not c["facts"]:
        return [f"{about}: no fact reached."]
    happened = lambda r: span_text(_utc(r["happened_start"]), _utc(r["happened_end"]))
    lines = [f"{about}: {_count(c['facts'], 'fact')} under {_count(c['anchors'], 'anchor')}, happened {happened(c)}"]
    rows = a.rows.orderBy("kind", "place").collect()
    for kind, name in (("topic", "topics"), ("entity", "entities")):
        mine = [r for r in rows if r["kind"] == kind]
        lines += [f"{name}:"] if mine else [f"{name}: none"]
        lines += [f"- [{happened(r)}] {r['anchor']}: {_count(r['facts'], 'fact')}" for r in mine]
    return lines
