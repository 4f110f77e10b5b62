"""Statements of the query language from Python values, quoted where they need it."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from mnemos.functions.timevalue import Interval
from mnemos.plans.language import CLOCKS, RESERVED, quote


class BuildError(ValueError):
    """A value that no statement can carry."""


@dataclass(frozen=True, init=False)
class When:
    """A time bound read from the facts a search finds: ``since`` what they hold is over, or
    ``until`` it begins, on a ``clock``. It searches the graph of its recall; a ``top`` above one spans so many of its hits."""

    keywords: tuple[str, ...]
    clock: str | None
    query: str | None
    topics: tuple[str, ...]
    entities: tuple[str, ...]
    top: int | None
    depth: int | None

    def __init__(self, *keywords: str, clock: str | None = None, query: str | None = None, topics: Sequence[str] = (), entities: Sequence[str] = (), top: int | None = None, depth: int | None = None) -> None:
        if clock is not None and clock not in CLOCKS:
            raise BuildError(f"no clock {clock!r}: one of {', '.join(CLOCKS)}")
        for name, value in (("keywords", keywords), ("clock", clock), ("query", query), ("topics", _several("topics", topics)), ("entities", _several("entities", entities)), ("top", top), ("depth", depth)):
            object.__setattr__(self, name, value)


def _several(name: str, values) -> tuple[str, ...]:
    if isinstance(values, (str, date, Interval)):
        raise BuildError(f"{name} takes a sequence, not the single value {values!r}")
    return tuple(values or ())


def _word(name: str, value: str, reserved: bool = False) -> str:
    """Bare if the language reads it as one word, else quoted."""
    value = value.strip()
    if not value:
        raise BuildError(f"an empty {name}")
    plain = all(c.isalpha() or c.isdecimal() for c in value)
    if reserved and value.lower() in RESERVED:
        warnings.warn(f"{value!r} is a word of the query language and was quoted to search for it", stacklevel=4)
        plain = False
    return value if plain else quote(value)


def _phrase(name: str, value: str) -> str:
    if not value.strip():
        raise BuildError(f"an empty {name}")
    return quote(value)


def _time(name: str, value) -> str:
    """A day for a date, an instant for a datetime (UTC where it names no zone), or a literal of the language as it is."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return quote(value.isoformat().replace("+00:00", "Z"))
    if isinstance(value, date):
        return quote(value.isoformat())
    if isinstance(value, str) and value.strip():
        if value.startswith("(") or value[:-1].isdigit():
            return value
        first, dots, last = value.partition("..")
        return quote(first) + dots + (quote(last) if last else "")
    raise BuildError(f"{name}: {value!r} is no date or datetime")


def _span(value) -> str:
    if isinstance(value, Interval):
        return _time("occurred", value.start) + (f"..{_time('occurred', value.end)}" if value.end else "..")
    return _time("occurred", value)


def _verb(name: str, graph: int) -> str:
    if not 0 <= graph <= 255:
        raise BuildError(f"graph {graph} is not between 0 and 255")
    return f"{name}@{graph}"


def _seeds(keywords, query, topics, entities, top, depth) -> list[str]:
    if top is not None and top < 1 or depth is not None and depth < 0:
        raise BuildError(f"top {top} must be positive and depth {depth} not negative")
    parts = [_phrase("query", query)] if query is not None else []
    parts += [_word("keyword", k, reserved=True) for k in _several("keywords", keywords)]
    parts += [f"topic:{_word('topic', t)}" for t in _several("topics", topics)] + [f"entity:{_word('entity', e)}" for e in _several("entities", entities)]
    return parts + [f"{k}:{v}" for k, v in (("top", top), ("depth", depth)) if v is not None]


def build_when(when: When, since=None, until=None, with_vector: bool = False, vector: str = "v") -> str:
    """A when by itself, as the language runs it; inside a bound it has no bounds of its own."""
    parts = _seeds(when.keywords, when.query, when.topics, when.entities, when.top, when.depth)
    parts += [f"{k}:{_time(k, v)}" for k, v in (("since", since), ("until", until)) if v is not None]
    parts += [f"vec:${vector}"] if with_vector else []
    if not parts:
        raise BuildError("a when needs a seed")
    return " ".join(["when" + (f":{when.clock}" if when.clock else ""), *parts])


def _bound(name: str, value, with_vector: bool) -> str:
    if isinstance(value, When):
        return f"{name}:({build_when(value, with_vector=with_vector, vector=f'v{name}')})"
    if with_vector:
        raise BuildError(f"{name} is a time and takes no vector")
    return f"{name}:{_time(name, value)}"


def _recall(keywords, graph, query, topics, entities, top, depth, since, until, with_vector, with_since_vector, with_until_vector) -> list[str]:
    parts = [_verb("recall", graph), *_seeds(keywords, query, topics, entities, top, depth)]
    parts += [_bound(k, v, w) for k, v, w in (("since", since, with_since_vector), ("until", until, with_until_vector)) if v is not None]
    return [*parts, "vec:$v"] if with_vector else parts


def build_remember(value: str, *, graph: int = 0, topics: Sequence[str] = (), entities: Sequence[str] = (), said=None, occurred: Sequence = (), with_vector: bool = False) -> str:
    """``said`` a date or datetime, ``occurred`` a sequence of dates, datetimes or ``Interval``s; ``with_vector`` leaves a place for the parameter v."""
    parts = [_verb("remember", graph), _phrase("fact", value)]
    parts += [f"topic:{_word('topic', t)}" for t in _several("topics", topics)] + [f"entity:{_word('entity', e)}" for e in _several("entities", entities)]
    parts += [f"said:{_time('said', said)}"] if said else []
    parts += [f"occurred:{_span(o)}" for o in _several("occurred", occurred)]
    return " ".join([*parts, "vec:$v"] if with_vector else parts)


def build_recall(
    keywords: Sequence[str] = (), *, graph: int = 0, query: str | None = None, topics: Sequence[str] = (), entities: Sequence[str] = (), top: int | None = None, depth: int | None = None,
    since=None, until=None, with_vector: bool = False, with_since_vector: bool = False, with_until_vector: bool = False, explain: bool = False,
) -> str:
    """``query`` is a whole question and goes as one phrase, ``keywords`` as words; ``since``
    and ``until`` are dates, datetimes or ``When``s, whose vectors are the parameters vsince and vuntil."""
    parts = _recall(keywords, graph, query, topics, entities, top, depth, since, until, with_vector, with_since_vector, with_until_vector)
    if len(parts) == 1:
        raise BuildError("a recall needs a seed: keywords, a query, a vector or an anchor")
    return " ".join(["explain", *parts] if explain else parts)


def build_describe(
    keywords: Sequence[str] = (), *, graph: int = 0, query: str | None = None, topics: Sequence[str] = (), entities: Sequence[str] = (), top: int | None = None, depth: int | None = None,
    since=None, until=None, with_vector: bool = False, with_since_vector: bool = False, with_until_vector: bool = False,
) -> str:
    """The recall it describes, which needs no seed here."""
    return " ".join(["describe", *_recall(keywords, graph, query, topics, entities, top, depth, since, until, with_vector, with_since_vector, with_until_vector)])
