"""Continuous periods of overlapping intervals and the gaps between them.

Method: a sweep line. Every interval becomes a +1 event at its start and a -1
event at its end; events of one key and instant are summed before they are
shuffled to their order; a running sum gives the number of open intervals, and
wherever it falls to zero a period ends and a gap begins. Hot keys are cut
along time (see ``ordered``), so no key has to fit one task.

Defined cases, for all functions here:

* a null key, a null start, or an end before the start: the row is skipped;
* a null end: the interval never ends, nothing follows its period;
* equal ends: an instant, a period of its own unless an interval covers or
  touches it;
* intervals that touch form one period; repeated rows change nothing;
* an empty input gives an empty result; columns not named are ignored.

``start`` and ``end`` are integers or any type with an order that is the same
for both, such as timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators.ordered import HOT_ROWS, SLICES, running


def _checked(keys: Sequence[str], *out: str) -> None:
    if clash := {*keys} & {*out}:
        raise ValueError(f"a key has the name of a result column: {', '.join(sorted(clash))}")


def sweep(df: DataFrame, keys: Sequence[str], start: str, end: str, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """One row per key and instant at which an interval starts or ends: the keys
    as ``__k0..``, ``__t``, ``__net``, ``__sum`` (open intervals from then on) and
    ``__next___t`` (the key's next instant)."""
    ks = [f"__k{i}" for i in range(len(keys))]
    s, e = F.col(start), F.col(end)
    ok = s.isNotNull() & (e.isNull() | (e >= s))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    both = F.array(F.struct(s.alias("t"), F.lit(1).alias("d")), F.struct(e.alias("t"), F.lit(-1).alias("d")))
    events = (
        df.where(ok)
        .select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), F.explode(both).alias("__e"))
        .select(*ks, F.col("__e.t").alias("__t"), F.col("__e.d").alias("__d"))
        .where("__t is not null")
        .groupBy(*ks, "__t")
        .agg(F.sum("__d").alias("__net"))
    )
    return running(events, ks, "__t", "__net", ["__t"], hot_rows, slices)


def gaps(
    df: DataFrame, keys: Sequence[str], start: str, end: str, gap_start: str = "gap_start", gap_end: str = "gap_end", hot_rows: int = HOT_ROWS, slices: int = SLICES
) -> DataFrame:
    """The keys, ``gap_start`` and ``gap_end``: one row per gap between two periods of a key."""
    _checked(keys, gap_start, gap_end)
    at = sweep(df, keys, start, end, hot_rows, slices)
    return at.where("__sum = 0 and __next___t is not null").select(
        *(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), F.col("__t").alias(gap_start), F.col("__next___t").alias(gap_end)
    )


def periods(
    df: DataFrame, keys: Sequence[str], start: str, end: str, period_start: str = "period_start", period_end: str = "period_end", hot_rows: int = HOT_ROWS, slices: int = SLICES
) -> DataFrame:
    """The keys, ``period_start`` and ``period_end`` (null: without end), one row per continuous period."""
    _checked(keys, period_start, period_end)
    ks = [f"__k{i}" for i in range(len(keys))]
    marks = (
        sweep(df, keys, start, end, hot_rows, slices)
        .select(*ks, "__slice", "__t", (F.col("__sum") == 0).alias("__ends"), (F.col("__sum") == F.col("__net")).alias("__starts"))
        .where("__ends or __starts")
    )
    nxt = running(marks, ks, "__t", None, ["__t"], hot_rows, slices)
    return nxt.where("__starts").select(
        *(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)),
        F.col("__t").alias(period_start),
        F.when(F.col("__ends"), F.col("__t")).otherwise(F.col("__next___t")).alias(period_end),
    )
