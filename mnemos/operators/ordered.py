"""Ordered scans (running sums, next row) over keys that may hold most rows.

A window function puts each key into one task. Here a key with more than
``hot_rows`` rows is first cut along its order column at approximate
quantiles, so that a window works on (key, slice); what a row needs from the
other slices of its key comes from a summary of one row per slice. Keys that
are not hot have the single slice 0 and need no second step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SLICES = 256
SLICE = "__slice"


def sliced(df: DataFrame, keys: Sequence[str], at: str, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``df`` with ``__slice``: increasing in ``at`` within each key; equal ``at`` stay together.

    Keys must not be null. The quantiles are kept for hot keys only, of which
    there are at most rows / ``hot_rows``.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n")
    points = [i / slices for i in range(1, slices)]
    cuts = (
        df.join(hot, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(at, points, 20 * slices).alias("__cuts"))
    )
    below = F.size(F.filter("__cuts", lambda c: c < F.col(at)))
    return df.join(cuts, list(keys), "left").withColumn(SLICE, F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__cuts")


def running(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    total: str | None = None,
    following: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    slices: int = SLICES,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Adds ``__sum`` (running sum of ``total`` up to and with the row) and, for
    each column of ``following``, ``__next_<column>`` of the next row of the key.

    ``at``, with ``tie`` where it may repeat, must be unique within a key. ``df`` may already carry ``__slice``.
    """
    if SLICE not in df.columns:
        df = sliced(df, keys, at, hot_rows, slices)
    here = Window.partitionBy(*keys, SLICE).orderBy(at, *tie)
    over = Window.partitionBy(*keys).orderBy(SLICE)
    up_to = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    add: dict[str, Column] = {f"__next_{c}": F.lead(c).over(here) for c in following}
    if total:
        add["__sum"] = F.sum(total).over(up_to)
    summary = df.groupBy(*keys, SLICE).agg(
        (F.sum(total) if total else F.lit(0)).alias("__t"),
        *(F.min_by(c, F.struct(at, *tie) if tie else F.col(at)).alias(f"__f_{c}") for c in following),
    )
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    summary = summary.withColumns(
        {"__m": several, "__carry": F.coalesce(F.sum("__t").over(before), F.lit(0))}
        | {f"__g_{c}": F.lead(f"__f_{c}").over(over) for c in following}
    ).where("__m > 1")
    summary = summary.select(*keys, SLICE, "__carry", *(f"__g_{c}" for c in following))
    out = df.withColumns(add).join(summary, [*keys, SLICE], "left")
    fix = {f"__next_{c}": F.coalesce(f"__next_{c}", f"__g_{c}") for c in following}
    if total:
        fix["__sum"] = F.col("__sum") + F.coalesce("__carry", F.lit(0))
    return out.withColumns(fix).drop("__carry", *(f"__g_{c}" for c in following))
