"""Answers other than a ranking: time hulls, catalogues, retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.clocks import CLOCKS, intervals


def hull(facts: DataFrame, clock: str, *keys: str) -> DataFrame:
    """(``keys``, start_at, end_at): from the earliest start to the latest end of the facts'
    intervals on a clock; without end if any of them is. No facts, no row."""
    spans = facts.select(*keys, F.explode(intervals(clock)).alias("i"))
    last = F.when(~F.bool_or(F.col("i.end_at").isNull()), F.max("i.end_at")).alias("end_at")
    return spans.groupBy(*keys).agg(F.min("i.start_at").alias("start_at"), last)


def _times(clock: str) -> list[Column]:
    """One different interval is itself; several make a hull in which an instant lasts a microsecond."""
    c = F.col(clock)
    one = F.count_distinct(c["start_at"], F.coalesce(c["end_at"], F.lit("9999-12-31 00:00:00").cast("timestamp"))) == 1
    end = F.when(c["end_at"] == c["start_at"], F.timestamp_micros(F.unix_micros(c["end_at"]) + 1)).otherwise(c["end_at"])
    whole = F.when(~F.bool_or(c["start_at"].isNotNull() & c["end_at"].isNull()), F.when(one, F.max(c["end_at"])).otherwise(F.max(end)))
    return [F.min(c["start_at"]).alias(f"{clock}_start"), whole.alias(f"{clock}_end")]


def catalogue(facts: DataFrame, edges: DataFrame | None, *keys: str) -> DataFrame:
    """(``keys``, facts, and start and end on each clock). With ``edges`` the keys may name its columns."""
    rows = facts if edges is None else facts.join(edges, ["graph_id", "fact_key"])
    base = rows.select(*keys, "graph_id" if "graph_id" not in keys else F.lit(0).alias("__g"), "fact_key", *(intervals(c).alias(c) for c in CLOCKS))
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("facts"))
    for clock in CLOCKS:
        times = base.select(*keys, F.explode(clock).alias(clock)).groupBy(*keys).agg(*_times(clock))
        counts = counts.join(times, list(keys), "left") if keys else counts.crossJoin(times)
    return counts


def listed(counts: DataFrame, group: Sequence[str], value: str, top: int) -> DataFrame:
    """The ``top`` values of each group by facts, ties by value; 0 keeps all."""
    w = Window.partitionBy(*group).orderBy(F.col("facts").desc(), value)
    ranked = counts.withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= top) if top > 0 else ranked


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, place: str, k: int) -> DataFrame:
    """(``query``, recall, precision_at_1, f1): of the first ``k`` of ``ranked`` (place from 1)
    against ``relevant``; repeats count once, a query without relevant items has no row."""
    top = ranked.where(F.col(place) <= k).groupBy(query, item).agg(F.min(place).alias("p"))
    rel = relevant.select(query, item).distinct().withColumn("r", F.lit(1))
    both = top.join(rel, [query, item], "full").groupBy(query)
    sums = both.agg(F.count("p").alias("got"), F.count("r").alias("want"), F.count(F.when(F.col("p").isNotNull(), F.col("r"))).alias("hit"), F.max(F.when(F.col("p") == 1, F.coalesce("r", F.lit(0)))).alias("first"))
    recall = F.col("hit") / F.col("want")
    f1 = F.coalesce(2 * F.col("hit") / (F.col("got") + F.col("want")), F.lit(0.0))
    return sums.where("want > 0").select(query, recall.alias("recall"), F.coalesce("first", F.lit(0)).cast("double").alias("precision_at_1"), f1.alias("f1"))


def macro_average(per_query: DataFrame, category: str, *metrics: str) -> DataFrame:
    """(``category``, queries, metrics): the mean over queries for each category and, in the row whose category is null, over all."""
    return per_query.rollup(category).agg(F.count(F.lit(1)).alias("queries"), *(F.avg(m).alias(m) for m in metrics))
