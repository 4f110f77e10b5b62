"""Folding what was seen of a candidate into one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH_ROW = "struct<via_kind:string,via:string,score:double,degree:bigint,named:boolean>"


def folded(contributions: DataFrame, missed: DataFrame | None, rates: DataFrame | None) -> DataFrame:
    """(query_id, graph_id, fact_key, text, vector, mass, graph, held, rrf), one row per candidate.

    ``contributions``: query_id, graph_id, fact_key, source, score, list_rank, via_kind,
    via, degree, named, held. ``mass`` is text, anchors and the vector's similarity
    weighted by what the text missed; ``graph`` sums what each anchor holds beyond that
    mass and its fair share of the background, by its degree, never below zero.
    ``missed`` (query_id, missed) and ``rates`` (query_id, rate) count as 0 where they have no row or are None.
    """
    src = F.col("source")
    sums = contributions.groupBy("query_id", "graph_id", "fact_key").agg(
        *(F.coalesce(F.sum(F.when(src == s, F.col("score"))), F.lit(0.0)).alias(s) for s in ("text", "vector", "anchor")),
        F.coalesce(F.max(F.when(src == "text", F.col("held"))), F.lit(0.0)).alias("held"),
        F.sum(1 / (60 + F.col("list_rank"))).alias("rrf"),
        F.sort_array(F.collect_list(F.when(src == "graph", F.struct("via_kind", "via", "score", "degree", "named")))).alias("seen"),
    )
    rows = sums
    for name, extra in (("missed", missed), ("rate", rates)):
        rows = rows.withColumn(name, F.lit(0.0)) if extra is None else rows.join(extra.select("query_id", name), "query_id", "left")
    rows = rows.withColumn("mass", F.col("text") + (1 + F.coalesce("missed", F.lit(0.0))) * F.col("vector") + F.col("anchor"))
    rate, mass = F.coalesce("rate", F.lit(0.0)), F.col("mass")

    def surplus(total: Column, s: Column) -> Column:
        degree = F.greatest(s["degree"].cast("double"), F.lit(1.0))
        fair = F.when(s["named"], F.lit(0.0)).otherwise(degree * rate)
        return total + F.greatest((s["score"] - mass - fair) / degree, F.lit(0.0))

    return rows.select("query_id", "graph_id", "fact_key", "text", "vector", "mass", F.aggregate("seen", F.lit(0.0), surplus).alias("graph"), "held", "rrf")


def scored(pool: DataFrame, scorer: str = "information") -> DataFrame:
    """``pool`` (of ``folded``, restricted to what the search may return) with ``relevance``.

    information: each channel's value becomes its distance above the pool's mean in
    standard deviations, never below zero; text and vector multiply, the graph adds.
    A vector sighting beyond what chance gives the best of n counts with an exponent
    between 1 and 2, the more the less of the query the text holds. If no channel
    spreads the pool, relevance is the mass.
    """
    if scorer == "excess":
        return pool.withColumn("relevance", F.col("mass") + F.col("graph"))
    if scorer == "rrf":
        return pool.withColumn("relevance", F.col("rrf"))
    channels = ("text", "vector", "graph")
    stats = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in channels), *(F.stddev_pop(c).alias(f"s_{c}") for c in channels))

    def z(c: str) -> Column:
        above = F.greatest((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), F.lit(0.0))
        return F.when((F.col(c) > 0) & (F.col(f"s_{c}") > 0), above).otherwise(F.lit(0.0))

    zt, zv, zg = (z(c) for c in channels)
    trust = F.when(zv > F.sqrt(2 * F.log("n")), 2 - F.col("held")).otherwise(F.lit(1.0))
    flat = (F.col("s_text") <= 0) & (F.col("s_vector") <= 0) & (F.col("s_graph") <= 0)
    relevance = F.when(flat, F.col("mass")).otherwise((1 + zt) * F.pow(1 + zv, trust) + zg)
    return pool.join(stats, "query_id").withColumn("relevance", relevance).drop("n", *(f"{p}_{c}" for c in channels for p in "ms"))
