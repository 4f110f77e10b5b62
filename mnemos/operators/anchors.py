"""Facts and the anchors they are filed under."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.model import unsigned

ANCHOR = ["graph_id", "kind", "anchor"]


def sequence(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kind, anchor, fact_key, before, after): each fact between its
    neighbours in the anchor's order, by the time written and then the key.

    A window per anchor would put an anchor that files half of all facts into one
    task, so the running number is found in slices of it (see ``ordered``)."""
    from mnemos.operators.ordered import running

    rows = edges.join(facts.select("graph_id", "fact_key", "written_at"), ["graph_id", "fact_key"])
    # several facts may be written at one instant: those are put in order first, then the instants
    tie = Window.partitionBy(*ANCHOR, "at").orderBy("u")
    rows = rows.select(*ANCHOR, "fact_key", F.unix_micros("written_at").alias("at"), unsigned("fact_key").alias("u"))
    rows = rows.withColumns({"p": F.lag("fact_key").over(tie), "n": F.lead("fact_key").over(tie)})
    instants = rows.groupBy(*ANCHOR, "at").agg(F.min_by("fact_key", "u").alias("first"), F.max_by("fact_key", "u").alias("last"))
    ahead = running(instants, ANCHOR, "at", None, ["first", "at"]).select(*ANCHOR, "at", "last", F.col("__next_first").alias("next_first"), F.col("__next_at").alias("next_at"))
    behind = ahead.where("next_at is not null").select(*ANCHOR, F.col("next_at").alias("at"), F.col("last").alias("prev_last"))
    out = rows.join(ahead, [*ANCHOR, "at"], "left").join(behind, [*ANCHOR, "at"], "left")
    return out.select(*ANCHOR, "fact_key", F.coalesce("p", "prev_last").alias("before"), F.coalesce("n", "next_first").alias("after"))


def linked(seq: DataFrame) -> DataFrame:
    """(graph_id, fact_key, neighbour) of a sequence, once for each anchor."""
    return seq.select("graph_id", "fact_key", F.explode(F.array("before", "after")).alias("neighbour")).where("neighbour is not null")


def neighbours(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, fact_key, neighbour): the facts next to a fact under any of its anchors, each once."""
    return linked(sequence(facts, edges)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, kind, anchor, degree): of the whole graph, whatever a search is bounded by."""
    return edges.groupBy(*ANCHOR).agg(F.count(F.lit(1)).alias("degree"))


def named_anchors(named: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, graph_id, kind, anchor, degree) of named anchors that exist."""
    return named.distinct().join(degrees(edges), ANCHOR).select("query_id", *ANCHOR, "degree")


def observe(seeds: DataFrame, edges: DataFrame, traversal: str = "excess") -> DataFrame:
    """First pass: (query_id, graph_id, kind, anchor, mass, seeds, degree) of every anchor
    that files a seed. ``seeds``: (query_id, graph_id, fact_key, mass). The breadth-first
    variant lets the seed with the lowest key fund an anchor alone."""
    reached = seeds.join(edges, ["graph_id", "fact_key"])
    if traversal == "bfs":
        mass, count = F.min_by("mass", unsigned("fact_key")), F.lit(1).cast("bigint")
    else:
        mass, count = F.sum("mass"), F.count(F.lit(1))
    sums = reached.groupBy("query_id", *ANCHOR).agg(mass.alias("mass"), count.alias("seeds"))
    touched = reached.select(*ANCHOR).distinct()
    return sums.join(degrees(edges.join(touched, ANCHOR, "left_semi")), ANCHOR)


def background(observed: DataFrame) -> DataFrame:
    """(query_id, total_mass, total_degree, rate): over all anchors reached, silent ones included."""
    sums = observed.groupBy("query_id").agg(F.sum("mass").alias("total_mass"), F.sum("degree").alias("total_degree"))
    return sums.withColumn("rate", F.col("total_mass") / F.col("total_degree"))


def transmitting(observed: DataFrame, rates: DataFrame, named: DataFrame, depth: DataFrame) -> DataFrame:
    """Second look: the anchors that pass their mass on, those named and those that hold
    more than the background would give them (twice as much at depth 1). ``named``:
    (query_id, graph_id, kind, anchor); ``depth``: (query_id, depth)."""
    marked = observed.join(named.select("query_id", *ANCHOR, F.lit(True).alias("named")).distinct(), ["query_id", *ANCHOR], "left")
    all_of = marked.join(rates, "query_id").join(F.broadcast(depth), "query_id")
    is_named = F.coalesce("named", F.lit(False))
    fair = F.col("degree") * F.col("total_mass") * F.when(F.col("depth") == 1, 2.0).otherwise(1.0)
    more = F.col("mass") * F.col("total_degree") > fair * (1 + 1e-12)  # equal shares stay silent whatever order they were added in
    return all_of.where(is_named | more).select("query_id", *ANCHOR, "mass", "seeds", "degree", "rate", is_named.alias("named"))


def expand(open_anchors: DataFrame, edges: DataFrame, traversal: str = "excess") -> DataFrame:
    """What each fact under a transmitting anchor sees of it: (query_id, graph_id, fact_key, mass, via, via_kind, degree, seeds, named)."""
    seen = open_anchors.join(edges, ANCHOR)
    if traversal == "bfs":
        w = Window.partitionBy("query_id", "graph_id", "fact_key").orderBy("kind", "anchor")
        seen = seen.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return seen.select("query_id", "graph_id", "fact_key", "mass", F.col("anchor").alias("via"), F.col("kind").alias("via_kind"), "degree", "seeds", "named")
