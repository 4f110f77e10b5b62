"""Connected components of links, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.session import cut, drop_cut


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of its component for every id of a link.

    Alternates large-star and small-star steps: every id is linked to the smallest
    of its neighbours until nothing changes, which takes about log(n) rounds. Each
    round is two aggregations; a hub is spread over the tasks by Spark's partial
    aggregation and never gathered into a list. Lineage is cut to the shared folder.

    Defined cases: nulls on either end are skipped, a link of an id with itself
    makes a component of its own, repeated links change nothing.
    """
    spark = links.sparkSession
    kept = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = kept.where("a = b").select(F.col("a").alias("id"))
    edges = cut(kept.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    first, known = edges, _sum(edges)
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours larger than the node go to the node's smallest
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours and the node go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = _sum(after)
        same, known = now == known, now
        if edges is not first:
            drop_cut(spark, edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    member = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    lone = alone.select("id", F.col("id").alias("component")).distinct()
    return member.unionAll(roots).unionAll(lone).groupBy("id").agg(F.min("component").alias("component"))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
