"""Exact vector distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; null where the lengths differ or either is null."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    d = F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return F.when(F.size(a) == F.size(b), d)


def similarity(d: Column) -> Column:
    return 1 / (1 + d)


def in_box(v: Column, low: Column, high: Column) -> Column:
    """Whether a vector lies in the box, its faces included."""
    return (F.size(v) == F.size(low)) & F.forall(F.arrays_zip(v.alias("v"), low.alias("l"), high.alias("h")), lambda x: (x["v"] >= x["l"]) & (x["v"] <= x["h"]))


#: Questions up to which they are broadcast (64 numbers each: 25 MB); above, both sides are shuffled in slices.
BROADCAST_QUESTIONS = 50_000
SLICES = 64


def nearest_exact(queries: DataFrame, vectors: DataFrame, many: int = 0) -> DataFrame:
    """(query_id, graph_id, fact_key, distance): all vectors of a query's graph. ``queries``
    (query_id, graph_id, vector), about ``many``, is a stated set, taken to every row; vectors of
    other lengths are not near. A graph of any size is spread: many questions meet its rows in SLICES."""
    asked = queries.select("query_id", "graph_id", "vector")
    if many <= BROADCAST_QUESTIONS:
        rows = vectors.join(F.broadcast(asked), "graph_id")
    else:
        each = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
        rows = vectors.withColumn("__s", F.pmod(F.xxhash64("fact_key"), F.lit(SLICES)).cast("int"))
        rows = rows.join(asked.withColumn("__s", each), ["graph_id", "__s"])
    return rows.select("query_id", "graph_id", "fact_key", distance(F.col("embedding"), F.col("vector")).alias("distance")).where("distance is not null")
