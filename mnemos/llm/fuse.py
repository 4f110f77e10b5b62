"""One ranking from several differently scaled scores.

Method: within each group (a query) and source, a score becomes its empirical
percentile, ties sharing the mean of their places, then goes through the
inverse normal distribution; items are ordered by the weighted mean. Only a
score's place counts, so no source's range decides.

A source that gave an item no usable score adds nothing. On the normal scale
"nothing" has to lie under every score that was given, so each value is taken
as its distance from half a place under the lowest, ``z(p) - z(1 / (2 (n + 1)))``
with ``p = place / (n + 1)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.operators.ordered import HOT_ROWS, SLICES, running
from mnemos.sources.tables import table

# Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x, coefficients: Sequence[float]):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of ``0 < p < 1`` (error below 1.2e-9); null for null."""
    tail = F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    outer = _poly(tail, _C) / _poly(tail, (*_D, 1.0))
    q = p - 0.5
    r = q * q
    inner = q * _poly(r, _A) / _poly(r, (*_B, 1.0))
    return F.when((p >= _LOW) & (p <= 1 - _LOW), inner).when(p < _LOW, outer).otherwise(-outer)


def fuse_scores(
    scores: DataFrame,
    group: str,
    item: str,
    source: str,
    score: str,
    weights: Mapping[str, float],
    hot_rows: int = HOT_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """(``group``, ``item``, ``fused``) for every item with a row in ``scores``.

    Defined cases: a null, NaN or infinite score is not usable; a source without
    a weight adds nothing; of several different scores one source gives one item
    the highest counts, repeated rows count once; rows with a null group or item
    are skipped; an item without any usable score has ``fused`` 0; a single score
    in its group and source stands in the middle. Empty in, empty out; further
    columns are ignored. Groups of any size: equal scores are counted before they
    are ordered, and groups above ``hot_rows`` different scores are ordered in slices.
    """
    total = float(sum(weights.values()))
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and not all zero")
    x = F.col(score).cast("double")
    known = F.col(source).isin(*weights) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = (
        scores.select(F.col(group).alias("__g"), F.col(item).alias("__i"), F.col(source).alias("__s"), F.when(known, x).alias("__x"))
        .where("__g is not null and __i is not null")
        .groupBy("__g", "__i", "__s")
        .agg(F.max("__x").alias("__x"))
    )
    usable = rows.where("__x is not null")
    places = running(usable.groupBy("__g", "__s", "__x").agg(F.count(F.lit(1)).alias("__n")), ["__g", "__s"], "__x", "__n", (), hot_rows, slices)
    size = usable.groupBy("__g", "__s").agg(F.count(F.lit(1)).alias("__all"))
    place = F.col("__sum") - (F.col("__n") - 1) / 2
    z = inverse_normal(place / (F.col("__all") + 1)) - inverse_normal(1 / (2 * (F.col("__all") + 1)))
    weight = F.create_map(*(F.lit(v) for k, w in weights.items() for v in (k, float(w) / total)))
    worth = places.join(size, ["__g", "__s"]).select("__g", "__s", "__x", (z * weight[F.col("__s")]).alias("__w"))
    return (
        rows.join(worth, ["__g", "__s", "__x"], "left")
        .groupBy("__g", "__i")
        .agg(F.coalesce(F.sum("__w"), F.lit(0.0)).alias("fused"))
        .select(F.col("__g").alias(group), F.col("__i").alias(item), "fused")
    )


WEIGHTS = {"text": 1.0, "vector": 1.0, "graph": 1.0}


def recall_ranking(contributions: DataFrame, hits: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, fact_key, score): the fused score times the hit's decay; a candidate without a decay keeps its score."""
    decay = hits.where("query_id is not null and fact_key is not null").groupBy("query_id", "fact_key").agg(F.max("decay").alias("decay"))
    fused = fuse_scores(contributions, "query_id", "fact_key", "source", "score", weights)
    return fused.join(decay, ["query_id", "fact_key"], "left").select("query_id", "fact_key", (F.col("fused") * F.coalesce("decay", F.lit(1.0))).alias("score"))


def leading(ranking: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The first ``k`` of each group with their ``place`` from 1, ties to the smaller item. Each task keeps ``k`` of a group before they are shuffled."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), item)
    return ranking.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    return recall_ranking(
        table(spark, folder, "contributions", "query_id", "fact_key", "source", "score"), table(spark, folder, "hits", "query_id", "fact_key", "decay")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return leading(_ranking(spark, folder), "query_id", "fact_key", "score", 3).select("query_id", "fact_key")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder).select("query_id", "fact_key", F.round("score", 6).alias("score"))


QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores}


def _sql_poly(x: str, coefficients: Sequence[float]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _sql_inverse(p: str) -> str:
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"({_sql_poly(tail, _C)} / {_sql_poly(tail, (*_D, 1.0))})"
    q = f"({p} - 0.5)"
    inner = f"({q} * {_sql_poly(f'({q} * {q})', _A)} / {_sql_poly(f'({q} * {q})', (*_B, 1.0))})"
    return f"case when {p} between {_LOW} and {1 - _LOW} then {inner} when {p} < {_LOW} then {outer} else -{outer} end"


_FUSED = f"""
given as (
  select query_id, fact_key, source, max(case when isnan(score) or isinf(score) then null else score end) as score
  from (select distinct * from contributions) group by all
),
placed as (
  select query_id, fact_key,
    (rank() over (partition by query_id, source order by score)
     + (count(*) over (partition by query_id, source, score) - 1) / 2.0)::double as place,
    (count(*) over (partition by query_id, source))::double as n
  from given where score is not null and source in ('text', 'vector', 'graph')
),
shares as (select *, place / (n + 1) as p, 1 / (2 * (n + 1)) as p0 from placed),
worth as (select query_id, fact_key, ({_sql_inverse('p')}) - ({_sql_inverse('p0')}) as z from shares),
fused as (
  select c.query_id, c.fact_key, coalesce(sum(z), 0) / 3 as fused
  from (select distinct query_id, fact_key from contributions) c left join worth w using (query_id, fact_key) group by all
),
ranking as (
  select f.query_id, f.fact_key, fused * coalesce(decay, 1) as score
  from fused f left join (select query_id, fact_key, max(decay) as decay from hits group by all) h using (query_id, fact_key)
)"""

ORACLE = {
    "p3_found": f"""with {_FUSED}
select query_id, fact_key from ranking
qualify row_number() over (partition by query_id order by score desc, fact_key) <= 3""",
    "p3_scores": f"with {_FUSED} select query_id, fact_key, round(score, 6) as score from ranking",
}
