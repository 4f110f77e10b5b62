"""When the entities of the memory were active: hits and catalogue entries as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.operators.intervals import gaps, periods
from mnemos.sources.tables import table


def hit_intervals(hits: DataFrame, remembers: DataFrame) -> DataFrame:
    """(graph_id, entity, s, e) in microseconds, for every entity a hit's fact is filed under.

    Both sides are made distinct before they meet, so a fact that many recalls
    returned is joined once per different interval.
    """
    spans = (
        hits.select("graph_id", "fact_key", F.explode("occurred").alias("i"))
        .select("graph_id", "fact_key", F.unix_micros("i.start_at").alias("s"), F.unix_micros("i.end_at").alias("e"))
        .where("s is not null and (e is null or e >= s)")
        .distinct()
    )
    filed = remembers.select("graph_id", "fact_key", F.explode("entities").alias("entity")).where("entity is not null").distinct()
    return spans.join(filed, ["graph_id", "fact_key"]).select("graph_id", "entity", "s", "e")


def catalogue_intervals(entries: DataFrame) -> DataFrame:
    """(graph_id, entity, s, e) of the entity entries' ``happened``."""
    return entries.where("list_kind = 'entities' and value is not null").select(
        "graph_id", F.col("value").alias("entity"), F.unix_micros("happened.start_at").alias("s"), F.unix_micros("happened.end_at").alias("e")
    )


def entity_intervals(spark: SparkSession, folder: str) -> DataFrame:
    hit = hit_intervals(table(spark, folder, "hits"), table(spark, folder, "remembers"))
    cat = catalogue_intervals(table(spark, folder, "catalogue_entries"))
    return hit.withColumn("origin", F.lit("hit")).unionByName(cat.withColumn("origin", F.lit("catalogue")))


KEYS = ("origin", "graph_id", "entity")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = gaps(entity_intervals(spark, folder), KEYS, "s", "e", "gap_start_us", "gap_end_us")
    return found.select("origin", "graph_id", "entity", "gap_start_us", "gap_end_us")


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods(entity_intervals(spark, folder), KEYS, "s", "e", "period_start_us", "period_end_us")
    return found.select("origin", "graph_id", "entity", "period_start_us", "period_end_us")


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods}

_INTERVALS = """
spans as (
  select distinct 'hit' as origin, h.graph_id, f.entity, epoch_us(h.i.start_at) as s, epoch_us(h.i.end_at) as e
  from (select graph_id, fact_key, unnest(occurred) as i from hits) h
  join (select distinct graph_id, fact_key, unnest(entities) as entity from remembers) f
    on h.graph_id = f.graph_id and h.fact_key = f.fact_key
  union
  select 'catalogue', graph_id, value, epoch_us(happened.start_at), epoch_us(happened.end_at)
  from catalogue_entries where list_kind = 'entities'
),
ok as (
  select origin, graph_id, entity, s, coalesce(e, 9223372036854775807) as e
  from spans where entity is not null and s is not null and (e is null or e >= s)
),
reach as (
  select *, max(e) over (partition by origin, graph_id, entity order by s, e
                         rows between unbounded preceding and 1 preceding) as so_far
  from ok
)"""

ORACLE = {
    "p1_found": f"""with {_INTERVALS}
select origin, graph_id, entity, so_far as gap_start_us, s as gap_end_us from reach where so_far < s""",
    "p1_periods": f"""with {_INTERVALS},
numbered as (
  select *, sum(case when so_far is null or so_far < s then 1 else 0 end)
            over (partition by origin, graph_id, entity order by s, e rows unbounded preceding) as n
  from reach
)
select origin, graph_id, entity, min(s) as period_start_us, nullif(max(e), 9223372036854775807) as period_end_us
from numbered group by origin, graph_id, entity, n""",
}
