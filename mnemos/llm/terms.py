"""How distinctive a term is for its record.

Method: graph of words. Terms of a record that stand within a window of each
other are joined by an edge; a term's weight is the number of its different
neighbours (not its frequency) times its rarity in the whole collection,
``ln(records / records with the term)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.sources.tables import table

#: A term's neighbours are the terms up to WINDOW - 1 places away.
WINDOW = 3


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _degrees(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Nodes of the graphs of one batch: all records at once, without a loop over them."""
    tokens = batch.column(batch.num_columns - 1)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths)
    coded = tokens.flatten().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = max(1, len(coded.dictionary))
    node, at, tf = np.unique(row * many + term, return_inverse=True, return_counts=True)
    edges = []
    for k in range(1, window):
        a, b = at[:-k], at[k:]
        ok = (row[:-k] == row[k:]) & (a != b)
        edges += [a[ok] * len(node) + b[ok], b[ok] * len(node) + a[ok]]
    linked = np.unique(np.concatenate(edges)) // max(1, len(node)) if edges else np.empty(0, np.int64)
    degree = np.bincount(linked, minlength=len(node)).astype(np.int64)
    ids = [batch.column(i).take(pa.array(node // many)) for i in range(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*ids, coded.dictionary.take(pa.array(node % many)), pa.array(degree), pa.array(tf.astype(np.int64))], [f"c{i}" for i in range(len(ids) + 3)])


def graph_of_words(records: DataFrame, ids: Sequence[str], text: str, window: int = WINDOW) -> DataFrame:
    """(``ids``, term, degree, tf), one row per record and different term; no shuffle.

    Defined cases: a null, empty or wordless text has no rows; a term that is its
    own neighbour gains nothing by that; a text of one different term has degree 0;
    texts of any length are taken whole. Records must be unique by ``ids``.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    picked = records.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(ids)), words(F.col(text)).alias("__w"))
    schema = T.StructType(
        [T.StructField(c, picked.schema[f"__k{i}"].dataType) for i, c in enumerate(ids)]
        + [T.StructField("term", T.StringType()), T.StructField("degree", T.LongType()), T.StructField("tf", T.LongType())]
    )
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _degrees(b, window).rename_columns(names)

    return picked.mapInArrow(run, schema)


def document_frequency(postings: DataFrame, record: Sequence[str], term: str, tf: str) -> DataFrame:
    """(term, df): in how many records a term lives. Rows with tf 0 or null and repeated rows don't count."""
    live = postings.where((F.col(tf) > 0) & F.col(term).isNotNull()).select(F.col(term).alias("term"), *record).distinct()
    return live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def distinctiveness(records: DataFrame, ids: Sequence[str], text: str, df: DataFrame, total: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``ids``, term, degree, tf, df, score). ``df``: (term, df); ``total``: one row, ``n`` records.

    A term the collection doesn't hold counts as held by one record; in an empty
    collection every score is 0. Common terms may hold a large part of the rows:
    the join on the term is an ordinary one, which adaptive execution splits.
    """
    n = F.greatest(F.col("n"), F.lit(1))
    seen = F.least(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)), n)
    nodes = graph_of_words(records, ids, text, window)
    joined = nodes.join(df.select("term", "df"), "term", "left").crossJoin(F.broadcast(total.select("n").limit(1)))
    return joined.select(*ids, "term", "degree", "tf", seen.alias("df"), (F.col("degree") * F.log(n / seen)).alias("score"))


def most_distinctive(scored: DataFrame, ids: Sequence[str], k: int = 1) -> DataFrame:
    """The ``k`` terms of highest score of each record; ties to the term that comes first."""
    w = Window.partitionBy(*ids).orderBy(F.col("score").desc(), "term")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _facts(spark: SparkSession, folder: str, topic: str | None = None) -> DataFrame:
    """One row per fact. A fact's key stands for its value, so any row of it has its text."""
    rows = table(spark, folder, "remembers", "graph_id", "fact_key", "value", "topics").where("value is not null")
    if topic:
        rows = rows.where(F.array_contains("topics", topic))
    return rows.groupBy("graph_id", "fact_key").agg(F.max("value").alias("value"))


def _scores(spark: SparkSession, folder: str, topic: str | None = None) -> DataFrame:
    postings = table(spark, folder, "postings", "graph_id", "fact_key", "term", "tf")
    df = document_frequency(postings, ["graph_id", "fact_key"], "term", "tf")
    total = postings.where("tf > 0").select("graph_id", "fact_key").distinct().agg(F.count(F.lit(1)).alias("n"))
    return distinctiveness(_facts(spark, folder, topic), ["graph_id", "fact_key"], "value", df, total)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_distinctive(_scores(spark, folder, "field-notes"), ["graph_id", "fact_key"]).select("fact_key", "term")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select("graph_id", "fact_key", "term", "degree", "df", F.round("score", 6).alias("score"))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores}


def _sql(where: str) -> str:
    return f"""
live as (select distinct term, graph_id, fact_key from postings where tf > 0),
dfs as (select term, count(*) as df from live group by term),
total as (select count(*) as n from (select distinct graph_id, fact_key from live)),
facts as (select graph_id, fact_key, max(value) as value from remembers where value is not null {where} group by all),
lists as (select graph_id, fact_key, regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+') as w from facts),
tokens as (select graph_id, fact_key, unnest(w) as term, unnest(range(len(w))) as pos from lists),
nodes as (select distinct graph_id, fact_key, term from tokens),
edges as (
  select distinct a.graph_id, a.fact_key, a.term, b.term as other
  from tokens a join tokens b on a.graph_id = b.graph_id and a.fact_key = b.fact_key and a.term <> b.term and abs(a.pos - b.pos) < {WINDOW}
),
degrees as (select graph_id, fact_key, term, count(other) as degree from nodes left join edges using (graph_id, fact_key, term) group by all),
scored as (
  select graph_id, fact_key, term, degree, coalesce(df, 1) as df, degree * ln(n / coalesce(df, 1)) as score
  from degrees left join dfs using (term) cross join total
)"""


ORACLE = {
    "p4_found": f"""with {_sql("and list_contains(topics, 'field-notes')")}
select fact_key, term from scored qualify row_number() over (partition by graph_id, fact_key order by score desc, term) = 1""",
    "p4_scores": f"with {_sql('')} select graph_id, fact_key, term, degree, df, round(score, 6) as score from scored",
}
