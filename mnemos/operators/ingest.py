"""From a log of remember inputs to the tables of a memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.operators.anchors import neighbours
from mnemos.operators.textindex import lengths, postings, tokens
from mnemos.model import Memory


def latest(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """One whole row per key, the newest: an upsert. Each task keeps one row of a key before they are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in newest))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def facts_of(log: DataFrame) -> DataFrame:
    """Facts: remembering one again replaces its times, absent ones included."""
    rows = log.select("graph_id", "fact_key", "value", "written_at", "said_at", "occurred", "remember_id").where("fact_key is not null and value is not null")
    return latest(rows, ["graph_id", "fact_key"], F.col("written_at"), F.col("remember_id")).drop("remember_id")


def edges_of(log: DataFrame) -> DataFrame:
    """Edges to topics and entities: they accumulate over every remember of a fact. Anchor values are lower-cased, blanks name nothing."""
    both = F.array(
        F.struct(F.lit("topic").alias("kind"), F.col("topics").alias("anchors")), F.struct(F.lit("entity").alias("kind"), F.col("entities").alias("anchors"))
    )
    rows = log.where("fact_key is not null").select("graph_id", "fact_key", F.explode(both).alias("b")).select("graph_id", "fact_key", "b.kind", F.explode("b.anchors").alias("anchor"))
    return rows.select("graph_id", "fact_key", "kind", F.lower("anchor").alias("anchor")).where("trim(anchor) <> ''").distinct()


def anchors_of(edges: DataFrame) -> DataFrame:
    """(graph_id, kind, anchor, degree)."""
    return edges.groupBy("graph_id", "kind", "anchor").agg(F.count(F.lit(1)).alias("degree"))


def memory_of(log: DataFrame, vectors: DataFrame | None = None, stemming: bool = True) -> Memory:
    facts, edges = facts_of(log), edges_of(log)
    words = tokens(facts, stemming)
    return Memory(facts, edges, postings(words), lengths(words), neighbours(facts, edges), vectors)


def stats(memory: Memory, num_graphs: int) -> DataFrame:
    """(graph_id, facts, anchors, edges, vectors) for every graph there may be, empty ones included."""
    spark = memory.facts.sparkSession
    zero = F.lit(0).cast("bigint")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).select("graph_id", *((F.col("n") if c == name else zero).alias(c) for c in ("facts", "anchors", "edges", "vectors")))

    parts = [count(memory.facts, "facts"), count(anchors_of(memory.edges), "anchors"), count(memory.edges, "edges")]
    if memory.vectors is not None:
        parts.append(count(memory.vectors, "vectors"))
    every = spark.range(num_graphs).select(F.col("id").cast("smallint").alias("graph_id"), *(zero.alias(c) for c in ("facts", "anchors", "edges", "vectors")))
    for p in parts:
        every = every.unionByName(p)
    sums = every.groupBy("graph_id").agg(*(F.sum(c).alias(c) for c in ("facts", "anchors", "edges", "vectors")))
    return sums.where(F.col("graph_id") < num_graphs)


def sizes(memory: Memory, num_graphs: int, relevance: str = "bm25") -> DataFrame:
    """(graph_id, order, size, nodes, vectors, forest_entries, relevance): facts and anchors, edges,
    all of them together; vectors are stored without garbage, so entries are vectors."""
    rows = stats(memory, num_graphs)
    order = F.col("facts") + F.col("anchors")
    return rows.select("graph_id", order.alias("order"), F.col("edges").alias("size"), (order + F.col("edges")).alias("nodes"), "vectors", F.col("vectors").alias("forest_entries"), F.lit(relevance).alias("relevance"))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` must be unique by ``keys``."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def delete_facts(memory: Memory, gone: DataFrame) -> Memory:
    """The memory without the facts of ``gone`` (graph_id, fact_key), their edges, vectors and index entries."""
    keys = ["graph_id", "fact_key"]
    out = [t.join(gone.select(*keys), keys, "left_anti") if t is not None else None for t in (memory.facts, memory.edges, memory.postings, memory.lengths, memory.vectors)]
    facts, edges, post, lens, vecs = out
    return Memory(facts, edges, post, lens, neighbours(facts, edges), vecs)
