"""The text index: postings, statistics and relevance.

Every stage works on a batch of queries (``query_id``); the interactive call is a batch of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.text import stemmed, terms, without_stop_words

K1, B = 1.2, 0.75
FACT = ["graph_id", "fact_key"]


def tokens(facts: DataFrame, stemming: bool = True) -> DataFrame:
    """(graph_id, fact_key, tokens): a fact of stop words alone has an empty list and counts as a document."""
    words = facts.select(*FACT, without_stop_words(F.coalesce(terms(F.col("value")), F.array().cast("array<string>"))).alias("tokens"))
    return stemmed(words, "tokens") if stemming else words


def postings(words: DataFrame) -> DataFrame:
    """(graph_id, term, fact_key, tf)."""
    rows = words.select(*FACT, F.explode("tokens").alias("term"))
    return rows.groupBy("graph_id", "term", "fact_key").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def lengths(words: DataFrame) -> DataFrame:
    """(graph_id, fact_key, len)."""
    return words.select(*FACT, F.size("tokens").alias("len"))


def corpus(lens: DataFrame) -> DataFrame:
    """(graph_id, docs, avgdl): of the whole graph, never of a window."""
    return lens.groupBy("graph_id").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avgdl"))


def frequencies(posts: DataFrame) -> DataFrame:
    """(graph_id, term, df) of terms a fact still holds."""
    return posts.where("tf > 0").groupBy("graph_id", "term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def gain(weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    """BM25 of one term."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B / avgdl * length)


def coverage(score: Column, matched: Column, known: Column) -> Column:
    """The score by the share of the query's known idf mass that matched, in steps of 1/1024."""
    return score * F.floor(matched * 1024) / (F.floor(known * 1024) + 1)


def weighted_terms(query_terms: DataFrame, posts: DataFrame, lens: DataFrame, relevance: str = "bm25", stats: DataFrame | None = None) -> DataFrame:
    """(query_id, graph_id, term, df, docs, avgdl, weight, bits) of the queries' terms that
    some fact holds. ``query_terms``: (query_id, graph_id, term), repeats as asked; ``stats``: ``corpus(lens)``, where it is kept."""
    asked = query_terms.groupBy("query_id", "graph_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("graph_id", "term").distinct()
    df = frequencies(posts.join(wanted, ["graph_id", "term"], "left_semi"))
    rows = asked.join(df, ["graph_id", "term"]).join(corpus(lens) if stats is None else F.broadcast(stats), "graph_id")
    weight = F.col("times").cast("double") if relevance == "matchcount" else idf(F.col("df"), F.col("docs"))
    return rows.select("query_id", "graph_id", "term", "df", "docs", "avgdl", weight.alias("weight"), (-F.log2(F.col("df") / F.col("docs"))).alias("bits"))


def matches(weighted: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, graph_id, term, fact_key, tf)."""
    return weighted.select("query_id", "graph_id", "term").join(posts.where("tf > 0"), ["graph_id", "term"]).select("query_id", "graph_id", "term", "fact_key", "tf")


def lent(found: DataFrame, near: DataFrame, gamma: float) -> DataFrame:
    """``found`` with tf shared: a fact also counts ``gamma`` of what its neighbours hold, each once
    though ``near`` may name it under several anchors. ``found`` and the result: (query_id, reading, graph_id, term, fact_key, tf)."""
    shared = (
        found.join(near, FACT)
        .select("query_id", "reading", "graph_id", "term", "fact_key", F.col("neighbour"), (F.col("tf") * gamma).alias("tf"))
        .distinct()
        .drop("fact_key")
        .withColumnRenamed("neighbour", "fact_key")
    )
    own = found.select("query_id", "reading", "graph_id", "term", "fact_key", F.col("tf").cast("double").alias("tf"))
    return own.unionByName(shared).groupBy("query_id", "reading", "graph_id", "term", "fact_key").agg(F.sum("tf").alias("tf"))


def lent_lengths(docs: DataFrame, near: DataFrame, lens: DataFrame, gamma: float, accepted=None) -> DataFrame:
    """(query_id, reading, graph_id, fact_key, len) with ``gamma`` of the neighbours' lengths added. ``accepted`` filters (query_id, reading, graph_id, fact_key) rows to those a reading keeps."""
    own = docs.join(lens, FACT).select("query_id", "reading", *FACT, F.col("len").cast("double").alias("len"))
    about = docs.join(near, FACT).select("query_id", "reading", "graph_id", F.col("fact_key").alias("of"), F.col("neighbour").alias("fact_key")).distinct()
    if accepted is not None:
        about = accepted(about)
    add = about.join(lens, FACT).select("query_id", "reading", "graph_id", F.col("of").alias("fact_key"), (F.col("len") * gamma).alias("len"))
    return own.unionByName(add).groupBy("query_id", "reading", *FACT).agg(F.sum("len").alias("len"))


def relevances(counted: DataFrame, weighted: DataFrame, lens: DataFrame, relevance: str = "bm25") -> DataFrame:
    """(query_id, reading, graph_id, fact_key, score). ``counted``: (query_id, reading,
    graph_id, term, fact_key, tf); ``lens``: (query_id, reading, graph_id, fact_key, len)."""
    rows = counted.join(weighted, ["query_id", "graph_id", "term"])
    if relevance == "matchcount":
        return rows.groupBy("query_id", "reading", *FACT).agg(F.sum(F.least(F.col("tf").cast("double"), F.lit(1.0)) * F.col("weight")).alias("score"))
    rows = rows.join(lens, ["query_id", "reading", *FACT])
    g = gain(F.col("weight"), F.col("tf"), F.col("len"), F.col("avgdl"))
    sums = rows.groupBy("query_id", "reading", *FACT).agg(F.sum(g).alias("gained"), F.sum("weight").alias("matched"))
    known = weighted.groupBy("query_id").agg(F.sum("weight").alias("known"))
    return sums.join(known, "query_id").select("query_id", "reading", *FACT, coverage(F.col("gained"), F.col("matched"), F.col("known")).alias("score"))


def held_bits(found: DataFrame, weighted: DataFrame) -> DataFrame:
    """(query_id, fact_key, held, total): the information of the terms a fact holds itself, and of all known terms of the query."""
    total = weighted.groupBy("query_id").agg(F.sum("bits").alias("total"))
    held = found.join(weighted.select("query_id", "term", "bits"), ["query_id", "term"]).groupBy("query_id", "fact_key").agg(F.sum("bits").alias("held"))
    return held.join(total, "query_id")
