"""A batch of recalls as one plan.

text, vector and anchors give observations ("contributions") of candidates; the
first of each reading are seeds; beside a named anchor their mass is passed on
through the anchors that file them; what was seen of each candidate is folded
into a score, aged and ranked.

A reading is what an index returns under one rule: 0 for all facts in the
window, 1 for those that are filed under a named anchor as well. The second only
decides which facts are seeds.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions import clocks
from mnemos.functions.text import query_terms
from mnemos.model import Config, Memory, unsigned
from mnemos.operators import anchors as A
from mnemos.operators import scoring, textindex, vectors
from mnemos.session import SMALL_ROWS, cut, drop_cut, gathered


@dataclass(frozen=True)
class Recall:
    """One question, its time values already resolved to instants."""

    keywords: tuple[str, ...] = ()
    vector: tuple[float, ...] | None = None
    topics: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    graph_id: int = 0
    depth: int = 0
    top: int = 10  # 0 keeps all
    since: datetime | None = None
    until: datetime | None = None
    since_clock: str = "happened"
    until_clock: str = "happened"
    query_id: int = 0

    @property
    def anchored(self) -> bool:
        return bool(self.topics or self.entities)

    @property
    def alone(self) -> bool:
        """Whether anchors alone seed the search."""
        return not self.keywords and not self.vector

    @property
    def lanes(self) -> int:
        """An anchor beside a term or vector contributes through the graph, whatever depth says."""
        return max(self.depth, 1) if self.anchored and not self.alone else self.depth


@dataclass
class Found:
    """hits: query_id, place, graph_id, fact_key, value, written_at, said_at, occurred,
    relevance, decay, score, seed. The other tables explain them."""

    hits: DataFrame
    contributions: DataFrame
    pool: DataFrame
    seeds: DataFrame
    terms: DataFrame
    rates: DataFrame
    extra: dict = field(default_factory=dict)

    def close(self) -> None:
        """Deletes the intermediate files; the tables can't be read afterwards."""
        drop_cut(self.hits.sparkSession, *self.extra.pop("cuts", ()))


SOURCES = ("text", "vector", "graph", "anchor")
#: Up to so many different terms are named in the scan's filter.
MANY_TERMS = 1000
#: Places from which on a list counts them as one.
LAST_RANK = 65535

CONTRIBUTION = "query_id bigint, graph_id smallint, fact_key bigint, source string, score double, list_rank int, via_kind string, via string, degree bigint, cnt bigint, named boolean, held double"


def _contribution(rows: DataFrame, **columns) -> DataFrame:
    out = []
    for part in CONTRIBUTION.split(", "):
        name, kind = part.split(" ")
        c = columns.get(name, F.col(name) if name in rows.columns else F.lit(None))
        out.append((c if not isinstance(c, (str, int, float, bool)) else F.lit(c)).cast(kind).alias(name))
    return rows.select(*out)


def _first(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key with their place from 0; each task passes on that many at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < most)


def search(memory: Memory, recalls: Sequence[Recall], config: Config = Config(), now: datetime | None = None, ranks: bool = True, whole: bool = False) -> Found:
    """``ranks``: whether contributions carry their place in the list they came from; off,
    lists are only cut to their seeds. ``whole``: ``hits`` are all candidates, unordered and without place or text.

    Scores are compared to nine digits, so that the order doesn't hang on the order of sums.
    """
    spark = memory.facts.sparkSession
    ranks = ranks or config.scorer == "rrf"
    now = now or datetime.now(timezone.utc)
    rows = [(r.query_id, r.graph_id, r.lanes, r.top, max(config.seed_size, r.top), r.since, r.until, r.since_clock, r.until_clock, r.alone) for r in recalls]
    schema = "query_id bigint, graph_id smallint, depth int, top int, seed_k int, since timestamp, until timestamp, since_clock string, until_clock string, alone boolean"
    asked = F.broadcast(spark.createDataFrame(rows, schema))
    bounded = any(r.since or r.until for r in recalls)
    named_rows = {(r.query_id, r.graph_id, k, v) for r in recalls for k, vs in (("topic", r.topics), ("entity", r.entities)) for v in vs}
    named = spark.createDataFrame(sorted(named_rows), "query_id bigint, graph_id smallint, kind string, anchor string") if named_rows else None
    filed = None
    if named is not None:
        filed = F.broadcast(named).join(memory.edges, A.ANCHOR).select("query_id", "graph_id", "fact_key").distinct()

    def window(candidates: DataFrame) -> DataFrame:
        """Candidates (query_id, graph_id, fact_key, ..) that lie in their query's window."""
        if not bounded:
            return candidates
        times = memory.facts.select("graph_id", "fact_key", "written_at", "said_at", "occurred")
        at = candidates.join(times, ["graph_id", "fact_key"]).join(asked.select("query_id", "since", "until", "since_clock", "until_clock"), "query_id")
        keep = F.lit(False)
        for s, u in sorted({(r.since_clock, r.until_clock) for r in recalls}):
            keep = keep | ((F.col("since_clock") == s) & (F.col("until_clock") == u) & clocks.in_window(F.col("since"), F.col("until"), s, u))
        free = F.col("since").isNull() & F.col("until").isNull()
        return at.where(free | keep).select(*candidates.columns)

    def readings(candidates: DataFrame) -> DataFrame:
        """Candidates in the window, once for each reading that keeps them."""
        kept = window(candidates)
        first = kept.withColumn("reading", F.lit(0))
        if filed is None:
            return first
        second = kept.join(filed, ["query_id", "graph_id", "fact_key"], "left_semi").withColumn("reading", F.lit(1))
        return first.unionByName(second)

    timings, clock = dict.fromkeys(SOURCES, 0), [time.perf_counter_ns()]

    def timed_as(source: str) -> None:
        """What passed since the last call counts for ``source``: its lists are read by then."""
        now_ns = time.perf_counter_ns()
        timings[source] += now_ns - clock[0]
        clock[0] = now_ns

    parts, seed_parts, cuts = [], [], []
    missed = weighted = None
    most_seeds = max((max(config.seed_size, r.top) for r in recalls), default=0)

    def kept_once(df: DataFrame) -> DataFrame:
        """Several later stages read it: written to the shared folder, which also keeps their plans small."""
        cuts.append(cut(df))
        return cuts[-1]

    def small(df: DataFrame) -> DataFrame:
        """A table bounded by what was asked (terms, or the seeds of each question and their
        anchors): through the driver up to a size, so that what follows joins it by broadcast."""
        found = gathered(df)
        return kept_once(df) if found is None else F.broadcast(found)

    def candidates(df: DataFrame, guess: int) -> DataFrame:
        """Candidates, about ``guess`` of them: few go through the driver, others over the shared folder."""
        found = gathered(df) if guess <= SMALL_ROWS else None
        return kept_once(df) if found is None else found

    def pooled(scored: DataFrame, source: str, guess: int) -> DataFrame:
        """The first reading, with places from 0 if they are asked for; the heads of every reading are seeds."""
        best = [F.round("score", 9).desc(), unsigned("fact_key")]
        scored = candidates(scored, guess)
        heads = _first(scored, ["query_id", "reading"], best, most_seeds)
        if len({r.top for r in recalls}) > 1:
            heads = heads.join(asked.select("query_id", "seed_k"), "query_id").where("place < seed_k")
        seed_parts.append(heads.select("query_id", "graph_id", "fact_key", F.lit(source).alias("source")).distinct())
        first = scored.where("reading = 0").drop("reading")
        if not ranks:
            return first.withColumn("place", F.lit(None).cast("int"))
        placed = _first(first, ["query_id"], best, LAST_RANK).select("query_id", "graph_id", "fact_key", "place")
        return first.join(placed, ["query_id", "graph_id", "fact_key"], "left").withColumn("place", F.coalesce("place", F.lit(LAST_RANK)))

    texts = [(r.query_id, r.graph_id, t) for r in recalls for t in query_terms(" ".join(r.keywords), config.stemming)]
    if texts:
        asked_terms = spark.createDataFrame(texts, "query_id bigint, graph_id smallint, term string")
        posts, wanted_terms = memory.postings, sorted({t for _, _, t in texts})
        if len(wanted_terms) <= MANY_TERMS:
            posts = posts.where(F.col("term").isin(wanted_terms))  # reaches the scan
        stats = F.broadcast(spark.createDataFrame(list(memory.sizes().items()), "graph_id smallint, s struct<docs: bigint, avgdl: double>").select("graph_id", "s.*"))
        weighted = small(textindex.weighted_terms(F.broadcast(asked_terms), posts, memory.lengths, config.relevance, stats))
        # a fact that holds a term lends it to its neighbours, mostly not more than eight
        guess = sum(min(r["docs"], r["df"] * (8 if config.window_gamma > 0 else 1)) for r in weighted.select("docs", "df").toLocalIterator())
        found = textindex.matches(weighted, posts)
        kept = readings(found)
        if config.window_gamma > 0:
            counted = textindex.lent(kept, memory.neighbours, config.window_gamma)
            keys = ["query_id", "reading", "graph_id", "fact_key"]

            def accepted(df: DataFrame) -> DataFrame:
                """Borrowers and lenders a reading keeps."""
                out = window(df)
                if filed is None:
                    return out
                inside = out.where("reading = 1").join(filed, ["query_id", "graph_id", "fact_key"], "left_semi")
                return out.where("reading = 0").unionByName(inside)

            counted = accepted(counted)
            lens = textindex.lent_lengths(counted.select(*keys).distinct(), memory.neighbours, memory.lengths, config.window_gamma, accepted)
        else:
            counted = kept.withColumn("tf", F.col("tf").cast("double"))
            docs = counted.select("query_id", "reading", "graph_id", "fact_key").distinct()
            lens = docs.join(memory.lengths, ["graph_id", "fact_key"])
        text = pooled(textindex.relevances(counted, weighted, lens, config.relevance), "text", guess)
        if ranks or any(r.vector for r in recalls):  # only beside a vector does it matter how much of a question a text holds
            text = text.join(textindex.held_bits(found, weighted), ["query_id", "fact_key"], "left")
        else:
            text = text.withColumns({"held": F.lit(None).cast("double"), "total": F.lit(None).cast("double")})
        parts.append(_contribution(text, source="text", list_rank=F.col("place"), cnt=1, named=False, held=F.when(F.col("total") > 0, F.col("held") / F.col("total"))))
        with_vector = [r.query_id for r in recalls if r.vector and r.keywords]
        if with_vector:
            best = _first(text.where(F.col("query_id").isin(*with_vector)).drop("place"), ["query_id"], [F.round("score", 9).desc(), unsigned("fact_key")], 1).where("held > 0")
            missed = small(best.select("query_id", ((F.col("total") - F.col("held")) / F.col("held")).alias("missed")))

    timed_as("text")
    wanted = [(r.query_id, r.graph_id, list(map(float, r.vector))) for r in recalls if r.vector]
    if wanted and memory.vectors is not None:
        about = spark.createDataFrame(wanted, "query_id bigint, graph_id smallint, vector array<double>")
        near = readings(vectors.nearest_exact(about, memory.vectors))
        near = pooled(near.withColumn("score", -F.col("distance")), "vector", sum(memory.sizes().get(g, (0,))[0] for _, g, _ in wanted)).withColumn("score", vectors.similarity(F.col("distance")))
        parts.append(_contribution(near, source="vector", list_rank=F.col("place"), cnt=1, named=False))

    timed_as("vector")
    alone = [r.query_id for r in recalls if r.alone and r.anchored]
    if alone:
        held = A.named_anchors(named.where(F.col("query_id").isin(*alone)), memory.edges)
        members = held.join(memory.edges, A.ANCHOR)
        parts.append(_contribution(members, source="anchor", score=1.0, via_kind=F.col("kind"), via=F.col("anchor"), cnt=1, named=False, list_rank=0))

    timed_as("anchor")
    empty = spark.createDataFrame([], CONTRIBUTION)
    seen = empty
    for p in parts:
        seen = seen.unionByName(p)
    seeds = spark.createDataFrame([], "query_id bigint, graph_id smallint, fact_key bigint, source string")
    for p in seed_parts:
        seeds = seeds.unionByName(p)
    rates = None
    walking = [r.query_id for r in recalls if r.anchored and not r.alone and r.lanes >= 1]
    if walking and config.traversal != "none":
        seeds = small(seeds)
        distinct = seeds.where(F.col("query_id").isin(*walking)).select("query_id", "graph_id", "fact_key").distinct()
        about = seen.join(F.broadcast(distinct), ["query_id", "graph_id", "fact_key"], "left_semi")
        masses = small(scoring.folded(about, missed, rates).select("query_id", "graph_id", "fact_key", "mass"))
        observed = small(A.observe(masses, memory.edges, config.traversal))
        rates = F.broadcast(A.background(observed))
        opened = F.broadcast(A.transmitting(observed, rates, F.broadcast(named), asked.select("query_id", "depth")))
        more = A.expand(opened, memory.edges, config.traversal)
        seen = seen.unionByName(
            _contribution(more, source="graph", score=F.col("mass"), list_rank=0, degree=F.least("degree", F.lit(4294967295)), cnt=F.least("seeds", F.lit(65535)))
        )
    timed_as("graph")
    pool = window(scoring.folded(seen, missed, rates))
    rates = spark.createDataFrame([], "query_id bigint, total_mass double, total_degree bigint, rate double") if rates is None else rates
    missed = spark.createDataFrame([], "query_id bigint, missed double") if missed is None else missed
    scored = scoring.scored(pool, config.scorer)
    pool = scored.join(memory.facts.select("graph_id", "fact_key", "value"), ["graph_id", "fact_key"])
    marks = seeds.select("query_id", "graph_id", "fact_key").distinct().withColumn("seed", F.lit(True))
    extra = {"missed": missed, "asked": asked, "now": now, "cuts": cuts, "timings": timings}
    terms = weighted if weighted is not None else spark.createDataFrame([], "query_id bigint, term string")
    keys = ["graph_id", "fact_key"]
    if whole:
        return Found(scored.select("query_id", *keys, "relevance"), seen, pool, seeds, terms, rates, extra)
    # the text of the facts is read for the hits only
    times = memory.facts.select(*keys, "written_at", "said_at", "occurred")
    timed = scored.select("query_id", *keys, "relevance").join(times, keys)
    timed = timed.withColumn("decay", clocks.decayed(F.lit(1.0), F.col("written_at"), F.lit(now), config.half_life_s))
    timed = timed.select("query_id", *keys, "relevance", "decay", (F.col("relevance") * F.col("decay")).alias("score"), clocks.last_start(clocks.intervals("happened")).alias("last"))
    order = [F.round("score", 9).desc(), F.col("last").desc(), unsigned("fact_key")]
    if any(r.top <= 0 for r in recalls):
        ranked = timed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)
    else:
        ranked = _first(timed, ["query_id"], order, max(r.top for r in recalls))
    ranked = ranked.withColumn("place", F.col("place") + 1)
    if len({(r.top, r.alone) for r in recalls}) > 1:
        ranked = ranked.join(asked.select("query_id", "top", "alone"), "query_id").where("top <= 0 or place <= top")
    else:
        ranked = ranked.withColumn("alone", F.lit(any(r.alone for r in recalls)))
    if config.min_score_ratio > 0:
        best = F.max("relevance").over(Window.partitionBy("query_id"))
        ranked = ranked.withColumn("__best", best).where(F.col("relevance") >= config.min_score_ratio * F.col("__best")).drop("__best")
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    ranked = ranked.join(marks, ["query_id", *keys], "left").withColumn("seed", F.col("alone") | F.coalesce("seed", F.lit(False)))
    hits = memory.facts.join(F.broadcast(ranked) if len(recalls) * max((r.top or SMALL_ROWS for r in recalls), default=0) <= SMALL_ROWS else ranked, keys)
    hits = hits.select("query_id", "place", "graph_id", "fact_key", "value", "written_at", "said_at", "occurred", "relevance", "decay", "score", "seed")
    return Found(hits, seen, pool, seeds, terms, rates, extra)
