"""The engine's operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.functions import clocks, render
from mnemos.operators import anchors as A
from mnemos.operators import answers, evaluation, forest, ingest, scoring, textindex, vectors
from mnemos.session import cut
from mnemos.sources.tables import table

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
SINCE, UNTIL = datetime(2024, 2, 1, tzinfo=timezone.utc), datetime(2024, 6, 1, tzinfo=timezone.utc)
ASKED = [(1, "harbour"), (1, "ledger"), (2, "frozen"), (2, "kettle"), (2, "unheardof"), (3, "orchard"), (3, "the"), (3, "ledger"), (3, "ledger")]
GAMMA = 0.3
HALF_LIFE = 90 * 24 * 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "remembers")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.facts_of(_log(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return ingest.edges_of(_log(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return textindex.tokens(_facts(spark, d), stemming=False)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each question, to every graph."""
    graphs = _log(spark, d).select("graph_id").distinct()
    terms = F.broadcast(spark.createDataFrame(ASKED, "q bigint, term string"))
    return graphs.crossJoin(terms).select((F.col("q") * 1000 + F.col("graph_id")).alias("query_id"), "graph_id", "term")


from mnemos.functions.text import STOP_WORDS  # noqa: E402

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_FACTS = """
facts as (
  select graph_id, fact_key, value, written_at, said_at, occurred from remembers where fact_key is not null and value is not null
  qualify row_number() over (partition by graph_id, fact_key order by written_at desc nulls last, remember_id desc nulls last) = 1
)"""
_EDGES = """
edges as (
  select distinct graph_id, fact_key, kind, lower(anchor) as anchor from (
    select graph_id, fact_key, 'topic' as kind, unnest(topics) as anchor from remembers
    union all select graph_id, fact_key, 'entity', unnest(entities) from remembers)
  where trim(anchor) <> ''
),
degrees as (select graph_id, kind, anchor, count(*) as degree from edges group by all)"""
_TOKENS = f"""{_FACTS},
words as (
  select graph_id, fact_key, [x for x in regexp_extract_all(lower(value), '[\\p{{L}}\\p{{Nd}}\\p{{So}}]+') if x not in ({_STOP})] as tokens from facts
),
lens as (select graph_id, fact_key, len(tokens) as len from words),
posts as (select graph_id, term, fact_key, count(*)::int as tf from (select graph_id, fact_key, unnest(tokens) as term from words) group by all),
corpus as (select graph_id, count(*) as docs, avg(len) as avgdl from lens group by all)"""
_ASKED = f"""{_TOKENS},
asked as (select q * 1000 + graph_id as query_id, graph_id, term, count(*) as times
          from (values {', '.join(f"({q}, '{t}')" for q, t in ASKED)}) v(q, term), (select distinct graph_id from remembers) group by all),
dfs as (select graph_id, term, count(*) as df from posts group by all),
weighted as (
  select query_id, graph_id, term, times, df, docs, avgdl, ln(1 + (docs - df + 0.5) / (df + 0.5)) as weight, -log2(df / docs) as bits
  from asked join dfs using (graph_id, term) join corpus using (graph_id)
),
known as (select query_id, sum(weight) as known from weighted group by all),
found as (select query_id, graph_id, term, fact_key, tf from weighted join posts using (graph_id, term))"""
_SEQ = f"""{_FACTS}, {_EDGES},
seq as (
  select graph_id, fact_key, lag(fact_key) over w as before, lead(fact_key) over w as after
  from edges join facts using (graph_id, fact_key)
  window w as (partition by graph_id, kind, anchor order by written_at, fact_key::hugeint + case when fact_key < 0 then 18446744073709551616::hugeint else 0 end)
),
near as (
  select distinct graph_id, fact_key, neighbour from (select graph_id, fact_key, before as neighbour from seq union all select graph_id, fact_key, after from seq)
  where neighbour is not null
)"""


@query(f"with {_FACTS} select graph_id, fact_key, value, epoch_us(written_at) as written_us, epoch_us(said_at) as said_us, coalesce(len(occurred), -1) as n_occurred from facts")
def facts(spark, d):
    return _facts(spark, d).select(
        "graph_id", "fact_key", "value", F.unix_micros("written_at").alias("written_us"), F.unix_micros("said_at").alias("said_us"), F.coalesce(F.when(F.col("occurred").isNotNull(), F.size("occurred")), F.lit(-1)).cast("bigint").alias("n_occurred")
    )


@query(f"with {_EDGES} select * from edges")
def edges(spark, d):
    return _edges(spark, d)


@query(f"with {_EDGES} select * from degrees")
def anchor_degrees(spark, d):
    return A.degrees(_edges(spark, d))


@query(f"""with {_FACTS}, {_EDGES}, v as (select distinct vec_id, graph_id, fact_key from vectors where fact_key is not null and embedding is not null)
select g::smallint as graph_id, (select count(*) from facts where graph_id = g) as facts, (select count(*) from degrees where graph_id = g) as anchors,
  (select count(*) from edges where graph_id = g) as edges, (select count(*) from (select distinct graph_id, fact_key from v) where graph_id = g) as vectors
from range(32) t(g)""")
def graph_stats(spark, d):
    vecs = table(spark, d, "vectors").where("fact_key is not null and embedding is not null").select("graph_id", "fact_key").distinct()
    f, e = _facts(spark, d), _edges(spark, d)
    return ingest.stats(ingest.Memory(f, e, f, f, f, vecs), 32)


@query(f"with {_TOKENS} select * from posts")
def postings(spark, d):
    return textindex.postings(_tokens(spark, d))


@query(f"with {_TOKENS} select graph_id, fact_key, len from lens")
def document_lengths(spark, d):
    return textindex.lengths(_tokens(spark, d)).select("graph_id", "fact_key", F.col("len").cast("bigint").alias("len"))


@query(f"with {_TOKENS} select graph_id, docs, round(avgdl, 6) as avgdl from corpus")
def corpus_statistics(spark, d):
    return textindex.corpus(textindex.lengths(_tokens(spark, d))).select("graph_id", "docs", F.round("avgdl", 6).alias("avgdl"))


@query("select graph_id, term, count(*) as df from (select distinct graph_id, term, fact_key from postings where tf > 0) group by all")
def term_frequencies(spark, d):
    return textindex.frequencies(table(spark, d, "postings").distinct())


def _text(spark, d):
    words = _tokens(spark, d)
    posts, lens = textindex.postings(words), textindex.lengths(words)
    return posts, lens


@query(f"with {_ASKED} select query_id, graph_id, term, df, docs, round(weight, 6) as weight, round(bits, 6) as bits from weighted")
def term_weights(spark, d):
    w = textindex.weighted_terms(_asked(spark, d), *_text(spark, d))
    return w.select("query_id", "graph_id", "term", "df", "docs", F.round("weight", 6).alias("weight"), F.round("bits", 6).alias("bits"))


def _bm25(spark, d, relevance="bm25"):
    posts, lens = _text(spark, d)
    w = textindex.weighted_terms(_asked(spark, d), posts, lens, relevance)
    found = textindex.matches(w, posts).withColumn("reading", F.lit(0))
    docs = found.select("query_id", "reading", "graph_id", "fact_key").distinct().join(lens, ["graph_id", "fact_key"])
    return textindex.relevances(found, w, docs, relevance).select("query_id", "graph_id", "fact_key", F.round("score", 6).alias("score"))


_BM25 = """
gains as (
  select query_id, graph_id, fact_key, sum(weight * tf * 2.2 / (tf + 0.3 + 0.9 / avgdl * len)) as gained, sum(weight) as matched
  from found join weighted using (query_id, graph_id, term) join lens using (graph_id, fact_key) group by all
),
bm25 as (select query_id, graph_id, fact_key, gained * floor(matched * 1024) / (floor(known * 1024) + 1) as score from gains join known using (query_id))"""


@query(f"with {_ASKED}, {_BM25} select query_id, graph_id, fact_key, round(score, 6) as score from bm25")
def bm25_scores(spark, d):
    return _bm25(spark, d)


@query(f"with {_ASKED} select query_id, graph_id, fact_key, round(sum(least(tf, 1) * times)::double, 6) as score from found join weighted using (query_id, graph_id, term) group by all")
def match_counts(spark, d):
    return _bm25(spark, d, "matchcount")


@query(f"""with {_ASKED}, total as (select query_id, sum(bits) as total from weighted group by all)
select query_id, fact_key, round(sum(bits), 6) as held, round(any_value(total), 6) as total from found join weighted using (query_id, graph_id, term) join total using (query_id) group by query_id, fact_key""")
def held_information(spark, d):
    posts, lens = _text(spark, d)
    w = textindex.weighted_terms(_asked(spark, d), posts, lens)
    return textindex.held_bits(textindex.matches(w, posts), w).select("query_id", "fact_key", F.round("held", 6).alias("held"), F.round("total", 6).alias("total"))


@query(f"with {_SEQ} select * from near")
def neighbours(spark, d):
    return A.neighbours(_facts(spark, d), _edges(spark, d))


_LENT = f"""
lent as (
  select query_id, graph_id, term, fact_key, sum(tf) as tf from (
    select query_id, graph_id, term, fact_key, tf::double as tf from found
    union all select query_id, f.graph_id, term, neighbour, tf * {GAMMA}::double from found f join near n on f.graph_id = n.graph_id and f.fact_key = n.fact_key)
  group by all
),
longer as (
  select l.graph_id, l.fact_key, any_value(l.len) + {GAMMA}::double * coalesce(sum(o.len), 0) as len
  from lens l left join near n on n.graph_id = l.graph_id and n.fact_key = l.fact_key left join lens o on o.graph_id = n.graph_id and o.fact_key = n.neighbour
  group by l.graph_id, l.fact_key
),
lent_gains as (
  select query_id, graph_id, fact_key, sum(weight * tf * 2.2 / (tf + 0.3 + 0.9 / avgdl * len)) as gained, sum(weight) as matched
  from lent join weighted using (query_id, graph_id, term) join longer using (graph_id, fact_key) group by all
),
lent_bm25 as (select query_id, graph_id, fact_key, gained * floor(matched * 1024) / (floor(known * 1024) + 1) as score from lent_gains join known using (query_id))"""


@query(f"with {_ASKED}, {_SEQ.removeprefix(_FACTS + ',')}, {_LENT} select query_id, graph_id, fact_key, round(score, 6) as score from lent_bm25")
def lending_scores(spark, d):
    from mnemos.recalls import memory

    m = memory(spark, d)  # the derived tables are read as a store keeps them
    posts, lens, near = m.postings, m.lengths, m.neighbours
    w = textindex.weighted_terms(_asked(spark, d), posts, lens)
    counted = textindex.lent(textindex.matches(w, posts).withColumn("reading", F.lit(0)), near, GAMMA)
    docs = counted.select("query_id", "reading", "graph_id", "fact_key").distinct()
    long = textindex.lent_lengths(docs, near, lens, GAMMA)
    return textindex.relevances(counted, w, long).select("query_id", "graph_id", "fact_key", F.round("score", 6).alias("score"))


_OKVEC = "len(embedding) = 64 and list_bool_and([isfinite(x) for x in embedding])"


@query(f"""with v as (select distinct vec_id, graph_id, embedding::double[] as e from vectors where {_OKVEC})
select a.vec_id as query_id, b.vec_id as other, round(list_distance(a.e, b.e), 6) as distance, round(1 / (1 + list_distance(a.e, b.e)), 6) as similarity
from v a join v b on a.graph_id = b.graph_id and a.vec_id <> b.vec_id where a.vec_id % 100 = 0
qualify row_number() over (partition by a.vec_id order by round(list_distance(a.e, b.e), 9), b.vec_id) <= 10""")
def exact_nearest(spark, d):
    """The stated search set (ids divisible by 100) against all rows."""
    e = F.col("embedding")
    rows = table(spark, d, "vectors").where((F.size(e) == 64) & F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", "graph_id", "embedding").distinct()
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "graph_id", F.col("embedding").alias("vector"))
    found = vectors.nearest_exact(asked, rows.withColumnRenamed("vec_id", "fact_key"), asked.count()).where("query_id <> fact_key")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "fact_key")
    near = found.withColumn("n", F.row_number().over(w)).where("n <= 10")
    return near.select("query_id", F.col("fact_key").alias("other"), F.round("distance", 6).alias("distance"), F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


def _seeds(spark, d):
    """What recalls seeded with: their hits so marked, with the score as mass."""
    rows = table(spark, d, "hits", "query_id", "graph_id", "fact_key", "score", "seed").where("seed").distinct()
    return rows.groupBy("query_id", "graph_id", "fact_key").agg(F.max("score").alias("mass"))


_OBSERVED = f"""{_EDGES},
seeds as (select query_id, graph_id, fact_key, max(score) as mass from hits where seed group by all),
observed as (select query_id, graph_id, kind, anchor, sum(mass) as mass, count(*) as seeds, any_value(degree) as degree from seeds join edges using (graph_id, fact_key) join degrees using (graph_id, kind, anchor) group by query_id, graph_id, kind, anchor),
rates as (select query_id, sum(mass) as total_mass, sum(degree)::bigint as total_degree, sum(mass) / sum(degree) as rate from observed group by all),
named as (select distinct c.query_id, h.graph_id, 'topic' as kind, c.via as anchor from contributions c join hits h on h.query_id = c.query_id where c.source = 'anchor'),
opened as (
  select o.*, n.anchor is not null as named from observed o join rates using (query_id) left join named n using (query_id, graph_id, kind, anchor)
  where n.anchor is not null or round(mass * total_degree - degree * total_mass, 6) > 0
)"""


@query(f"with {_OBSERVED} select query_id, graph_id, kind, anchor, round(mass, 4) as mass, seeds, degree from observed")
def anchors_observed(spark, d):
    o = A.observe(_seeds(spark, d), _edges(spark, d))
    return o.select("query_id", "graph_id", "kind", "anchor", F.round("mass", 4).alias("mass"), "seeds", "degree")


@query(f"with {_OBSERVED} select query_id, round(total_mass, 4) as total_mass, total_degree, round(rate, 6) as rate from rates")
def background_rates(spark, d):
    r = A.background(A.observe(_seeds(spark, d), _edges(spark, d)))
    return r.select("query_id", F.round("total_mass", 4).alias("total_mass"), "total_degree", F.round("rate", 6).alias("rate"))


def _opened(spark, d):
    hits = table(spark, d, "hits", "query_id", "graph_id").distinct()
    named = table(spark, d, "contributions").where("source = 'anchor'").select("query_id", F.col("via").alias("anchor")).distinct().join(hits, "query_id").withColumn("kind", F.lit("topic"))
    observed = A.observe(_seeds(spark, d), _edges(spark, d))
    return A.transmitting(observed, A.background(observed), named, hits.select("query_id", F.lit(2).alias("depth")).distinct())


@query(f"with {_OBSERVED} select query_id, graph_id, kind, anchor, round(mass, 4) as mass, named from opened")
def anchors_transmitting(spark, d):
    return _opened(spark, d).select("query_id", "graph_id", "kind", "anchor", F.round("mass", 4).alias("mass"), "named")


@query(f"with {_OBSERVED} select query_id, graph_id, fact_key, anchor as via, round(mass, 4) as mass, degree, seeds from opened join edges using (graph_id, kind, anchor)")
def graph_contributions(spark, d):
    return A.expand(_opened(spark, d), _edges(spark, d)).select("query_id", "graph_id", "fact_key", "via", F.round("mass", 4).alias("mass"), "degree", "seeds")


def _pool(spark, d):
    rows = table(spark, d, "contributions").distinct()
    ok = rows.where("score is not null and not isnan(score)").select(
        "query_id", F.lit(0).cast("smallint").alias("graph_id"), "fact_key", "source", "score", "list_rank", F.lit("topic").alias("via_kind"), "via", "degree", F.coalesce("named", F.lit(False)).alias("named"), "held"
    )
    none = spark.createDataFrame([], "query_id bigint, missed double")
    rates = ok.where("source = 'graph'").groupBy("query_id").agg((F.sum("score") / F.sum("degree") / 4).alias("rate"))
    return scoring.folded(ok, none, rates)


_POOL = """
ok as (select * from (select distinct * from contributions) where score is not null and not isnan(score)),
rates as (select query_id, sum(score) / sum(degree) / 4 as rate from ok where source = 'graph' group by all),
sums as (
  select query_id, fact_key, coalesce(sum(score) filter (source = 'text'), 0) as text, coalesce(sum(score) filter (source = 'vector'), 0) as vector,
    coalesce(sum(score) filter (source = 'anchor'), 0) as anchor, coalesce(max(held) filter (source = 'text'), 0) as held, sum(1 / (60 + list_rank)) as rrf
  from ok group by all
),
masses as (select *, text + vector + anchor as mass from sums),
pool as (
  select m.*, coalesce((select sum(greatest((o.score - m.mass - case when coalesce(o.named, false) then 0 else greatest(o.degree, 1) * coalesce(r.rate, 0) end) / greatest(o.degree, 1), 0))
                        from ok o where o.source = 'graph' and o.query_id = m.query_id and o.fact_key = m.fact_key), 0) as graph
  from masses m left join rates r using (query_id)
)"""


@query(f"with {_POOL} select query_id, fact_key, round(text, 4) as text, round(vector, 4) as vector, round(mass, 4) as mass, round(graph, 4) as graph, round(mass + graph, 4) as relevance from pool")
def excess_scores(spark, d):
    p = scoring.scored(_pool(spark, d), "excess")
    return p.select("query_id", "fact_key", *(F.round(c, 4).alias(c) for c in ("text", "vector", "mass", "graph", "relevance")))


@query(f"""with {_POOL},
s as (select query_id, count(*) as n, avg(text) as mt, stddev_pop(text) as st, avg(vector) as mv, stddev_pop(vector) as sv, avg(graph) as mg, stddev_pop(graph) as sg from pool group by all),
z as (
  select p.*, n, st, sv, sg, case when text > 0 and st > 0 then greatest((text - mt) / st, 0) else 0 end as zt,
    case when vector > 0 and sv > 0 then greatest((vector - mv) / sv, 0) else 0 end as zv, case when graph > 0 and sg > 0 then greatest((graph - mg) / sg, 0) else 0 end as zg
  from pool p join s using (query_id)
)
select query_id, fact_key, round(case when st <= 0 and sv <= 0 and sg <= 0 then mass else (1 + zt) * pow(1 + zv, case when zv > sqrt(2 * ln(n)) then 2 - held else 1 end) + zg end, 4) as relevance from z""")
def information_scores(spark, d):
    return scoring.scored(_pool(spark, d), "information").select("query_id", "fact_key", F.round("relevance", 4).alias("relevance"))


@query("""select query_id, fact_key, round(sum(1 / (60 + list_rank)), 6) as relevance from (select distinct * from contributions)
where score is not null and not isnan(score) group by all""")
def rrf_scores(spark, d):
    return scoring.scored(_pool(spark, d), "rrf").select("query_id", "fact_key", F.round("relevance", 6).alias("relevance"))


@query(f"with {_FACTS} select graph_id, fact_key, round(pow(0.5, greatest(0, (1735689600000000 - epoch_us(written_at)) / 1e6) / {HALF_LIFE}), 6) as decay from facts")
def recency_decay(spark, d):
    return _facts(spark, d).select("graph_id", "fact_key", F.round(clocks.decayed(F.lit(1.0), F.col("written_at"), F.lit(NOW), HALF_LIFE), 6).alias("decay"))


_S, _U = "timestamptz '2024-02-01 00:00:00+00'", "timestamptz '2024-06-01 00:00:00+00'"
_CLOCKED = f"""{_FACTS},
good as (select *, [i for i in coalesce(occurred, []) if i.start_at is not null and (i.end_at is null or i.end_at >= i.start_at)] as spans, coalesce(said_at, written_at) as said from facts),
timed as (select *, case when len(spans) > 0 then spans else [{{'start_at': said, 'end_at': said}}] end as happened from good)"""
_SIN = "(i.end_at is null or (i.end_at = i.start_at and {s} <= i.start_at) or (i.end_at > i.start_at and {s} < i.end_at))".format(s=_S)


@query(f"with {_CLOCKED} select graph_id, fact_key from timed where len([i for i in happened if {_SIN} and i.start_at < {_U}]) > 0")
def window_happened(spark, d):
    return _facts(spark, d).where(clocks.in_window(F.lit(SINCE), F.lit(UNTIL))).select("graph_id", "fact_key")


@query(f"with {_CLOCKED} select graph_id, fact_key from timed where said >= {_S} and written_at < {_U}")
def window_two_clocks(spark, d):
    return _facts(spark, d).where(clocks.in_window(F.lit(SINCE), F.lit(UNTIL), "said", "written")).select("graph_id", "fact_key")


@query(f"""with {_CLOCKED}, spans1 as (select graph_id, unnest(happened) as i from timed)
select graph_id, epoch_us(min(i.start_at)) as start_us, case when bool_or(i.end_at is null) then null else epoch_us(max(i.end_at)) end as end_us from spans1 group by all""")
def when_hull(spark, d):
    h = answers.hull(_facts(spark, d), "happened", "graph_id")
    return h.select("graph_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"))


def _times_sql(clock: str) -> str:
    return f"""(select {{k}}, epoch_us(min(i.start_at)) as {clock}_start,
      case when bool_or(i.end_at is null) then null when count(distinct (i.start_at, i.end_at)) = 1 then max(epoch_us(i.end_at))
           else max(epoch_us(i.end_at) + case when i.end_at = i.start_at then 1 else 0 end) end as {clock}_end
      from (select {{k}}, unnest({clock}_i) as i from rows1) group by all)"""


def _catalogue_sql(keys: str, rows: str) -> str:
    joins = " ".join(f"join {_times_sql(c).format(k=keys)} {c} using ({keys})" for c in clocks.CLOCKS)
    return f"""with {_CLOCKED}, {_EDGES},
rows1 as (select {keys}, fact_key, happened as happened_i, [{{'start_at': said, 'end_at': said}}] as said_i, [{{'start_at': written_at, 'end_at': written_at}}] as written_i from {rows}),
counts as (select {keys}, count(*) as facts from rows1 group by all)
select * from counts {joins}"""


def _micros(df: DataFrame) -> DataFrame:
    return df.select(*(F.unix_micros(c).alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes))


@query(_catalogue_sql("graph_id", "timed"))
def describe_graphs(spark, d):
    return _micros(answers.catalogue(_facts(spark, d), None, "graph_id"))


@query(_catalogue_sql("graph_id, kind, anchor", "timed join edges using (graph_id, fact_key)"))
def describe_anchors(spark, d):
    return _micros(answers.catalogue(_facts(spark, d), _edges(spark, d), "graph_id", "kind", "anchor"))


@query(f"with {_EDGES} select graph_id, kind, anchor, degree as facts, row_number() over (partition by graph_id, kind order by degree desc, anchor)::int as place from degrees qualify place <= 10")
def catalogue_lists(spark, d):
    return answers.listed(A.degrees(_edges(spark, d)).withColumnRenamed("degree", "facts"), ["graph_id", "kind"], "anchor", 10)


_METRICS = """
h as (select query_id, fact_key, row_number() over (partition by query_id order by s desc, fact_key) as place from (select query_id, fact_key, max(score) as s from hits group by all)),
r as (select distinct query_id, fact_key from hits where seed),
j as (select coalesce(h.query_id, r.query_id) as query_id, h.place, r.fact_key as rel from (select * from h where place <= 10) h full join r using (query_id, fact_key)),
m as (select query_id, count(place) as got, count(rel) as want, count(rel) filter (place is not null) as hit, max(case when rel is not null then 1 else 0 end) filter (place = 1) as first from j group by all)"""


def _metrics(spark, d):
    rows = table(spark, d, "hits", "query_id", "fact_key", "score", "seed")
    best = rows.groupBy("query_id", "fact_key").agg(F.max("score").alias("s"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "fact_key")))
    return answers.retrieval_metrics(placed, rows.where("seed"), "query_id", "fact_key", "place", 10)


@query(f"with {_METRICS} select query_id, round(hit / want, 6) as recall, coalesce(first, 0)::double as precision_at_1, round(2 * hit / (got + want), 6) as f1 from m where want > 0")
def retrieval_metrics(spark, d):
    return _metrics(spark, d).select("query_id", F.round("recall", 6).alias("recall"), "precision_at_1", F.round("f1", 6).alias("f1"))


@query(f"""with {_METRICS}, x as (select (query_id % 5)::int as category, hit / want as recall, 2 * hit / (got + want) as f1 from m where want > 0)
select category, count(*) as queries, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from x group by rollup (category)""")
def macro_averages(spark, d):
    rows = _metrics(spark, d).withColumn("category", (F.col("query_id") % 5).cast("int"))
    return answers.macro_average(rows, "category", "recall", "f1").select("category", "queries", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("""select query_id, fact_key, row_number() over (partition by query_id order by s desc, w desc, fact_key)::int as place
from (select query_id, fact_key, max(score) as s, max(written_at) as w from hits group by all) qualify place <= 10""")
def top_hits(spark, d):
    best = table(spark, d, "hits").groupBy("query_id", "fact_key").agg(F.max("score").alias("s"), F.max("written_at").alias("w"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), F.col("w").desc(), "fact_key")
    return best.withColumn("place", F.row_number().over(w)).where("place <= 10").select("query_id", "fact_key", "place")


@query(f"""with {_FACTS} select distinct h.graph_id, h.fact_key from hits h anti join facts f on h.graph_id = f.graph_id and h.fact_key = f.fact_key
union all select graph_id, fact_key from facts""")
def insert_if_absent(spark, d):
    keys = ["graph_id", "fact_key"]
    return ingest.insert_if_absent(_facts(spark, d).select(*keys), table(spark, d, "hits").select(*keys), keys)


def _vectors(spark, d):
    """The latest good vector of each fact."""
    e = F.col("embedding")
    good = table(spark, d, "vectors").where((F.size(e) == 64) & F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("fact_key").isNotNull())
    return good.groupBy("graph_id", "fact_key").agg(F.max_by("embedding", "vec_id").alias("embedding"))


@query(f"""with {_SEQ}, {_TOKENS[_TOKENS.index("words as"):]}, gone as (select distinct graph_id, fact_key from hits),
left_facts as (select * from facts anti join gone using (graph_id, fact_key)), left_edges as (select * from edges anti join gone using (graph_id, fact_key)),
seq2 as (
  select graph_id, fact_key, lag(fact_key) over w as before, lead(fact_key) over w as after from left_edges join left_facts using (graph_id, fact_key)
  window w as (partition by graph_id, kind, anchor order by written_at, fact_key::hugeint + case when fact_key < 0 then 18446744073709551616::hugeint else 0 end)
),
vecs as (select distinct graph_id, fact_key from vectors where {_OKVEC} and fact_key is not null)
select 'fact' as kind, graph_id, count(*) as n from left_facts group by all
union all select 'edge', graph_id, count(*) from left_edges group by all
union all select 'posting', graph_id, count(*) from posts anti join gone using (graph_id, fact_key) group by all
union all select 'length', graph_id, count(*) from lens anti join gone using (graph_id, fact_key) group by all
union all select 'vector', graph_id, count(*) from vecs anti join gone using (graph_id, fact_key) group by all
union all select 'neighbour', graph_id, count(*) from (select distinct graph_id, fact_key, x from (select graph_id, fact_key, before as x from seq2 union all select graph_id, fact_key, after from seq2) where x is not null) group by all""")
def cascade_delete(spark, d):
    """The memory without the facts that were hit: facts, edges, index entries, vectors, and the order around them."""
    gone = table(spark, d, "hits").select("graph_id", "fact_key").distinct()
    left = ingest.delete_facts(ingest.memory_of(_log(spark, d), _vectors(spark, d), stemming=False), gone)
    parts = (("fact", left.facts), ("edge", left.edges), ("posting", left.postings), ("length", left.lengths), ("vector", left.vectors), ("neighbour", left.neighbours))
    counts = [t.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "graph_id", "n") for k, t in parts]
    return reduce(DataFrame.unionAll, counts)


@query(f"""with {_FACTS}, h as (select graph_id, fact_key, value, written_at from hits where fact_key is not null and value is not null
  qualify row_number() over (partition by graph_id, fact_key order by logged_at desc nulls last, hit_id desc) = 1)
select graph_id, fact_key, value, epoch_us(written_at) as written_us from h
union all select graph_id, fact_key, value, epoch_us(written_at) from facts anti join h using (graph_id, fact_key)""")
def upsert_facts(spark, d):
    """Facts replaced by what the last hit says of them."""
    keys = ["graph_id", "fact_key"]
    rows = table(spark, d, "hits", *keys, "value", "written_at", "logged_at", "hit_id").where("fact_key is not null and value is not null")
    new = ingest.latest(rows, keys, F.col("logged_at"), F.col("hit_id")).select(*keys, "value", "written_at")
    return ingest.upsert(_facts(spark, d).select(*new.columns), new, keys).select(*keys, "value", F.unix_micros("written_at").alias("written_us"))


@query(f"""with {_FACTS}, {_EDGES}, v as (select distinct graph_id, fact_key from vectors where {_OKVEC} and fact_key is not null)
select g::smallint as graph_id, f + a as "order", e as size, f + a + e as nodes, n as vectors, n as forest_entries, 'bm25' as relevance from (
  select g, (select count(*) from facts where graph_id = g) as f, (select count(*) from degrees where graph_id = g) as a,
    (select count(*) from edges where graph_id = g) as e, (select count(*) from v where graph_id = g) as n from range(32) t(g))""")
def graph_sizes(spark, d):
    f, e = _facts(spark, d), _edges(spark, d)
    return ingest.sizes(ingest.Memory(f, e, f, f, f, _vectors(spark, d)), 32)


@query(f"select vec_id from (select distinct vec_id, embedding from vectors where {_OKVEC}) where list_bool_and([x >= -0.75 and x <= 0.75 for x in embedding])")
def vectors_in_box(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "vectors").where((F.size(e) == 64) & F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", "embedding").distinct()
    side = lambda x: F.array_repeat(F.lit(x), 64)
    return rows.where(vectors.in_box(e, side(-0.75), side(0.75))).select("vec_id")


_WIDTH = "case when date_trunc('year', s) = s and date_trunc('year', e) = e then 4 when date_trunc('month', s) = s and date_trunc('month', e) = e then 7 else 10 end"
_FIRST, _LAST = f"left(strftime(s, '%Y-%m-%d'), {_WIDTH})", f"left(strftime(e - interval 1 microsecond, '%Y-%m-%d'), {_WIDTH})"
_SPAN = f"""case when e is null then strftime(s, '%Y-%m-%d') || '..' when e <= s then strftime(s, '%Y-%m-%d')
  when {_FIRST} = {_LAST} then {_FIRST} else {_FIRST} || '..' || {_LAST} end"""


@query(f"""with i as (select distinct unnest(occurred) as i from hits), t as (
  select i.start_at at time zone 'UTC' as s, i.end_at at time zone 'UTC' as e from i where i.start_at is not null
  union all select make_timestamp(y, 1, 1, 0, 0, 0), make_timestamp(y + k, 1 + m, 1, 0, 0, 0) from range(2019, 2024) a(y), range(3) b(k), range(2) c(m))
select distinct epoch_us(s) as start_us, epoch_us(e) as end_us, {_SPAN} as span from t""")
def spans_rendered(spark, d):
    """Times in the widest unit that loses nothing, those of the hits and whole years and months."""
    spans = table(spark, d, "hits", "occurred").select(F.explode("occurred").alias("i")).select("i.start_at", "i.end_at").where("start_at is not null")
    whole = [(datetime(y, 1, 1, tzinfo=timezone.utc), datetime(y + k, 1 + m, 1, tzinfo=timezone.utc)) for y in range(2019, 2024) for k in range(3) for m in range(2)]
    rows = spans.unionAll(spark.createDataFrame(whole, "start_at timestamp, end_at timestamp")).distinct()
    return rows.select(F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), render.span(F.col("start_at"), F.col("end_at")).alias("span"))


@query(f"""with h as (select distinct hit_id, value, score, (coalesce(said_at, written_at) at time zone 'UTC') as said, occurred from hits where value is not null and score is not null),
o as (select hit_id, string_agg({_SPAN}, ' and ' order by n) as happened from (
  select hit_id, (i.start_at at time zone 'UTC') as s, (i.end_at at time zone 'UTC') as e, n from (select hit_id, unnest(occurred) as i, unnest(range(len(occurred))) as n from h)) where s is not null group by all)
select h.hit_id, '- [' || case when o.happened is not null and o.happened <> strftime(said, '%Y-%m-%d') then 'said ' || strftime(said, '%Y-%m-%d') || ', happened ' || o.happened else strftime(said, '%Y-%m-%d') end
  || '] ' || value || ' (relevance ' || printf('%.3f', floor(score * 100) / 100) || ')' as line from h left join o using (hit_id)""")
def hit_lines(spark, d):
    """Hits as lines of text."""
    rows = table(spark, d, "hits", "hit_id", "value", "score", "written_at", "said_at", "occurred").where("value is not null and score is not null").distinct()
    return rows.withColumn("score", F.floor(F.col("score") * 100) / 100).select("hit_id", render.hit_line().alias("line"))


@query("""select distinct hit_id, json_merge_patch('{}', json_object('value', value, 'said', epoch_us(said_at), 'written', epoch_us(written_at), 'seed', seed))::varchar as hit from hits""")
def hits_as_json(spark, d):
    """Hits in the form that goes over the wire, without what they lack."""
    parts = F.struct("value", F.unix_micros("said_at").alias("said"), F.unix_micros("written_at").alias("written"), "seed")
    return table(spark, d, "hits").select("hit_id", F.to_json(parts).alias("hit")).distinct()


@query("""select doc_id, md5(replace(author || ': ' || coalesce(text, '') || case when trim(coalesce(source, '')) <> '' then ' [shared image: ' || source || ']' else '' end, chr(39), chr(8217))) as value,
  'conv-' || lower(repo) as conversation, 'session-' || files_changed as session, lower(trim(regexp_replace(author, '[^A-Za-z0-9]+', '-', 'g'), '-')) as speaker, epoch_us(committed_at) as said_us
from documents where author is not null and repo is not null""")
def turns_remembered(spark, d):
    """Documents read as the turns of conversations, filed as facts."""
    turns = table(spark, d, "documents").select(
        F.col("repo").alias("conversation"), F.col("files_changed").alias("session"), F.col("doc_id").alias("turn"), F.col("author").alias("speaker"), "text", F.col("source").alias("caption"), F.col("committed_at").alias("session_at")
    )
    rows = evaluation.turns_to_remember(turns)
    return rows.select(F.col("turn").alias("doc_id"), F.md5("value").alias("value"), F.col("topics")[0].alias("conversation"), F.col("topics")[1].alias("session"), F.col("entities")[0].alias("speaker"), F.unix_micros("said_at").alias("said_us"))


@query("""select item_id as query_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ') as words, 'conv-' || (item_id % 7) as topic, 10::int as top
from (select distinct item_id, text from eval_items) where item_id % 5 <> 0""")
def questions_asked(spark, d):
    """Test items read as questions about conversations; those whose evidence names no turn are left out."""
    item = F.col("item_id")
    some = F.when(item % 5 == 0, F.array(F.lit("D:11:26"), F.lit("none"))).otherwise(F.array(F.concat(F.lit("D1:"), item.cast("string"), F.lit("; D9:17"))))
    asked = table(spark, d, "eval_items").select(item.alias("question_id"), (item % 7).cast("string").alias("conversation"), F.col("text").alias("question"), some.alias("evidence")).distinct()
    rows = [(r.query_id, " ".join(r.keywords), r.topics[0], r.top) for r in evaluation.questions_to_recalls(asked)]
    return spark.createDataFrame(rows, "query_id bigint, words string, topic string, top int")


@query("select distinct question_id, unnest(regexp_extract_all('D8:' || question_id || '; D9:17 D:11:26', 'D[0-9]+:[0-9]+')) as turn from (select item_id as question_id from eval_items)")
def evidence_turns(spark, d):
    """Turn ids in evidence strings, several to a string or malformed."""
    rows = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), F.array(F.concat(F.lit("D8:"), F.col("item_id").cast("string"), F.lit("; D9:17 D:11:26"))).alias("evidence"))
    return evaluation.evidence(rows)


def _averages_sql(most: int) -> str:
    return f"(with {_METRICS.replace('place <= 10', f'place <= {most}')} select c as category, avg(hit / want) as recall, avg(2 * hit / (got + want)) as f1 from (select *, (query_id % 5)::int as c from m where want > 0) group by rollup (c))"


@query(f"""with l as (
  select a.category, unnest(['recall', 'f1']) as metric, unnest([a.recall, a.f1]) as base, unnest([b.recall, b.f1]) as head
  from {_averages_sql(10)} a join {_averages_sql(3)} b on a.category is not distinct from b.category)
select category, metric, round(base, 6) as base, round(head, 6) as head from l where round(base - head, 12) > 0.001""")
def metric_gate(spark, d):
    """What the gate stops when only three hits are read instead of ten."""
    rows = table(spark, d, "hits", "query_id", "fact_key", "score", "seed")
    best = rows.groupBy("query_id", "fact_key").agg(F.max("score").alias("s"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "fact_key")))

    def average(k: int) -> DataFrame:
        per = answers.retrieval_metrics(placed, rows.where("seed"), "query_id", "fact_key", "place", k).withColumn("category", (F.col("query_id") % 5).cast("int"))
        return answers.macro_average(per, "category", "recall", "f1")

    found = evaluation.dropped(average(10), average(3), ["category"], ["recall", "f1"])
    return found.select("category", "metric", F.round("base", 6).alias("base"), F.round("head", 6).alias("head"))


@query(f"""with v as (select graph_id, fact_key, arg_max(embedding::double[], vec_id) as e from vectors where {_OKVEC} and fact_key is not null group by all)
select a.graph_id, a.fact_key, b.fact_key as other, round(list_distance(a.e, b.e), 6) as distance from v a join v b on a.graph_id = b.graph_id and a.fact_key <> b.fact_key
where a.fact_key % 100 = 0 qualify row_number() over (partition by a.graph_id, a.fact_key order by list_distance(a.e, b.e), b.fact_key) <= 10""")
def forest_nearest(spark, d):
    """Searches through the forest, so wide that the trees of graphs of a few thousand vectors are read whole; in larger graphs
    the searches go on until no leaf left out can be nearer."""
    vecs = cut(_vectors(spark, d))
    asked = vecs.where("fact_key % 100 = 0").select(F.col("fact_key").alias("query_id"), "graph_id", F.col("embedding").alias("vector"))
    found = forest.nearest(asked, vecs, forest.build(vecs, 64, trees=4), 64, k=11, overfetch=400, exact=True)
    rows = found.where("query_id <> fact_key").withColumn("n", F.row_number().over(Window.partitionBy("graph_id", "query_id").orderBy("distance", "fact_key"))).where("n <= 10")
    return rows.select("graph_id", F.col("query_id").alias("fact_key"), F.col("fact_key").alias("other"), F.round("distance", 6).alias("distance"))
