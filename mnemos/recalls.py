"""Whole recalls as queries over the test tables: batches of questions through
``plans.search``, each batch with one SQL statement that says the same."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.functions.text import query_terms
from mnemos.model import Config, Memory
from mnemos.operators import ingest
from mnemos.plans.search import LAST_RANK, Recall, search
from mnemos.queries import _CLOCKED, _SEQ, _TOKENS, NOW
from mnemos.session import there
from mnemos.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_MEMORIES: dict[tuple, Memory] = {}


def memory(spark: SparkSession, folder: str) -> Memory:
    """All graphs of the log with the latest good vector of each fact, unstemmed; kept for the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MEMORIES or not all(there(spark, f) for f in _MEMORIES[key].facts.inputFiles()):
        e = F.col("embedding")
        good = table(spark, folder, "vectors").where((F.size(e) == 64) & F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("fact_key").isNotNull())
        vecs = good.groupBy("graph_id", "fact_key").agg(F.max_by(e.cast("array<double>"), "vec_id").alias("embedding"))
        _MEMORIES[key] = ingest.memory_of(table(spark, folder, "remembers"), vecs, stemming=False).kept()
    return _MEMORIES[key]


def _time(t: datetime | None) -> str:
    return "null::timestamptz" if t is None else f"timestamptz '{t.astimezone(timezone.utc):%Y-%m-%d %H:%M:%S}+00'"


def _rows(name: str, columns: str, rows: Sequence[tuple]) -> str:
    """A table of literals; with no rows an empty one."""
    kinds = [c.strip().split(" ") for c in columns.split(",")]

    def lit(v, kind: str) -> str:
        if kind == "timestamptz":
            return _time(v)
        text = "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        return f"{text}::{kind}"

    picks = [", ".join(f"{lit(v, k)} as {n}" for v, (n, k) in zip(r, kinds)) for r in rows]
    none = ", ".join(f"null::{k} as {n}" for n, k in kinds)
    return f"{name} as (" + (" union all ".join(f"select {p}" for p in picks) if rows else f"select {none} where false") + ")"


def _clocked(clock: str) -> str:
    return f"case {clock} when 'happened' then happened when 'said' then [{{'start_at': said, 'end_at': said}}] else [{{'start_at': written_at, 'end_at': written_at}}] end"


_REACH = "(since is null or i.end_at is null or (i.end_at = i.start_at and since <= i.start_at) or (i.end_at > i.start_at and since < i.end_at))"
_BEFORE = "(until is null or i.start_at < until)"
_UNSIGNED = "fact_key::hugeint + case when fact_key < 0 then 18446744073709551616::hugeint else 0 end"


_HITS = """select k.query_id, row_number() over (partition by k.query_id order by k.place)::int as place, k.graph_id, k.fact_key, round(k.score, 6) as score, k.alone or s.fact_key is not null as seed
from kept k left join seeds s using (query_id, graph_id, fact_key)"""


def recall_sql(recalls: Sequence[Recall], config: Config, select: str = _HITS) -> str:
    """The hits of a batch in SQL (query_id, place, graph_id, fact_key, score, seed), or what else ``select`` takes from its steps."""
    q = [(r.query_id, r.graph_id, r.lanes, r.top, max(config.seed_size, r.top), r.since, r.until, r.since_clock, r.until_clock, r.alone, r.anchored and not r.alone and r.lanes >= 1 and config.traversal != "none", bool(r.vector and r.keywords)) for r in recalls]
    terms = [(r.query_id, r.graph_id, t) for r in recalls for t in query_terms(" ".join(r.keywords), False)]
    named = sorted({(r.query_id, r.graph_id, k, v) for r in recalls for k, vs in (("topic", r.topics), ("entity", r.entities)) for v in vs})
    vecs = [(r.query_id, r.graph_id, str([float(x) for x in r.vector])) for r in recalls if r.vector]
    gamma, bm25 = max(config.window_gamma, 0.0), config.relevance == "bm25"
    half = f"pow(0.5, greatest(0, ({int(NOW.timestamp())}000000 - epoch_us(written_at)) / 1e6) / {config.half_life_s})" if config.half_life_s > 0 else "1"
    weight = "ln(1 + (docs - df + 0.5) / (df + 0.5))" if bm25 else "times::double"
    gained = "sum(weight * tf * 2.2 / (tf + 0.3 + 0.9 / avgdl * l.len))" if bm25 else "sum(least(tf, 1.0) * weight)"
    score = "gained * floor(matched * 1024) / (floor(known * 1024) + 1)" if bm25 else "gained"
    funding = "arg_min(mass, u) as mass, 1" if config.traversal == "bfs" else "sum(mass) as mass, count(*)"
    first_way = "qualify row_number() over (partition by query_id, graph_id, fact_key order by kind, anchor) = 1" if config.traversal == "bfs" else ""
    relevance = {
        "information": "case when st <= 0 and sv <= 0 and sg <= 0 then mass else (1 + zt) * pow(1 + zv, case when zv > sqrt(2 * ln(n)) then 2 - held else 1 end) + zg end",
        "excess": "mass + graph",
        "rrf": "rrf",
    }[config.scorer]
    z = ", ".join(f"case when {c} > 0 and s{c[0]} > 0 then greatest(({c} - m{c[0]}) / s{c[0]}, 0) else 0 end as z{c[0]}" for c in ("text", "vector", "graph"))
    return f"""with {_SEQ}, {_TOKENS[_TOKENS.index("words as") :]}, {_CLOCKED[_CLOCKED.index("good as") :]},
{_rows("q", "query_id bigint, graph_id smallint, depth int, top int, seed_k int, since timestamptz, until timestamptz, sclock varchar, uclock varchar, alone boolean, walking boolean, mixed boolean", q)},
{_rows("qterm", "query_id bigint, graph_id smallint, term varchar", terms)},
{_rows("named", "query_id bigint, graph_id smallint, kind varchar, anchor varchar", named)},
{_rows("qvec", "query_id bigint, graph_id smallint, vec double[]", vecs)},
inside as (
  select query_id, graph_id, fact_key from (select q.*, t.fact_key, {_clocked("sclock")} as sl, {_clocked("uclock")} as ul from q join timed t using (graph_id))
  where case when sclock = uclock then len([i for i in sl if {_REACH} and {_BEFORE}]) > 0
             else len([i for i in sl if {_REACH}]) > 0 and len([i for i in ul if {_BEFORE}]) > 0 end or (since is null and until is null)
),
filed as (select distinct query_id, graph_id, fact_key from named join edges using (graph_id, kind, anchor)),
reads as (select *, 0 as reading from inside union all select *, 1 from inside semi join filed using (query_id, graph_id, fact_key)),
asked as (select query_id, graph_id, term, count(*) as times from qterm group by all),
dfs as (select graph_id, term, count(*) as df from posts group by all),
weighted as (
  select query_id, graph_id, term, df, docs, avgdl, {weight} as weight, -log2(df / docs) as bits from asked join dfs using (graph_id, term) join corpus using (graph_id)
),
known as (select query_id, sum(weight) as known, sum(bits) as total from weighted group by all),
found as (select query_id, graph_id, term, fact_key, tf from weighted join posts using (graph_id, term)),
own as (select query_id, reading, graph_id, term, fact_key, tf::double as tf from found join reads using (query_id, graph_id, fact_key)),
lent as (
  select query_id, reading, graph_id, term, fact_key, sum(tf) as tf from (
    select * from own
    union all select query_id, reading, o.graph_id, term, neighbour, tf * {gamma}::double from own o join near n on o.graph_id = n.graph_id and o.fact_key = n.fact_key where {gamma} > 0)
  semi join reads using (query_id, reading, graph_id, fact_key) group by all
),
docs2 as (select distinct query_id, reading, graph_id, fact_key from lent),
longer as (
  select d.query_id, d.reading, d.graph_id, d.fact_key, any_value(l.len) + {gamma}::double * coalesce(sum(o.len) filter (r.fact_key is not null), 0) as len
  from docs2 d join lens l using (graph_id, fact_key) left join near n on n.graph_id = d.graph_id and n.fact_key = d.fact_key
  left join lens o on o.graph_id = n.graph_id and o.fact_key = n.neighbour
  left join reads r on r.query_id = d.query_id and r.reading = d.reading and r.graph_id = d.graph_id and r.fact_key = n.neighbour
  group by all
),
gains as (
  select query_id, reading, graph_id, fact_key, {gained} as gained, sum(weight) as matched
  from lent join weighted using (query_id, graph_id, term) join longer l using (query_id, reading, graph_id, fact_key) group by all
),
texts as (select query_id, reading, graph_id, fact_key, {score} as score from gains join known using (query_id)),
vecs as (
  select graph_id, fact_key, arg_max(embedding::double[], vec_id) as e from vectors
  where len(embedding) = 64 and list_bool_and([isfinite(x) for x in embedding]) and fact_key is not null group by all
),
nears as (select query_id, reading, graph_id, fact_key, list_distance(e, vec) as d from qvec join vecs using (graph_id) join reads using (query_id, graph_id, fact_key)),
lists as (
  select 'text' as source, query_id, reading, graph_id, fact_key, score, row_number() over (partition by query_id, reading order by round(score, 9) desc, {_UNSIGNED}) - 1 as place from texts
  union all
  select 'vector', query_id, reading, graph_id, fact_key, 1 / (1 + d), row_number() over (partition by query_id, reading order by round(-d, 9) desc, {_UNSIGNED}) - 1 from nears
),
seeds as (select distinct query_id, graph_id, fact_key from lists join q using (query_id, graph_id) where place < seed_k),
holds as (select query_id, fact_key, sum(bits) as held from found join weighted using (query_id, graph_id, term) group by all),
missed as (
  select query_id, (total - held) / held as missed from lists join q using (query_id, graph_id) join holds using (query_id, fact_key) join known using (query_id)
  where source = 'text' and reading = 0 and place = 0 and mixed and held > 0
),
seen as (
  select query_id, graph_id, fact_key, source, score, least(place, {LAST_RANK}) as place, case when source = 'text' and total > 0 then held / total end as held, 0 as degree, false as named
  from lists left join holds using (query_id, fact_key) left join known using (query_id) where reading = 0
  union all select query_id, graph_id, fact_key, 'anchor', 1, 0, null, 0, false from named join edges using (graph_id, kind, anchor) join q using (query_id, graph_id) where alone
),
masses as (
  select query_id, graph_id, fact_key, coalesce(sum(score) filter (source = 'text'), 0) as text, coalesce(sum(score) filter (source = 'vector'), 0) as vector,
    coalesce(sum(score) filter (source = 'anchor'), 0) as anchor, any_value(missed) as missed
  from seen left join missed using (query_id) group by all
),
funded as (select query_id, graph_id, fact_key, text + (1 + coalesce(missed, 0)) * vector + anchor as mass, {_UNSIGNED} as u from masses semi join seeds using (query_id, graph_id, fact_key) semi join (select query_id from q where walking) using (query_id)),
observed as (select query_id, graph_id, kind, anchor, {funding} as seeds, any_value(degree) as degree from funded join edges using (graph_id, fact_key) join degrees using (graph_id, kind, anchor) group by query_id, graph_id, kind, anchor),
rates as (select query_id, sum(mass) as m, sum(degree)::bigint as d, sum(mass) / sum(degree) as rate from observed group by all),
opened as (
  select o.*, n.anchor is not null as named from observed o join rates using (query_id) join q using (query_id, graph_id) left join named n using (query_id, graph_id, kind, anchor)
  where n.anchor is not null or o.mass * d > o.degree * m * case when depth = 1 then 2 else 1 end * (1 + 1e-12)
),
more as (select * from opened join edges using (graph_id, kind, anchor) {first_way}),
all_seen as (select query_id, graph_id, fact_key, source, score, place, held, degree, named from seen union all select query_id, graph_id, fact_key, 'graph', mass, 0, null, degree, named from more),
sums as (
  select query_id, graph_id, fact_key, coalesce(sum(score) filter (source = 'text'), 0) as text, coalesce(sum(score) filter (source = 'vector'), 0) as vector,
    coalesce(sum(score) filter (source = 'anchor'), 0) as anchor, coalesce(max(held) filter (source = 'text'), 0) as held, sum(1 / (60 + place)) as rrf
  from all_seen semi join inside using (query_id, graph_id, fact_key) group by all
),
folded as (select s.*, text + (1 + coalesce(missed, 0)) * vector + anchor as mass, coalesce(rate, 0) as rate from sums s left join missed using (query_id) left join rates using (query_id)),
graphs as (
  select f.query_id, f.graph_id, f.fact_key, sum(greatest((a.score - f.mass - case when a.named then 0 else greatest(a.degree, 1) * f.rate end) / greatest(a.degree, 1), 0)) as graph
  from folded f join all_seen a using (query_id, graph_id, fact_key) where a.source = 'graph' group by all
),
pool as (select f.*, coalesce(graph, 0) as graph from folded f left join graphs using (query_id, graph_id, fact_key)),
stats as (select query_id, count(*) as n, avg(text) as mt, stddev_pop(text) as st, avg(vector) as mv, stddev_pop(vector) as sv, avg(graph) as mg, stddev_pop(graph) as sg from pool group by all),
zs as (select *, {z} from pool join stats using (query_id)),
fin as (
  select query_id, graph_id, fact_key, {relevance} as relevance, relevance * {half} as score, list_max([i.start_at for i in happened]) as last, top, alone
  from zs join timed using (graph_id, fact_key) join q using (query_id, graph_id)
),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, last desc, {_UNSIGNED}) as place from fin qualify top <= 0 or place <= top),
kept as (select * from ranked qualify relevance >= {config.min_score_ratio} * max(relevance) over (partition by query_id))
{select}"""


def _batch(name: str, doc: str, recalls: Sequence[Recall], **config) -> None:
    """Registers a batch; the questions are numbered in order."""
    asked = [replace(r, query_id=i) for i, r in enumerate(recalls, 1)]
    settings = Config(stemming=False, **config)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = search(memory(spark, folder), asked, settings, NOW, ranks=False).hits
        return hits.select("query_id", "place", "graph_id", "fact_key", F.round("score", 6).alias("score"), "seed")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], ORACLE[name] = run, recall_sql(asked, settings)


def _at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


_WAVE = tuple(round(math.sin(i * 1.7) / 8, 4) for i in range(64))
_STEP = tuple(round(math.cos(i * 0.9) / 8, 4) for i in range(64))
_LEDGER, _KETTLE = ("harbour", "ledger"), ("frozen kettle",)
_WALKS = [
    Recall(_LEDGER, topics=("general",), graph_id=3, depth=1), Recall(_KETTLE, topics=("field-notes", "moorings"), graph_id=3, depth=2), Recall(("invoice",), entities=("theodore jevibonuberg",), graph_id=3),
    Recall(("window", "bridge", "the"), topics=("general", "unheard of"), graph_id=8, depth=2, top=25), Recall(("lantern",), topics=("freight",), graph_id=13, depth=1, top=3),
]

_batch("recall_text", "The flagship: three questions to every graph.", [Recall(w, graph_id=g) for g in range(24) for w in (_LEDGER, ("frozen", "kettle", "unheardof"), ("orchard", "the", "ledger", "ledger"))], window_gamma=-1.0)
_batch("recall_full", "Terms, vector, anchors, depth and window in one question each.", [
    Recall(_LEDGER, _WAVE, ("general",), ("theodore jevibonuberg",), 3, 2, 20, _at("2019-06-01"), _at("2024-01-01")), Recall(("kettle", "ticket"), _STEP, ("general", "freight"), graph_id=8, depth=1, since=_at("2020-01-01"), since_clock="said", until_clock="said"),
])
_batch("recall_lent", "Terms alone, with the lending window.", [Recall(_LEDGER, graph_id=g) for g in range(24)] + [Recall(("orchard", "the", "ledger", "ledger"), graph_id=3, top=200), Recall(("unheardof",), graph_id=3)])
_batch("recall_unlent", "Terms alone, without it, the relevance as it is.", [Recall(_KETTLE, graph_id=g) for g in range(24)], window_gamma=-1.0, half_life_s=-1.0)
_batch("recall_matchcount", "Relevance by counted matches.", [Recall(_LEDGER, graph_id=g) for g in (3, 4, 8)] + [Recall(("window", "window", "ticket"), graph_id=3)], relevance="matchcount")
_batch("recall_anchored", "Terms beside anchors, at depth 1 and 2: both readings, the background, the excess.", _WALKS)
_batch("recall_bfs", "The breadth-first traversal.", _WALKS, traversal="bfs")
_batch("recall_unwalked", "No traversal.", _WALKS, traversal="none")
_batch("recall_alone", "Anchors alone seed the search.", [Recall(topics=("general", "freight"), graph_id=3, top=40), Recall(entities=("theodore jevibonuberg", "nobody at all"), graph_id=3), Recall(topics=("orchards",), graph_id=3, depth=2, since=_at("2021-01-01"))])
_batch("recall_vector", "Vectors alone, beside terms, and beside anchors.", [
    Recall((), _WAVE, graph_id=3), Recall(_LEDGER, _STEP, graph_id=3), Recall(_KETTLE, _WAVE, topics=("general",), graph_id=3), Recall(("kettle", "invoice", "ticket"), _STEP, graph_id=8, depth=2, topics=("general",), top=5),
    Recall((), _STEP, entities=("anthony kagucypyford",), graph_id=3, depth=2),
])
_batch("recall_windowed", "Windows on one clock and on two, with and without lending and anchors.", [
    Recall(_LEDGER, graph_id=3, since=_at("2020-06-01"), until=_at("2023-01-01")), Recall(_LEDGER, graph_id=3, since=_at("2021-01-01"), since_clock="said", until_clock="said", topics=("general",)),
    Recall(("kettle",), graph_id=3, until=_at("2022-01-01"), since=_at("2019-01-01"), since_clock="said", until_clock="written", depth=2, topics=("general",)), Recall(("ledger",), _WAVE, graph_id=8, until=_at("2021-01-01"), until_clock="written", since_clock="written"),
])
_batch("recall_excess", "The fold by mass and excess.", _WALKS + [Recall(_LEDGER, _STEP, graph_id=3)], scorer="excess")
_batch("recall_rrf", "The fold by reciprocal ranks.", _WALKS + [Recall(_LEDGER, _STEP, graph_id=3)], scorer="rrf")
_batch("recall_cutoff", "Hits under a share of the best relevance are left out.", _WALKS + [Recall(_LEDGER, graph_id=3, top=100)], min_score_ratio=0.4)


# what explains a batch

_EXPLAINED = [replace(r, query_id=i) for i, r in enumerate([*_WALKS, Recall(_LEDGER, _STEP, graph_id=3, top=3), Recall(("kettle", "invoice", "ticket"), _STEP, graph_id=8, depth=2, topics=("general",), top=5), Recall(topics=("general", "freight"), graph_id=3)], 1)]
_PLAIN = Config(stemming=False)


def _explained(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = lambda spark, folder: f(search(memory(spark, folder), _EXPLAINED, _PLAIN, NOW)), recall_sql(_EXPLAINED, _PLAIN, sql)
        return f

    return add


@_explained("select query_id, source, count(distinct fact_key) as n from lists join q using (query_id, graph_id) where place < seed_k group by all")
def explain_seeds(found) -> DataFrame:
    """How many facts each source seeded: the heads of its readings."""
    return found.seeds.groupBy("query_id", "source").agg(F.count_distinct("fact_key").alias("n"))


@_explained("select query_id, round(missed, 6) as missed from missed")
def explain_missed(found) -> DataFrame:
    """What the best text lacks of a question that has a vector too."""
    return found.extra["missed"].select("query_id", F.round("missed", 6).alias("missed"))


@_explained("select query_id, round(m, 4) as total_mass, d as total_degree, round(rate, 6) as rate from rates")
def explain_background(found) -> DataFrame:
    return found.rates.select("query_id", F.round("total_mass", 4).alias("total_mass"), F.col("total_degree").cast("bigint").alias("total_degree"), F.round("rate", 6).alias("rate"))


@_explained("select query_id, fact_key, source, round(score, 6) as score, place::int as list_rank, round(held, 6) as held, case when source = 'graph' then degree end::bigint as degree, coalesce(named, false) as named from all_seen")
def explain_contributions(found) -> DataFrame:
    """What each source saw of each candidate, with its place in the source's list."""
    c = found.contributions
    return c.select("query_id", "fact_key", "source", F.round("score", 6).alias("score"), "list_rank", F.round("held", 6).alias("held"), F.when(F.col("source") == "graph", F.col("degree")).alias("degree"), "named")
