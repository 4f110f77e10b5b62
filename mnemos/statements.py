"""The query language and its verbs as queries: worked statements with what they must give,
and an engine over the test tables, compared with SQL over the same tables."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.engine import MemoryEngine
from mnemos.functions.timevalue import parse_date, parse_duration
from mnemos.model import Config
from mnemos.plans.language import ParseError, dedupe, parse, show
from mnemos.plans.search import Recall
from mnemos.queries import _CLOCKED, _EDGES, NOW
from mnemos.recalls import recall_sql
from mnemos.session import temporary, there
from mnemos.sources.store import REMEMBER
from mnemos.sources.tables import table
from mnemos.streaming.ingest import ingest_stream, written_per_window

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# statements and their canonical form, in which terms and anchors said twice count once
CANONICAL = [
    ("recall harbour  Ledger", "recall harbour Ledger"), ("recall@3 'top' topic:Billing topic:billing entity:'Anna Ray'", "recall@3 'top' entity:'anna ray' topic:billing"),
    ("recall x since:7d until:'2024-02' depth:2 top:5 topic:a", "recall x topic:a top:5 depth:2 since:7d until:'2024-02'"), ("recall a b a 'a'", "recall a b 'a'"),
    ("explain recall@2 x vec:$q", "explain recall@2 x vec:$q"), ("describe recall@1", "describe recall@1"), ("describe recall x topic:'o''brien'", "describe recall x topic:'o''brien'"),
    ("when:said regatta top:3", "when:said regatta top:3"), ("when:happened regatta", "when regatta"), ("recall x until:(when:written 'first race' topic:sea)", "recall x until:(when:written 'first race' topic:sea)"),
    ("remember@1 'it''s tea' entity:Anna topic:Kitchen said:'2024-01-02' occurred:'2023'..'2024-05' occurred:'2023-05-07T10:00:00Z'", "remember@1 'it''s tea' entity:anna topic:kitchen said:'2024-01-02' occurred:'2023'..'2024-05' occurred:'2023-05-07T10:00:00Z'"),
    ("recall x since:'2023-05'..", "recall x since:'2023-05'.."), ("recall x Topic:Sea", "recall x topic:sea"), ("recall 'new york' topic:top", "recall 'new york' topic:'top'"),
]
# statements that are rejected, and the column the error names
REJECTED = [
    ("forget 'x'", 1), ("update 'x'", 1), ("recall", 1), ("recall the and", 8), ("recall x top:3 top:4", 16), ("recall x top:-1", 14), ("recall x since:'2023-13'", 16), ("recall @3 x", 8), ("recall@300 x", 8),
    ("recall x (y)", 10), ("recall x topic:a y", 18), ("recall since 7d", 8), ("remember tea", 10), ("remember 'tea' top:3", 16), ("explain remember 'x'", 9), ("recall 'open", 8), ("recall x since:'7d'", 16), ("recall + x", 8),
]
# statements that run with warnings: how many
WARNED = [("recall x depth:2", 1), ("recall the x", 1), ("recall x topic:a depth:0", 1), ("recall the and x depth:1", 3), ("recall x TOP:3", 1), ("recall x topic:a", 0), ("recall the topic:a vec:$v", 1)]


def _goldens(rows: list[tuple], names: tuple[str, str]) -> str:
    lit = lambda v: _text(v) if isinstance(v, str) else f"{v}::int"
    return f"select * from (values {', '.join(f'({lit(a)}, {lit(b)})' for a, b in rows)}) v({', '.join(names)})"


@query(_goldens(CANONICAL, ("statement", "canonical")))
def statements_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Lexer, parser, rewriting and printer; the canonical form reads back as itself."""
    rows = []
    for text, _ in CANONICAL:
        shown = show(dedupe(parse(text)))
        rows.append((text, shown if show(dedupe(parse(shown))) == shown else "unstable"))
    return spark.createDataFrame(rows, "statement string, canonical string")


@query(_goldens(REJECTED, ("statement", "col")))
def statements_rejected(spark: SparkSession, folder: str) -> DataFrame:
    def column(text: str) -> int:
        try:
            parse(text)
        except ParseError as e:
            return e.column
        return 0

    return spark.createDataFrame([(t, column(t)) for t, _ in REJECTED], "statement string, col int")


@query(_goldens(WARNED, ("statement", "warnings")))
def statements_warned(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(t, len(parse(t).warnings)) for t, _ in WARNED], "statement string, warnings int")


DATES = ["2023", "2024-02", "2023-12", "2024-02-29", "2023-12-31", "2023-05-07T10:00:00+02:00", "2023-05-07T10:00:00.123456Z", "0001-01", "2024-02-28T23:59:59-11:30"]
DURATIONS = ["90m", "7d", "2w", "36h", "5s", "0d"]


def _resolved_sql() -> str:
    stamp = lambda d: d.ljust(10, "x").replace("xxxxxx", "-01-01").replace("xxx", "-01") if len(d) <= 10 else d
    unit = {4: "1 year", 7: "1 month", 10: "1 day"}
    days = [f"select {_text(d)} as literal, timestamptz '{stamp(d)}{' 00:00:00+00' if len(d) <= 10 else ''}' as s, interval {unit.get(len(d), '0 day')} as i" for d in DATES]
    names = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}
    now = f"timestamptz '{NOW:%Y-%m-%d %H:%M:%S}+00'"
    back = [f"select {_text(d)}, {now} - interval {int(d[:-1])} {names[d[-1]]}, interval 0 day" for d in DURATIONS]
    return f"select literal, epoch_us(s) as start_us, epoch_us((s at time zone 'UTC') + i) as end_us from ({' union all '.join(days + back)})"


@query(_resolved_sql())
def times_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Time literals resolved against a moment: days, months and years by the calendar, durations back from it."""
    micros = lambda t: (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    rows = [(x, p(x).resolve(NOW)) for p, xs in ((parse_date, DATES), (parse_duration, DURATIONS)) for x in xs]
    return spark.createDataFrame([(x, micros(i.start), micros(i.end)) for x, i in rows], "literal string, start_us bigint, end_us bigint")


# an engine over the log

_ENGINES: dict[tuple, MemoryEngine] = {}


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "remembers").where("fact_key is not null and value is not null")
    return kept.select("graph_id", "value", "topics", "entities", "said_at", "written_at", "occurred", F.lit(None).cast("array<double>").alias("vector")).distinct()


def _new_engine(spark: SparkSession) -> MemoryEngine:
    return MemoryEngine(spark, temporary(spark, "engine"), Config(num_graphs=32, stemming=False, window_gamma=-1.0), lambda: NOW)


def _engine(spark: SparkSession, folder: str) -> MemoryEngine:
    """An engine that was told the whole log; kept for the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ENGINES or not there(spark, _ENGINES[key].store.root):
        _ENGINES[key] = _new_engine(spark)
        _ENGINES[key].store.remember(_inputs(spark, folder))
    return _ENGINES[key]


_SET = Config(num_graphs=32, stemming=False, window_gamma=-1.0)
ASKED = [
    ("recall@3 harbour ledger", Recall(("harbour", "ledger"), graph_id=3)), ("recall@8 kettle topic:general depth:2 top:5", Recall(("kettle",), topics=("general",), graph_id=8, depth=2, top=5)),
    ("recall@3 entity:'theodore jevibonuberg'", Recall(entities=("theodore jevibonuberg",), graph_id=3)),
    ("explain recall@3 'ledger' since:'2021' until:'2024-02'", Recall(("ledger",), graph_id=3, since=datetime(2021, 1, 1, tzinfo=timezone.utc), until=datetime(2024, 2, 1, tzinfo=timezone.utc))),
]
_RECALLS = [replace(r, query_id=i) for i, (_, r) in enumerate(ASKED, 1)]


@query(f"select a.query_id, a.score, f.value from ({recall_sql(_RECALLS, _SET)}) a join (select distinct graph_id, fact_key, value from remembers where value is not null) f using (graph_id, fact_key)")
def engine_recalls(spark: SparkSession, folder: str) -> DataFrame:
    """Statements through the engine and its store."""
    engine, parts = _engine(spark, folder), None
    for i, (text, _) in enumerate(ASKED, 1):
        rows = engine.execute(text).rows.select(F.lit(i).cast("bigint").alias("query_id"), F.round("score", 6).alias("score"), "value")
        parts = rows if parts is None else parts.unionAll(rows)
    return parts


_WHEN = replace(_RECALLS[0], top=3)


@query(f"""with h as ({recall_sql([_WHEN], _SET)}), t as (with {_CLOCKED} select graph_id, fact_key, unnest(happened) as i from timed)
select epoch_us(min(i.start_at)) as start_us, case when bool_or(i.end_at is null) then null else epoch_us(max(i.end_at)) end as end_us from h join t using (graph_id, fact_key)""")
def engine_nested_when(spark: SparkSession, folder: str) -> DataFrame:
    """The time a when answers with, as the bound of a recall reads it: since its end, or its start while it has none."""
    a = _engine(spark, folder).execute("explain recall@3 kettle since:(when harbour ledger top:3)").explain["when"]["since"].span
    micros = lambda t: None if t is None else (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return spark.createDataFrame([(micros(a.start), micros(a.end))], "start_us bigint, end_us bigint")


@query(f"""with h as ({recall_sql([replace(_RECALLS[0], top=0)], _SET)}), e as (with {_EDGES} select * from edges),
c as (select kind, anchor, count(*) as facts from h join e using (graph_id, fact_key) group by all)
select kind, anchor, facts, row_number() over (partition by kind order by facts desc, anchor)::int as place from c qualify place <= 4""")
def engine_describe(spark: SparkSession, folder: str) -> DataFrame:
    """The anchors a describe lists: those of all the facts its recall reaches."""
    return _engine(spark, folder).execute("describe recall@3 harbour ledger top:4").rows.select("kind", "anchor", "facts", "place")


_AGAIN = f"""{_CLOCKED}, {_EDGES},
again as (select distinct graph_id, fact_key from facts where said_at is not null),
now as (select f.graph_id, f.fact_key, f.value, a.fact_key is not null as again, case when a.fact_key is null then f.said_at end as said_at,
  epoch_us(f.written_at) + case when a.fact_key is null then 0 else 86400000000 end as written_us from facts f left join again a using (graph_id, fact_key)),
links as (select graph_id, fact_key, kind, anchor from edges union select graph_id, fact_key, 'topic', 'once more' from again)"""


@query(f"""with {_AGAIN} select n.graph_id, n.value, epoch_us(n.said_at) as said_us, n.written_us, (select count(*) from links l where l.graph_id = n.graph_id and l.fact_key = n.fact_key) as edges from now n""")
def engine_remember_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Facts remembered again a day later: times are replaced, absent ones too, edges accumulate. The second batch comes as a stream."""
    engine = _new_engine(spark)
    engine.store.remember(_inputs(spark, folder))
    again = engine.store.memory().facts.where("said_at is not null")
    rows = again.select("graph_id", "value", F.array(F.lit("Once more")).alias("topics"), F.lit(None).cast("array<string>").alias("entities"), F.lit(None).cast("timestamp").alias("said_at"),
                        (F.col("written_at") + F.expr("interval 1 day")).alias("written_at"), F.lit(None).cast("array<struct<start_at:timestamp,end_at:timestamp>>").alias("occurred"), F.lit(None).cast("array<double>").alias("vector"))
    source, progress = temporary(spark, "again"), temporary(spark, "progress")
    rows.write.parquet(source)
    ingest_stream(spark.readStream.schema(REMEMBER).parquet(source), engine.store, progress).awaitTermination()
    m = engine.store.memory()
    edges = m.edges.groupBy("graph_id", "fact_key").agg(F.count(F.lit(1)).alias("edges"))
    facts = m.facts.join(edges, ["graph_id", "fact_key"], "left")
    return facts.select("graph_id", "value", F.unix_micros("said_at").alias("said_us"), F.unix_micros("written_at").alias("written_us"), F.coalesce("edges", F.lit(0)).alias("edges"))


@query("""select graph_id, count(*) as facts, any_value(value) as value from (
  select distinct graph_id, value from remembers where fact_key is not null and value is not null and trim(value) <> '' and graph_id in (0, 3, 9)
) where value = (select min(value) from remembers r where r.graph_id = 3) group by graph_id""")
def engine_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A fact by what it says, in the graph that holds it and in others that don't."""
    value = table(spark, folder, "remembers").where("graph_id = 3").agg(F.min("value")).first()[0]
    engine = _engine(spark, folder)
    found = [(g, engine.fact(value, g)) for g in (0, 3, 9)]
    return spark.createDataFrame([(g, 1, r["value"]) for g, r in found if r], "graph_id smallint, facts bigint, value string")


@query("select epoch_us(time_bucket(interval 30 day, written_at, timestamptz '1970-01-01 00:00:00+00')) as window_us, graph_id, count(*) as n from remembers where written_at is not null group by all")
def written_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Remember inputs per window of event time, as a stream that never drops what is that late."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/remembers.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, folder, "remembers").schema)  # a stream reads folders: of one file, the folder it lies in
    rows = reader.parquet(path.toString()) if files else reader.option("pathGlobFilter", path.getName()).parquet(folder)
    name = f"windows_{uuid.uuid4().hex}"
    counts = written_per_window(rows, "written_at", "30 days", "36500 days", "graph_id")
    stream = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", temporary(spark, "windows")).start()
    stream.awaitTermination()
    return spark.table(name).where("window is not null").select(F.unix_micros("window.start").alias("window_us"), "graph_id", "n")
