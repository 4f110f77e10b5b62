"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.functions import clocks, render
from mnemos.functions.keys import key
from mnemos.functions.text import query_terms
from mnemos.functions.timevalue import Interval
from mnemos.model import Config, unsigned
from mnemos.operators import answers
from mnemos.plans.builders import When, build_describe, build_recall, build_remember, build_when
from mnemos.plans.language import Body, DescribeQuery, RecallQuery, RememberQuery, WhenQuery, dedupe, parse, show_body
from mnemos.plans.search import SOURCES, Found, Recall, search
from mnemos.sources.store import REMEMBER, MemoryStore

HIT = "place int, graph_id smallint, fact_key bigint, value string, written_at timestamp, said_at timestamp, occurred array<struct<start_at:timestamp,end_at:timestamp>>, relevance double, decay double, score double, seed boolean"


class QueryError(ValueError):
    """A statement that parses but can't run: a limit is exceeded or a parameter missing."""


@dataclass
class Answer:
    """``rows``: hits, or the entries of a catalogue; ``span`` of a when; ``explain`` and
    ``catalogue`` hold what goes beyond rows. ``empty_graph`` tells a graph without facts from
    a miss. ``close`` deletes what the rows are read from; as a context it does so at its end."""

    rows: DataFrame | None = None
    span: Interval | None = None
    catalogue: dict | None = None
    explain: dict | None = None
    warnings: list[str] = field(default_factory=list)
    empty_graph: bool = False
    status: str = "ok"
    found: list[Found] = field(default_factory=list, repr=False)

    def close(self) -> None:
        while self.found:
            self.found.pop().close()

    def __enter__(self) -> Answer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def text(self) -> str:
        """The answer as lines of text, one a hit or an anchor."""
        return render.answer(self)


class MemoryEngine:
    """Reads and writes a memory through the query language or the methods of the same names.

    ``embed`` makes the vector of a text: of facts that bring none, and of the terms of
    recalls and whens that bind none (a describe takes none: a vector would reach every fact that has one).
    ``extract`` finds the anchors of a fact remembered without any: it is given the value and
    ``context``, and returns (kind, anchor) pairs."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: Config = Config(),
        clock: Callable[[], datetime] | None = None,
        embed: Callable[[str], Sequence[float]] | None = None,
        extract: Callable[[str, dict], Sequence[tuple[str, str]]] | None = None,
    ) -> None:
        self.spark, self.config, self.store = spark, config, MemoryStore(spark, root, config)
        self.clock, self.embed, self.extract = clock or (lambda: datetime.now(timezone.utc)), embed, extract
        self._plans: OrderedDict = OrderedDict()

    # statements

    def plan(self, text: str):
        """The analysed statement of a text; texts seen lately aren't parsed again."""
        if text in self._plans:
            self._plans.move_to_end(text)
            return self._plans[text]
        q = parse(text)
        plan = dedupe(q)
        self._plans[text] = plan = replace(plan, warnings=q.warnings)
        while len(self._plans) > self.config.cache:
            self._plans.popitem(last=False)
        return plan

    def execute(self, text: str, params: Mapping[str, Sequence[float]] | None = None) -> Answer:
        q, params, now = self.plan(text), params or {}, self.clock()
        warnings = [str(w) for w in q.warnings]
        if isinstance(q, RememberQuery):
            self._remember(q, params, now)
            return Answer(warnings=warnings)
        graph = getattr(q, "graph", 0)
        if graph >= self.config.num_graphs:
            raise QueryError(f"graph {graph} out of range (0-{self.config.num_graphs - 1})")
        if self.store.is_empty(graph):
            self._limits(q.body, params)
            return Answer(warnings=warnings, empty_graph=True)
        memory = self.store.memory(graph)
        if isinstance(q, WhenQuery):
            return self._when(q, memory, graph, params, now, warnings)
        explain = isinstance(q, RecallQuery) and q.explain
        recall, missing, nested = self._resolve(q.body, memory, graph, params, now, warnings, explain=explain, embed=isinstance(q, RecallQuery))
        used = [f for a in nested.values() for f in a.found]
        if isinstance(q, DescribeQuery):
            answer = self._describe(q, recall, missing, memory, now, warnings)
        elif missing:
            answer = Answer(self.spark.createDataFrame([], HIT), warnings=warnings)
            answer.explain = self._explained(None, recall, nested) if explain else None
        else:
            found = search(memory, [recall], self.config, now, ranks=explain)
            answer = Answer(found.hits.drop("query_id").orderBy("place"), warnings=warnings, found=[found])
            answer.explain = self._explained(found, recall, nested) if explain else None
        answer.found += used
        return answer

    def _limits(self, body: Body, params: Mapping, graph: int | None = None) -> tuple[int, int, tuple | None]:
        c = self.config
        top, depth = c.top if body.top is None else body.top, c.depth if body.depth is None else body.depth
        if body.top is not None and not 1 <= top <= c.max_top:
            raise QueryError(f"top:{top} out of range (1-{c.max_top})")
        if body.depth is not None and depth > c.max_depth:
            raise QueryError(f"depth:{depth} out of range (0-{c.max_depth})")
        vector = self._vector(body.vec, params)
        dim = self.store.dimension(graph) if vector and graph is not None else None
        if dim and dim != len(vector):
            raise QueryError(f"vector ${body.vec} has {len(vector)} dimensions, those of graph {graph} have {dim}")
        return top, depth, vector

    def _vector(self, name: str | None, params: Mapping) -> tuple | None:
        if name is None:
            return None
        if name not in params:
            raise QueryError(f"missing parameter: ${name}")
        v = tuple(float(x) for x in params[name])
        if len(v) > self.config.max_vector_dimension:
            raise QueryError(f"vector ${name} has {len(v)} dimensions, max {self.config.max_vector_dimension}")
        return v

    def _resolve(self, body: Body, memory, graph: int, params: Mapping, now: datetime, warnings: list[str], explain: bool = False, embed: bool = True) -> tuple[Recall, bool, dict[str, Answer]]:
        """The recall with its bounds as instants; whether a nested when had no answer; the answers of those nested."""
        limit, depth, vector = self._limits(body, params, graph)
        bounds, missing, nested = {}, False, {}
        for name in ("since", "until"):
            value = getattr(body, name)
            if isinstance(value, WhenQuery):
                inner: list[str] = []
                nested[name] = self._when(value, memory, graph, params, now, inner, explain)
                span = nested[name].span
                warnings += [f"{name}: {w}" for w in inner]
                if span is None:
                    missing = True
                    continue
                at = (span.end or span.start) if name == "since" else span.start
                bounds |= {name: at, f"{name}_clock": value.clock}
            elif value is not None:
                bounds[name] = value.resolve(now).start
        words = tuple(t.text for t in body.terms)
        if vector is None and words and embed and self.embed:
            vector = tuple(map(float, self.embed(" ".join(words))))
        return Recall(words, vector or None, body.topics, body.entities, graph, depth, limit, **bounds), missing, nested

    def _when(self, q: WhenQuery, memory, graph: int, params: Mapping, now: datetime, warnings: list[str], explain: bool = False) -> Answer:
        recall, missing, nested = self._resolve(q.body, memory, graph, params, now, warnings, explain)
        if q.body.top is None:
            recall = replace(recall, top=1)
        answer = Answer(self.spark.createDataFrame([], HIT), warnings=warnings)
        row = None
        if not missing:
            found = search(memory, [recall], self.config, now, ranks=explain)
            answer.rows, answer.found = found.hits.drop("query_id").orderBy("place"), [found]
            answer.explain = self._explained(found, recall, nested) if explain else None
            row = answers.hull(found.hits, q.clock).first()
        if row is None or row["start_at"] is None:
            warnings.append(f"the when matched nothing: {show_body(q.body)}")
        else:
            utc = lambda t: t if t is None else t.replace(tzinfo=t.tzinfo or timezone.utc)
            answer.span = Interval(utc(row["start_at"]), utc(row["end_at"]))
        return answer

    def _describe(self, q: DescribeQuery, recall: Recall, missing: bool, memory, now: datetime, warnings: list[str]) -> Answer:
        facts, used = memory.facts, []
        if missing:
            facts = facts.limit(0)
        elif q.body.seeded:
            used.append(search(memory, [replace(recall, top=0)], self.config, now, ranks=False, whole=True))
            facts = facts.join(used[0].hits.select("graph_id", "fact_key"), ["graph_id", "fact_key"], "left_semi")
        elif recall.since or recall.until:
            facts = facts.where(clocks.in_window(F.lit(recall.since).cast("timestamp"), F.lit(recall.until).cast("timestamp"), recall.since_clock, recall.until_clock))
        top = self.config.top if q.body.top is None else q.body.top
        whole = answers.catalogue(facts, None, "graph_id").first()
        per = answers.catalogue(facts, memory.edges, "graph_id", "kind", "anchor")
        anchors = per.groupBy("kind").count().collect()
        summary = {"graph": recall.graph_id, "scope": show_body(q.body), "facts": 0, "anchors": sum(r["count"] for r in anchors)} | (whole.asDict() if whole else {})
        return Answer(answers.listed(per, ["graph_id", "kind"], "anchor", top), catalogue=summary, warnings=warnings, found=used)

    def _explained(self, found: Found | None, recall: Recall, nested: dict[str, Answer]) -> dict:
        """What the search measured: every source is listed, the bars only where a round ran, the terms in the order asked, those no fact holds among them."""
        out = {
            "background": 0.0,
            "seeds": dict.fromkeys(SOURCES, 0),
            "terms": list(dict.fromkeys(query_terms(" ".join(recall.keywords), self.config.stemming))),
            "timings": dict.fromkeys(SOURCES, 0),
        }
        if found is not None:
            rate = found.rates.first()
            out["background"] = rate["rate"] if rate else 0.0
            if rate:
                out["admission"] = {1: 2 * rate["rate"], 2: rate["rate"]}
            out["seeds"] |= {r["source"]: r["n"] for r in found.seeds.groupBy("source").agg(F.count_distinct("fact_key").alias("n")).collect()}
            if recall.alone and recall.anchored:
                out["seeds"]["anchor"] = found.contributions.where("source = 'anchor'").select("fact_key").distinct().count()
            out["timings"] = found.extra["timings"]
            out["contributions"] = found.contributions.join(found.hits.select("fact_key", "place"), "fact_key").drop("query_id")
        if nested:
            out["when"] = nested
        return out

    def _remember(self, q: RememberQuery, params: Mapping, now: datetime) -> None:
        vector = self._vector(q.vec, params)
        if vector is None and self.embed:
            vector = tuple(self.embed(q.value))
        topics, entities = list(q.topics), list(q.entities)
        if self.extract and not topics and not entities:
            for kind, anchor in self.extract(q.value, self.context(q.graph)):
                (topics if kind == "topic" else entities).append(anchor)
        said = q.said.resolve(now).start if q.said else None
        occurred = [(i.start, i.end) for t in q.occurred for i in [t.resolve(now)]] or None
        row = (q.graph, q.value, topics, entities, said, now, occurred, list(vector) if vector else None)
        self.store.remember(self.spark.createDataFrame([row], REMEMBER))

    def context(self, graph: int = 0, recent: int = 3, anchors: int = 50) -> dict:
        """What an extractor may go by: the facts written last, and the anchors that file most
        facts, among equals those in use longest."""
        if self.store.is_empty(graph):
            return {"recent": [], "anchors": []}
        m = self.store.memory(graph)
        last = m.facts.orderBy(F.desc("written_at"), unsigned("fact_key")).limit(recent).select("value").collect()
        per = m.edges.join(m.facts.select("graph_id", "fact_key", "written_at"), ["graph_id", "fact_key"]).groupBy("kind", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("written_at").alias("t"))
        most = per.orderBy(F.desc("n"), "t", "kind", "anchor").limit(anchors).collect()
        return {"recent": [r["value"] for r in reversed(last)], "anchors": [(r["kind"], r["anchor"]) for r in most]}

    # methods of the same names

    def remember(self, value: str, topics: Sequence[str] = (), entities: Sequence[str] = (), said=None, occurred: Sequence = (), vector: Sequence[float] | None = None, graph: int = 0) -> Answer:
        text = build_remember(value, graph=graph, topics=topics, entities=entities, said=said, occurred=occurred, with_vector=vector is not None)
        return self.execute(text, {"v": vector} if vector is not None else None)

    def recall(self, *keywords: str, vector: Sequence[float] | None = None, **clauses) -> Answer:
        """``clauses`` are those of ``build_recall``."""
        return self.execute(build_recall(keywords, with_vector=vector is not None, **clauses), {"v": vector} if vector is not None else None)

    def explain(self, *keywords: str, **clauses) -> Answer:
        return self.recall(*keywords, explain=True, **clauses)

    def when(self, *keywords: str, vector: Sequence[float] | None = None, since=None, until=None, **clauses) -> Answer:
        """``clauses`` are those of ``When``."""
        return self.execute(build_when(When(*keywords, **clauses), since, until, vector is not None), {"v": vector} if vector is not None else None)

    def describe(self, *keywords: str, vector: Sequence[float] | None = None, **clauses) -> Answer:
        return self.execute(build_describe(keywords, with_vector=vector is not None, **clauses), {"v": vector} if vector is not None else None)

    def query(self, text: str, params: Mapping[str, Sequence[float]] | None = None) -> Answer:
        """A statement as written."""
        return self.execute(text, params)

    def fact(self, value: str, graph: int = 0) -> dict | None:
        """Point lookup of a fact by what it says."""
        self.store._check(graph)
        row = None if self.store.is_empty(graph) else self.store.fact(graph, key("fact", value, self.config.hash_seed)).first()
        return row and row.asDict()

    def stats(self) -> DataFrame:
        return self.store.stats().withColumn("relevance", F.lit(self.config.relevance))
