"""A memory kept as parquet files that only grow.

A write adds one folder, ``root/TABLE/d=N``, to each table with the rows it changes: new facts and their
index entries, edges, vectors, and the places in the anchors' order around them. Its
work follows the batch, not the graph. A numbered manifest, written under a name of
its own and then renamed to the next free number, names the folders that make up
each graph; readers take the highest, so they see all of a write or nothing, and a
failed write leaves nothing but files no manifest names. Two writers that race for a
number: the second fails and starts again from what the first wrote.

Folders are merged as they add up: small ones among themselves, and with the oldest
one of the graph (its base) once they hold half as many facts, so that a fact is
rewritten about log(n) times in all.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.functions.keys import keyed
from mnemos.model import EDGES, FACTS, VECTORS, Config, Memory
from mnemos.operators import anchors as A
from mnemos.operators import ingest
from mnemos.operators.textindex import lengths, postings, tokens
from mnemos.session import cut, gathered, kept, scratch

ANCHORED = "graph_id smallint, kind string, anchor string, fact_key bigint, before bigint"
TABLES = {
    "facts": FACTS,
    "edges": EDGES,
    "vectors": VECTORS,
    "postings": "graph_id smallint, term string, fact_key bigint, tf int",
    "lengths": "graph_id smallint, fact_key bigint, len int",
    "order": f"{ANCHORED}, after bigint",
    "tails": f"{ANCHORED}, written_at timestamp",
}
FACT = ["graph_id", "fact_key"]
#: Tables in which a later row replaces an earlier one of the same key; the others only gain rows.
KEYS = {"facts": FACT, "vectors": FACT, "order": [*A.ANCHOR, "fact_key"], "tails": A.ANCHOR}
REMEMBER = (
    "graph_id smallint, value string, topics array<string>, entities array<string>, said_at timestamp, written_at timestamp,"
    " occurred array<struct<start_at:timestamp,end_at:timestamp>>, vector array<double>"
)
#: Facts beside the base up to which their rows are read ahead, once per manifest.
SMALL_FACTS = 2_000
#: Folders of a graph beside its base from which on they are merged.
MOST_DELTAS = 8


class DimensionError(ValueError):
    """A vector of another length than those its graph holds."""


@dataclass
class Graph:
    """What a manifest says of a graph: its base, the folders since with their facts, and what reads ask for first."""

    base: int
    facts: int = 0
    deltas: list[tuple[int, int]] = field(default_factory=list)  # (folder, facts)
    docs: int = 0
    terms: int = 0
    dim: int | None = None

    @property
    def folders(self) -> list[int]:
        return [self.base, *(n for n, _ in self.deltas)]


def _folder_of(number: int) -> int:
    """Rises with the manifest, and differs between writers that race for it."""
    return number << 24 | uuid.uuid4().int & 0xFFFFFF


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self._lock = threading.RLock()
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._memories: dict[tuple, Memory] = {}

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> tuple[int, dict[int, Graph]]:
        """The highest manifest's number, 0 if there is none, and its graphs."""
        number = max(self._numbers(), default=0)
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{number}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return number, {int(g): Graph(**{**v, "deltas": [tuple(d) for d in v["deltas"]]}) for g, v in found.items()}

    def _publish(self, number: int, graphs: dict[int, Graph]) -> bool:
        """Whether ``number`` was still free."""
        folder, temp = self._path(f"{self.root}/manifests"), self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(folder)
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({str(g): asdict(v) for g, v in graphs.items()}, sort_keys=True).encode()))
        out.close()
        to = self._path(f"{self.root}/manifests/{number}.json")
        done = not self._fs.exists(to) and self._fs.rename(temp, to)  # a rename doesn't replace
        if not done:
            self._fs.delete(temp, False)
        return bool(done)

    # reading

    def _check(self, *graphs: int) -> None:
        for g in graphs:
            if not 0 <= g < self.config.num_graphs:
                raise ValueError(f"graph {g} out of range (0-{self.config.num_graphs - 1})")

    def _read(self, name: str, graphs: dict[int, Graph]) -> DataFrame:
        """The current rows of a table for some graphs. Replaced rows are found by the keys of the
        folders after the base, which merging keeps few beside it."""
        columns = [c.strip().split(" ")[0] for c in TABLES[name].split(", ")]
        if not graphs:
            return self.spark.createDataFrame([], TABLES[name])
        paths = sorted({f"{self.root}/{name}/d={n}" for g in graphs.values() for n in g.folders})
        rows = self.spark.read.option("basePath", f"{self.root}/{name}").schema(f"{TABLES[name]}, d bigint").parquet(*paths)
        mine, base = F.lit(False), F.lit(False)
        for g, v in graphs.items():
            mine = mine | ((F.col("graph_id") == g) & F.col("d").isin(*v.folders))
            base = base | ((F.col("graph_id") == g) & (F.col("d") == v.base))
        rows = rows.where(mine)
        if name not in KEYS or not any(v.deltas for v in graphs.values()):
            return rows.select(*columns)
        keys = KEYS[name]
        new = ingest.latest(rows.where(~base), keys, F.col("d"))
        if sum(n for v in graphs.values() for _, n in v.deltas) <= SMALL_FACTS:
            few = gathered(new)
            new = new if few is None else few
        return rows.where(base).join(new.select(*keys), keys, "left_anti").select(*columns).unionByName(new.select(*columns))

    def memory(self, *graphs: int) -> Memory:
        """The tables of some graphs (of all, if none is named) as they are now."""
        self._check(*graphs)
        number, all_graphs = self.manifest()
        key = (number, *sorted(set(graphs)))
        if key not in self._memories:
            if any(k[0] != number for k in self._memories):
                self._memories.clear()
            mine = {g: v for g, v in all_graphs.items() if not graphs or g in graphs}
            facts, edges, posts, lens, order, vectors = (self._read(n, mine) for n in ("facts", "edges", "postings", "lengths", "order", "vectors"))
            stats = [(g, v.docs, v.terms / v.docs) for g, v in mine.items() if v.docs]
            corpus = self.spark.createDataFrame(stats, "graph_id smallint, docs bigint, avgdl double")
            self._memories[key] = Memory(facts, edges, posts, lens, A.linked(order), vectors, corpus)
        return self._memories[key]

    def fact(self, graph: int, key: int) -> DataFrame:
        """Point lookup: the fact of a key, one row or none."""
        return self.memory(graph).facts.where(F.col("fact_key") == key)

    def is_empty(self, graph: int) -> bool:
        return graph not in self.manifest()[1]

    def dimension(self, graph: int) -> int | None:
        """The length of a graph's vectors, None if it has none."""
        found = self.manifest()[1].get(graph)
        return found.dim if found else None

    def stats(self) -> DataFrame:
        return ingest.stats(self.memory(), self.config.num_graphs)

    # writing

    def remember(self, rows: DataFrame) -> None:
        """Files a batch of remember inputs (see ``REMEMBER``). Facts with equal values are one
        fact: its times are those of the latest written, whatever order they come in, its
        edges accumulate, its vector stays unless a new one is given."""
        rows = rows.where("value is not null and trim(value) <> ''").withColumn("fact_key", keyed("fact", F.col("value"), self.config.hash_seed))
        with self._lock, scratch(self.spark):
            log = kept(rows.withColumn("remember_id", F.monotonically_increasing_id()))
            seen = log.groupBy("graph_id").agg(F.collect_set(F.size("vector")).alias("dims")).collect()
            touched = {r["graph_id"]: {n for n in r["dims"] if n >= 0} for r in seen}
            if not touched:
                return
            self._check(*touched)
            while not self._append(log, touched):
                pass
        self._merge(touched)

    def _append(self, log: DataFrame, touched: dict[int, set[int]]) -> bool:
        number, graphs = self.manifest()
        old = {g: graphs[g] for g in touched if g in graphs}
        for g, dims in touched.items():
            if len(dims | ({old[g].dim} if g in old and old[g].dim else set())) > 1:
                raise DimensionError(f"graph {g}: vectors of different dimensions")
        facts = ingest.facts_of(log)
        keys = F.broadcast(log.select(*FACT).distinct()) if old else None
        edges, fresh = ingest.edges_of(log), facts
        given = ingest.latest(log.where("vector is not null"), FACT, F.col("written_at"), F.col("remember_id")).select(*FACT, F.col("vector").alias("embedding"))
        known = had = None
        if old:
            known = kept(self._read("facts", old).join(keys, FACT, "left_semi").select(*FACT, F.col("written_at").alias("before")))
            later = F.broadcast(facts.join(F.broadcast(known), FACT).where("before > written_at").select(*FACT))
            facts = facts.join(later, FACT, "left_anti")
            had = self._read("edges", old).join(keys, FACT, "left_semi")
            edges, fresh = edges.join(had, [*FACT, "kind", "anchor"], "left_anti"), facts.join(F.broadcast(known.select(*FACT)), FACT, "left_anti")
        edges = kept(edges)
        order, tails = self._order(facts, edges, known, had, old)
        words = tokens(fresh, self.config.stemming)
        lens = kept(lengths(words))
        new = {"facts": facts, "edges": edges, "vectors": given, "postings": postings(words).sortWithinPartitions("graph_id", "term"), "lengths": lens, "order": order, "tails": tails}
        folder = _folder_of(number + 1)
        self._write(new, folder)
        added = {r["graph_id"]: r for r in lens.groupBy("graph_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("terms")).collect()}
        of_batch = {r["graph_id"]: r["n"] for r in facts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        for g, dims in touched.items():
            v = graphs.setdefault(g, Graph(folder, of_batch.get(g, 0)))
            if v.base != folder:
                v.deltas.append((folder, of_batch.get(g, 0)))
            v.docs += added[g]["docs"] if g in added else 0
            v.terms += added[g]["terms"] if g in added else 0
            v.dim = max(dims, default=v.dim)
        return self._publish(number + 1, graphs)

    def _order(self, facts: DataFrame, edges: DataFrame, known: DataFrame | None, had: DataFrame | None, old: dict[int, Graph]) -> tuple[DataFrame, DataFrame]:
        """The places that change in the anchors' order, and the anchors' last facts.

        Facts that are new and written after all others of their anchors go to the ends, which
        touches one more row an anchor. Otherwise (a fact is remembered again, or an older one comes late)
        the order of the anchors concerned is found anew."""
        times = facts.select(*FACT, "written_at")

        def last(seq: DataFrame, written: DataFrame) -> DataFrame:
            return seq.where("after is null").join(written, FACT).select(*A.ANCHOR, "fact_key", "before", "written_at")

        if not old:
            seq = kept(A.sequence(facts, edges))
            return seq, last(seq, times)
        about = F.broadcast(edges.select(*A.ANCHOR).distinct())
        ends = kept(self._read("tails", old).join(about, A.ANCHOR, "left_semi"))
        first = times.agg(F.min("written_at").alias("t"))
        late = ends.join(F.broadcast(first), F.col("written_at") >= F.col("t")).limit(1).count()
        if not late and known.isEmpty():
            seq = A.sequence(facts, edges)
            tail = F.broadcast(ends.select(*A.ANCHOR, F.col("fact_key").alias("tail")))
            seq = kept(seq.join(tail, A.ANCHOR, "left").withColumn("before", F.coalesce("before", "tail")).drop("tail"))
            heads = seq.join(tail, (seq["before"] == tail["tail"]) & (seq["graph_id"] == tail["graph_id"]) & (seq["kind"] == tail["kind"]) & (seq["anchor"] == tail["anchor"]))
            heads = heads.select(seq["graph_id"], seq["kind"], seq["anchor"], seq["fact_key"].alias("after"))
            linked = ends.join(F.broadcast(heads), A.ANCHOR).select(*A.ANCHOR, "fact_key", "before", "after")
            return seq.unionByName(linked), last(seq, times)
        about = F.broadcast(kept(edges.unionByName(had.select(*edges.columns)).select(*A.ANCHOR).distinct()))
        members = self._read("edges", old).join(about, A.ANCHOR, "left_semi").unionByName(edges)
        others = self._read("facts", old).select(*FACT, "written_at").join(F.broadcast(times.select(*FACT)), FACT, "left_anti")
        written = others.unionByName(times)
        seq = kept(A.sequence(written, members))
        return seq, last(seq, written)

    def _write(self, tables: dict[str, DataFrame], number: int) -> None:
        """All tables of a folder, at the same time: each is a small job."""

        def one(item: tuple[str, DataFrame]) -> None:
            name, df = item
            kept = df.select(*(c.strip().split(" ")[0] for c in TABLES[name].split(", ")))
            kept.write.mode("overwrite").parquet(f"{self.root}/{name}/d={number}")

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(one, tables.items()))

    def _merge(self, touched: Iterable[int]) -> None:
        """Merges the folders of the graphs in which they have become many or large, all of them in one pass each."""
        with self._lock:
            graphs = {g: v for g, v in self.manifest()[1].items() if g in touched and v.deltas}
            large = [g for g, v in graphs.items() if sum(n for _, n in v.deltas) * 2 > v.facts]
            if large:
                self._rewrite(large, whole=True)
            many = [g for g, v in graphs.items() if g not in large and len(v.deltas) > MOST_DELTAS]
            if many:
                self._rewrite(many, whole=False)

    def _rewrite(self, touched: list[int], whole: bool, gone: DataFrame | None = None) -> None:
        """One folder instead of the graphs' deltas, or of all their folders, without the facts ``gone``."""
        while True:
            number, graphs = self.manifest()
            views = {g: graphs[g] if whole else Graph(graphs[g].deltas[0][0], deltas=graphs[g].deltas[1:]) for g in touched}
            tables = {n: self._read(n, views) for n in TABLES}
            folder = _folder_of(number + 1)
            with scratch(self.spark):
                if gone is not None:
                    left = ingest.delete_facts(Memory(tables["facts"], tables["edges"], tables["postings"], tables["lengths"], tables["facts"], tables["vectors"]), gone)
                    order = cut(A.sequence(left.facts, left.edges))
                    ends = order.where("after is null").join(left.facts.select(*FACT, "written_at"), FACT)
                    tables = {"facts": left.facts, "edges": left.edges, "postings": left.postings, "lengths": left.lengths, "vectors": left.vectors, "order": order, "tails": ends}
                tables["postings"] = tables["postings"].sortWithinPartitions("graph_id", "term")  # a search reads few terms
                self._write(tables, folder)
            count = lambda name, *more: {r["graph_id"]: r for r in self._folder(name, folder).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), *more).collect()}
            facts = count("facts")
            lens, vectors = (count("lengths", F.sum("len").alias("terms")), count("vectors")) if gone is not None else ({}, {})
            for g in touched:
                v, many = graphs[g], facts[g]["n"] if g in facts else 0
                if whole:
                    v.base, v.facts, v.deltas = folder, many, []
                else:
                    v.deltas = [(folder, many)]
                if gone is not None:
                    v.docs, v.terms = (lens[g]["n"], lens[g]["terms"]) if g in lens else (0, 0)
                    v.dim = v.dim if g in vectors else None
                    if not v.docs:
                        del graphs[g]
            if self._publish(number + 1, graphs):
                return

    def _folder(self, name: str, number: int) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/d={number}")

    def delete(self, graph: int, gone: DataFrame) -> None:
        """Takes the facts ``gone`` (fact_key) out of a graph, with their edges, vectors and index
        entries; no statement of the language reaches it. The graph is rewritten."""
        self._check(graph)
        with self._lock:
            if not self.is_empty(graph):
                self._rewrite([graph], True, gone.select(F.lit(graph).cast("smallint").alias("graph_id"), "fact_key"))

    def vacuum(self) -> None:
        """Deletes folders and manifests that are no longer current; readers that started before may miss them."""
        with self._lock:
            number, graphs = self.manifest()
            for n in self._numbers():
                if n != number:
                    self._fs.delete(self._path(f"{self.root}/manifests/{n}.json"), False)
            used = {f"d={n}" for g in graphs.values() for n in g.folders}
            for name in TABLES:
                for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                    if status.getPath().getName() not in used:
                        self._fs.delete(status.getPath(), True)
