"""Configuration and the tables of a memory."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "graph_id smallint, fact_key bigint, value string, written_at timestamp, said_at timestamp, occurred array<struct<start_at:timestamp,end_at:timestamp>>"
EDGES = "graph_id smallint, fact_key bigint, kind string, anchor string"
VECTORS = "graph_id smallint, fact_key bigint, embedding array<double>"


@dataclass(frozen=True)
class Config:
    """Settings; a zero means the default, a negative half-life or window is off."""

    num_graphs: int = 8
    top: int = 10
    depth: int = 0
    max_top: int = 1000
    max_depth: int = 2
    max_vector_dimension: int = 4096
    half_life_s: float = 90 * 24 * 3600.0
    seed_size: int = 10
    min_score_ratio: float = 0.0
    window_gamma: float = 0.3
    cache: int = 1000
    scorer: str = "information"
    traversal: str = "excess"
    relevance: str = "bm25"
    hash: str = "xxhash"
    hash_seed: int = 0
    stemming: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.type in ("int", "float") and getattr(self, f.name) == 0 and f.default:
                object.__setattr__(self, f.name, f.default)
        for name, accepted in (("scorer", ("information", "excess", "rrf")), ("traversal", ("none", "bfs", "excess")), ("relevance", ("bm25", "matchcount")), ("hash", ("xxhash",))):
            value = getattr(self, name).lower()
            if value not in accepted:
                raise ValueError(f"{name} = {getattr(self, name)!r} (accepted: {', '.join(accepted)})")
            object.__setattr__(self, name, value)
        for name, lo, hi in (("min_score_ratio", 0, 1), ("window_gamma", float("-inf"), 1), ("max_depth", 0, 2), ("max_top", 1, float("inf")), ("num_graphs", 1, 256)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} = {getattr(self, name)} (accepted: {lo} to {hi})")


@dataclass(frozen=True)
class Memory:
    """The tables one search reads. ``postings``, ``lengths`` and ``neighbours`` are
    derived from the others (see ``operators.textindex`` and ``operators.anchors``)."""

    facts: DataFrame
    edges: DataFrame
    postings: DataFrame
    lengths: DataFrame
    neighbours: DataFrame
    vectors: DataFrame | None = None
    corpus: DataFrame | None = None  # a row per graph, see ``textindex.corpus``

    def sizes(self) -> dict[int, tuple[int, float]]:
        """Per graph its number of facts and their mean length in terms, asked once; a row per graph reaches the driver."""
        found = self.__dict__.get("_sizes")
        if found is None:
            from mnemos.operators.textindex import corpus

            stats = self.corpus if self.corpus is not None else corpus(self.lengths)
            found = {r["graph_id"]: (r["docs"], r["avgdl"]) for r in stats.collect()}
            object.__setattr__(self, "_sizes", found)
        return found

    def kept(self) -> Memory:
        """The same with its tables written out, for several searches; ``session.scratch`` ends their life."""
        from mnemos.operators.textindex import corpus
        from mnemos.session import cut

        lens = cut(self.lengths)
        rest = [cut(t) if t is not None else None for t in (self.neighbours, self.vectors)]
        return Memory(cut(self.facts), cut(self.edges), cut(self.postings), lens, *rest, cut(corpus(lens)))


def unsigned(key):
    """A column that orders 64-bit keys as unsigned numbers."""
    return F.col(key).bitwiseXOR(F.lit(-(2**63)))
