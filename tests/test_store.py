import random
from datetime import datetime, timedelta, timezone

import pytest

from mnemos.functions.keys import key
from mnemos.model import Config
from mnemos.operators.ingest import memory_of
from mnemos.operators.textindex import corpus
from mnemos.sources import store as stores
from mnemos.sources.store import REMEMBER, DimensionError, MemoryStore

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(df, *columns):
    return sorted((tuple(str(r[c]) for c in columns or df.columns) for r in df.collect()))


def batch(r, at, n):
    words = "oak elm ash fir yew bay box may".split()
    out = []
    for k in range(n):
        value = " ".join(r.choice(words) for _ in range(2))
        topics = r.sample(["a", "B", "c", "d"], r.randrange(3))
        out.append((r.randrange(2), value, topics, ["e"] * r.randrange(2), None, T0 + timedelta(seconds=at + k // 2), None, [float(len(value)), 1.0] if r.random() < 0.3 else None))
    return out


def check(spark, store, logged, graphs=(0, 1)):
    """What the store holds is what one pass over everything ever remembered gives."""
    rows = [(i, g, key("fact", v), v, t, e, s, w, o) for i, (g, v, t, e, s, w, o, _) in enumerate(logged)]
    names = "remember_id bigint, graph_id smallint, fact_key bigint, " + REMEMBER.split(", ", 1)[1].rsplit(", vector", 1)[0]
    want, got = memory_of(spark.createDataFrame(rows, names), stemming=False), store.memory(*graphs)
    for name in ("facts", "edges", "postings", "lengths"):
        columns = getattr(got, name).columns
        assert rows_of(getattr(got, name)) == rows_of(getattr(want, name).select(*columns)), name
    assert rows_of(got.neighbours.distinct()) == rows_of(want.neighbours)
    assert rows_of(got.corpus) == rows_of(corpus(want.lengths))
    vectors = {(g, key("fact", v)): x for g, v, *_, x in logged if x}
    assert {(r["graph_id"], r["fact_key"]): r["embedding"] for r in got.vectors.collect()} == vectors


@pytest.mark.parametrize("most", [8, 2])
def test_batches_add_up(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(stores, "MOST_DELTAS", most)
    r, store, logged = random.Random(most), MemoryStore(spark, str(tmp_path), Config(stemming=False)), []
    for k, (at, n) in enumerate([(100, 40), (200, 3), (300, 3), (50, 4), (400, 2)]):  # the fourth comes late
        new = batch(r, at, n) if k != 1 else [(0, "never said before", ["a"], ["e"], None, T0 + timedelta(seconds=200), None, None)]
        store.remember(spark.createDataFrame(new, REMEMBER))
        logged += new
    check(spark, store, logged)
    store.vacuum()
    check(spark, store, logged)
    gone = logged[0]
    store.delete(gone[0], spark.createDataFrame([(key("fact", gone[1]),)], "fact_key bigint"))
    left = [x for x in logged if (x[0], x[1]) != (gone[0], gone[1])]
    check(spark, store, left)
    assert store.fact(gone[0], key("fact", gone[1])).isEmpty() and store.fact(left[0][0], key("fact", left[0][1])).first()["value"] == left[0][1]


def test_nulls_blanks_and_limits(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path), Config(stemming=False, num_graphs=4))
    rows = [(1, None, ["a"], None, None, T0, None, None), (1, "  ", None, None, None, T0, None, None), (1, "x", [None, " ", "Q"], None, None, T0, [], None)]
    store.remember(spark.createDataFrame(rows, REMEMBER))
    store.remember(spark.createDataFrame([], REMEMBER))
    m = store.memory(1)
    assert rows_of(m.facts, "value") == [("x",)] and rows_of(m.edges, "anchor") == [("q",)]
    with pytest.raises(ValueError, match="out of range"):
        store.remember(spark.createDataFrame([(7, "x", None, None, None, T0, None, None)], REMEMBER))
    store.remember(spark.createDataFrame([(1, "y", None, None, None, T0, None, [1.0, 2.0])], REMEMBER))
    before = store.manifest()
    with pytest.raises(DimensionError):
        store.remember(spark.createDataFrame([(1, "z", None, None, None, T0, None, [1.0])], REMEMBER))
    assert store.manifest() == before and store.dimension(1) == 2


def test_readers_and_racing_writers(spark, tmp_path, monkeypatch):
    """Readers see a whole write or none; a writer that loses the race starts again; a crash leaves nothing visible."""
    one, two = (MemoryStore(spark, str(tmp_path), Config(stemming=False)) for _ in range(2))
    row = lambda v: spark.createDataFrame([(0, v, ["t"], None, None, T0, None, None)], REMEMBER)
    one.remember(row("first"))
    seen = two.memory(0)
    publish = MemoryStore._publish

    def crash(self, number, graphs):
        raise RuntimeError("stopped before the manifest")

    monkeypatch.setattr(MemoryStore, "_publish", crash)
    with pytest.raises(RuntimeError):
        one.remember(row("lost"))
    monkeypatch.setattr(MemoryStore, "_publish", publish)
    assert rows_of(two.memory(0).facts, "value") == [("first",)]
    lost = []

    def race(self, number, graphs):
        if self is one and not lost:
            lost.append(number)
            two.remember(row("second"))
        return publish(self, number, graphs)

    monkeypatch.setattr(MemoryStore, "_publish", race)
    one.remember(row("third"))
    assert lost and rows_of(two.memory(0).facts, "value") == [("first",), ("second",), ("third",)]
    assert rows_of(seen.facts, "value") == [("first",)]
    assert two.memory(0).neighbours.distinct().count() == 4  # three facts in a row
