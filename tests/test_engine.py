from datetime import datetime, timedelta, timezone

import pytest

from mnemos.engine import MemoryEngine, QueryError
from mnemos.functions.keys import key
from mnemos.functions.timevalue import Interval, TimeError, parse_date, parse_duration
from mnemos.model import Config
from mnemos.sources.store import REMEMBER, DimensionError, MemoryStore
from mnemos.streaming.ingest import ingest_stream

T0 = datetime(2023, 6, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    at = [T0]

    def clock():
        at[0] += timedelta(seconds=1)
        return at[0]

    e = MemoryEngine(spark, str(tmp_path_factory.mktemp("memory")), Config(half_life_s=-1, window_gamma=-1), clock)
    rows = [
        (1, "the regatta was won by the harbour team", ["regatta"], ["anna"], None, T0, [(datetime(2023, 5, 7, tzinfo=timezone.utc), datetime(2023, 5, 8, tzinfo=timezone.utc))], None),
        (1, "the harbour drills began", ["drills"], ["anna"], datetime(2023, 5, 8, tzinfo=timezone.utc), T0, [(datetime(2023, 5, 1, tzinfo=timezone.utc), None)], None),
        (1, "the cruise left the harbour", [], [], datetime(2023, 5, 25, tzinfo=timezone.utc), T0, None, None),
        (2, "two boats", ["boats"], [], None, T0, None, [0.0, 1.0]),
    ]
    e.store.remember(spark.createDataFrame(rows, REMEMBER))
    return e


def values(answer):
    return [r["value"] for r in answer.rows.orderBy("place").collect()]


def test_recall_explain_and_limits(engine):
    assert len(values(engine.execute("recall@1 harbour"))) == 3
    a = engine.execute("explain recall@1 harbour entity:anna")
    assert a.explain["terms"] == ["harbour"] and a.explain["seeds"]["text"] == 3 and a.explain["background"] > 0
    assert engine.execute("recall@5 harbour").empty_graph
    assert values(engine.execute("recall@1 zeppelin")) == []
    for text in ("recall@1 x top:0", "recall@1 x top:5000", "recall@1 x depth:3", "recall@1 vec:$v", "recall@9 x"):
        with pytest.raises(QueryError):
            engine.execute(text)


def test_windows_and_nested_when(engine):
    assert values(engine.execute("recall@1 harbour until:'2023-05-07'")) == ["the harbour drills began"]
    assert set(values(engine.execute("recall@1 harbour since:(when regatta)"))) == {"the harbour drills began", "the cruise left the harbour"}
    a = engine.execute("recall@1 harbour since:(when zeppelin)")
    assert values(a) == [] and a.warnings[0].startswith("since:")


def test_when_and_describe(engine, spark):
    memory = engine.store.memory(1)
    from mnemos.operators.answers import hull

    row = hull(memory.facts.where("value like '%regatta%'"), "happened").first()
    assert row["end_at"] - row["start_at"] == timedelta(days=1)
    a = engine.execute("describe recall@1")
    assert a.catalogue["facts"] == 3 and a.catalogue["anchors"] == 3 and a.catalogue["happened_end"] is None
    assert [r["anchor"] for r in a.rows.where("kind = 'entity'").collect()] == ["anna"]
    assert engine.execute("describe recall@1 until:'2023-05-02'").catalogue["facts"] == 1


def test_remember_again_keeps_edges_and_replaces_times(engine):
    engine.execute("remember@3 'tea is ready' topic:Kitchen said:'2023-05-08'")
    engine.remember("tea is ready", topics=["house"], graph=3)
    m = engine.store.memory(3)
    assert [(r["value"], r["said_at"]) for r in m.facts.collect()] == [("tea is ready", None)]
    assert {r["anchor"] for r in m.edges.collect()} == {"kitchen", "house"}
    assert [r["facts"] for r in engine.stats().orderBy("graph_id").collect()][:4] == [0, 3, 1, 1]
    assert m.facts.first()["fact_key"] == key("fact", "tea is ready")


def test_dimension_error_leaves_the_graph(engine):
    before = engine.store.manifest()
    with pytest.raises(DimensionError):
        engine.remember("three boats", vector=[1.0, 2.0, 3.0], graph=2)
    assert engine.store.manifest() == before


def test_explain_lists_what_was_asked(engine):
    a = engine.execute("explain recall@1 harbour unheardof harbour entity:anna since:(when regatta)")
    e = a.explain
    assert e["terms"] == ["harbour", "unheardof"] and set(e["seeds"]) == set(e["timings"]) == {"text", "vector", "graph", "anchor"}
    assert e["admission"] == {1: 2 * e["background"], 2: e["background"]} and e["seeds"]["graph"] == 0
    inner = e["when"]["since"]
    assert inner.span == Interval(datetime(2023, 5, 7, tzinfo=timezone.utc), datetime(2023, 5, 8, tzinfo=timezone.utc))
    assert values(inner) == ["the regatta was won by the harbour team"] and inner.explain["terms"] == ["regatta"]
    assert e["contributions"].where("source = 'graph'").count() > 0
    assert "admission" not in engine.execute("explain recall@1 harbour").explain
    alone = engine.execute("explain recall@1 entity:anna").explain
    assert alone["seeds"] == {"text": 0, "vector": 0, "graph": 0, "anchor": 2} and alone["background"] == 0
    a.close()


def test_when_carries_its_hits(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path), Config(half_life_s=-1, window_gamma=-1), lambda: T0)
    rows = [(0, "the regatta began", ["sea"], [], None, T0, [(datetime(2023, 5, 7, tzinfo=timezone.utc), datetime(2023, 5, 8, tzinfo=timezone.utc))], None)]
    e.store.remember(spark.createDataFrame(rows, REMEMBER))
    with e.when("regatta") as a:
        assert values(a) == ["the regatta began"] and a.text().splitlines()[0] == "when: 2023-05-07"
        assert a.text().splitlines()[1].startswith("- [said 2023-06-01, happened 2023-05-07] the regatta began (relevance ")
    assert e.when("zeppelin").warnings and e.recall("zeppelin").text() == "Nothing that is stored matches."
    assert e.describe("regatta").text().splitlines() == ["describe recall@0 regatta: 1 fact under 1 anchor, happened 2023-05-07", "topics:", "- [2023-05-07] sea: 1 fact", "entities: none"]
    assert "empty so far" in e.recall("x", graph=5).text() and e.fact("the regatta began")["value"] and e.fact("other") is None


def test_vectors_embedding_and_context(spark, tmp_path):
    told = []

    def embed(text):
        told.append(text)
        return [1.0, 0.0] if "north" in text else [0.0, 1.0]

    def extract(value, context):
        told.append(context)
        return [("topic", "Boats")]

    e = MemoryEngine(spark, str(tmp_path), Config(half_life_s=-1, window_gamma=-1), lambda: T0, embed, extract)
    e.remember("north mast")
    e.remember("south keel", topics=["b", "c"])
    assert told[1] == {"recent": [], "anchors": []} and e.context() == {"recent": ["north mast", "south keel"], "anchors": [("topic", "b"), ("topic", "boats"), ("topic", "c")]} or e.context()["anchors"][0][0] == "topic"
    assert values(e.recall("north wind"))[0] == "north mast" and told[-1] == "north wind"
    e.describe("keel")
    assert told[-1] == "north wind"  # a describe takes no vector
    with pytest.raises(QueryError, match="3 dimensions"):
        e.recall(vector=[1.0, 2.0, 3.0])
    with pytest.raises(DimensionError):
        e.remember("west", vector=[1.0])


def test_builders_read_back():
    from datetime import date

    from mnemos.plans.builders import BuildError, When, build_describe, build_recall, build_remember
    from mnemos.plans.language import parse, show

    for text in (
        build_recall(["harbour", "new york"], query="who's there?", topics=["o'brien", "top"], since=When("regatta", clock="said", top=2), until=date(2023, 5, 7), explain=True, graph=2, with_vector=True, with_since_vector=True),
        build_remember("it's tea", topics=["machine-learning"], said=T0, occurred=[date(2023, 5, 7), Interval(T0, None), Interval(T0, T0 + timedelta(days=1)), "2023-05"], graph=1), build_describe(), build_describe(["x"], top=3, depth=1),
    ):
        assert parse(show(parse(text))) == parse(text)
    assert parse(build_recall(query="a: b's (c)")).body.terms[0].text == "a: b's (c)"
    with pytest.warns(UserWarning):
        assert parse(build_recall(["since"])).body.terms[0].quoted
    for bad in (lambda: build_recall(), lambda: build_recall(topics="billing"), lambda: build_recall([" "]), lambda: build_recall(["x"], graph=256), lambda: build_remember(""), lambda: build_recall(["x"], since=3),
                lambda: build_recall(["x"], since=When()), lambda: build_recall(["x"], until=T0, with_until_vector=True), lambda: build_remember("x", occurred=T0), lambda: build_recall(["x"], top=0)):
        with pytest.raises(BuildError):
            bad()


def test_keys_in_the_jvm_and_in_python(spark):
    from pyspark.sql import functions as F

    from mnemos.functions.keys import _keyed_in_python, keyed

    df = spark.createDataFrame([("",), ("ünï" * 50,), (None,), ("a",)], "v string")
    rows = df.select("v", keyed("fact", F.col("v"), 7).alias("j"), _keyed_in_python("fact", F.col("v"), 7).alias("p")).collect()
    assert all(r["j"] == r["p"] == (None if r["v"] is None else key("fact", r["v"], 7)) for r in rows)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, f"fact {i}", ["t"], [], None, T0, None, None) for i in range(5)], REMEMBER).repartition(2).write.parquet(str(tmp_path / "in"))
    store = MemoryStore(spark, str(tmp_path / "m"), Config(stemming=False))
    for k in range(2):  # the second run sees everything again, and nothing changes
        q = ingest_stream(spark.readStream.schema(REMEMBER).parquet(str(tmp_path / "in")), store, str(tmp_path / f"c{k}"))
        q.awaitTermination(120)
        assert store.memory(0).facts.count() == 5 and store.memory(0).edges.count() == 5


def test_time_literals():
    now = T0
    assert parse_duration("2d").resolve(now) == Interval(now - timedelta(days=2), now - timedelta(days=2))
    assert parse_date("2023-12").end == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert parse_date("2023-05-07T10:00:00+02:00").start.hour == 8
    for bad in ("2023-13", "7", "2023-02-30", "x"):
        with pytest.raises(TimeError):
            parse_date(bad)
    day = Interval(T0, T0 + timedelta(days=1))
    assert day.overlaps(T0, None) and not day.overlaps(T0 + timedelta(days=1), None) and not day.overlaps(None, T0)
    assert Interval(T0, T0).overlaps(T0, None) and Interval(T0, None).overlaps(T0 + timedelta(days=99), None)
