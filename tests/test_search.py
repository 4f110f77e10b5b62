"""Worked examples with known scores."""

from datetime import datetime, timedelta, timezone

import pytest

from mnemos.model import Config
from mnemos.operators.ingest import memory_of
from mnemos.plans.search import Recall, search

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = (
    "remember_id bigint, graph_id smallint, fact_key bigint, value string, topics array<string>, entities array<string>,"
    " said_at timestamp, written_at timestamp, occurred array<struct<start_at:timestamp,end_at:timestamp>>"
)


def log(spark, facts):
    rows = [(i, 0, i, v, t, e, None, T0 + timedelta(seconds=i), None) for i, (v, t, e) in enumerate(facts, 1)]
    return spark.createDataFrame(rows, LOG)


_MEMORIES = {}


def recall(spark, facts, q, vectors=None, **config):
    if id(facts) not in _MEMORIES:
        _MEMORIES[id(facts)] = memory_of(log(spark, facts), vectors).kept(), facts
    m = _MEMORIES[id(facts)][0]
    return search(m, [q], Config(half_life_s=-1, **config), now=T0)


def scores(found):
    return {r["value"]: round(r["score"], 4) for r in found.hits.collect()}


LANES = [
    ("acme sent the march invoice", ["billing"], ["acme"]),
    ("acme renewed its support contract", [], ["acme"]),
    ("the april invoice is overdue", ["billing"], []),
    ("the may invoice was paid by card", ["billing"], []),
    ("billing closes on the last friday of the month", ["billing"], []),
    ("the supplier invoice arrived by post", ["suppliers"], []),
    ("the supplier list is kept on the shared drive", ["suppliers"], []),
    ("scan every invoice on the office printer", ["office"], []),
    *(
        (v, ["office"], [])
        for v in (
            "the office opens at eight", "the office kitchen has a new kettle", "office plants are watered on mondays", "the office wifi password changed",
            "visitors sign in at the office desk", "the office closes for the holidays", "the office fire drill is on thursday", "the office lift is out of order",
        )
    ),
]


def test_lanes_without_window(spark):
    found = recall(spark, LANES, Recall(("invoice",), entities=("acme",), depth=1), window_gamma=-1)
    assert scores(found) == {
        "acme renewed its support contract": 2.6592, "billing closes on the last friday of the month": 2.2381, "the april invoice is overdue": 1.8701,
        "the supplier invoice arrived by post": 1.6183, "the may invoice was paid by card": 1.6183, "acme sent the march invoice": 1.6183, "scan every invoice on the office printer": 1.4136,
    }
    assert [r["value"] for r in found.hits.orderBy("place").collect()][3] == "the supplier invoice arrived by post"
    assert round(found.rates.first()["rate"], 4) == 0.3968


PARROT = [
    ("the parrot sleeps in the kitchen", [], ["polly"]),
    ("the parrot eats sunflower seeds", [], ["polly"]),
    ("polly says hello to every visitor", [], ["polly"]),
    ("the kitchen window faces east", [], []),
]


def test_lending_window(spark):
    found = recall(spark, PARROT, Recall(("parrot", "kitchen"), entities=("polly",)))
    assert scores(found) == {
        "the parrot sleeps in the kitchen": 2.4656, "polly says hello to every visitor": 2.3019, "the parrot eats sunflower seeds": 1.751, "the kitchen window faces east": 1.0,
    }
    text = {r["fact_key"]: (round(r["score"], 4), r["held"]) for r in found.contributions.where("source = 'text'").collect()}
    assert {k: v[0] for k, v in text.items()} == {1: 1.4572, 3: 0.1145, 2: 0.8757, 4: 0.3461}
    g = found.contributions.where("source = 'graph'").first()
    assert (round(g["score"], 4), g["degree"], g["named"]) == (2.4474, 3, True)


def test_lone_candidate_scores_its_mass(spark):
    assert scores(recall(spark, PARROT, Recall(("window",)))) == {"the kitchen window faces east": 1.203}


def test_stemmed_terms_and_neighbours(spark):
    facts = [(v, [], ["anna"]) for v in ("anna ran the charity race", "anna trained for the race", "anna ran the harbour drills", "anna moors the boat at the east quay")]
    found = recall(spark, facts, Recall(("charity race",), top=1))
    hit = found.hits.first()
    assert (hit["value"], round(hit["score"], 4)) == ("anna ran the charity race", 2.1313)
    assert sorted(r["term"] for r in found.terms.collect()) == ["chariti", "race"]
    assert found.seeds.count() == 3


def test_anchors_alone_and_vector(spark):
    found = recall(spark, LANES, Recall(entities=("acme",), topics=("billing", "missing")))
    assert {r["value"]: r["mass"] for r in found.pool.collect()}["acme sent the march invoice"] == 2.0
    assert all(r["seed"] for r in found.hits.collect()) and found.hits.count() == 5
    vec = spark.createDataFrame([(0, 1, [0.0, 1.0]), (0, 2, [1.0, 0.0])], "graph_id smallint, fact_key bigint, embedding array<double>")
    two = [("north mast", [], []), ("south keel", [], [])]
    found = recall(spark, two, Recall(("north", "keel"), (0.0, 1.0)), vec)
    assert found.extra["missed"].first()["missed"] == pytest.approx(1.0)
    assert found.hits.orderBy("place").first()["value"] == "north mast"


def test_scorers_traversals_and_cutoff(spark):
    q = Recall(("invoice",), entities=("acme",), depth=2)
    for scorer in ("excess", "rrf"):
        assert recall(spark, LANES, q, scorer=scorer).hits.count() > 0
    assert recall(spark, LANES, q, traversal="none").contributions.where("source = 'graph'").isEmpty()
    assert recall(spark, LANES, q, traversal="bfs").contributions.where("source = 'graph'").count() > 0
    assert recall(spark, LANES, q, min_score_ratio=1.0).hits.count() == 1
    assert recall(spark, LANES, Recall(("invoice",)), relevance="matchcount", window_gamma=-1).hits.count() == 5


def test_window_and_batch(spark):
    recall(spark, LANES, Recall(("invoice",)))
    m = _MEMORIES[id(LANES)][0]
    late = Recall(("invoice",), since=T0 + timedelta(seconds=5), query_id=1)
    free = Recall(("invoice",), query_id=2)
    both = search(m, [late, free], Config(half_life_s=-1), now=T0).hits
    lone = search(m, [free], Config(half_life_s=-1), now=T0).hits
    assert {r["fact_key"] for r in both.where("query_id = 1").collect()} == {6, 7, 8, 9}
    assert both.where("query_id = 1").where("fact_key < 5").isEmpty()
    rows = lambda df: sorted((r["value"], round(r["score"], 9)) for r in df.collect())
    assert rows(both.where("query_id = 2")) == rows(lone)
