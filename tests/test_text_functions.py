from datetime import datetime, timezone

from pyspark.sql import functions as F

from mnemos.functions import render
from mnemos.functions.porter2 import stem
from mnemos.operators import evaluation


def at(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def test_spans_on_the_driver_and_in_a_table(spark):
    cases = [
        (at(2023, 5, 1), at(2023, 6, 1), "2023-05"), (at(2023, 1, 1), at(2024, 1, 1), "2023"), (at(2023, 1, 1), at(2025, 1, 1), "2023..2024"), (at(2023, 5, 10), at(2023, 5, 17), "2023-05-10..2023-05-16"),
        (at(2023, 5, 7), at(2023, 5, 8), "2023-05-07"), (at(2023, 5, 7, 8), at(2023, 5, 7, 8), "2023-05-07"), (at(2023, 5, 7), None, "2023-05-07.."), (at(2023, 5, 1), at(2023, 8, 1), "2023-05..2023-07"), (at(2023, 5, 1), at(2024, 1, 1), "2023-05..2023-12"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "s timestamp, e timestamp").select(render.span(F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases] == [render.span_text(a, b) for a, b, _ in cases]


def test_stems():
    # fixed values: words and stems of the published vocabulary
    pairs = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consistency": "consist", "consolation": "consol", "consolidating": "consolid", "constables": "constabl", "knackeries": "knackeri",
        "knavish": "knavish", "kneaded": "knead", "kneeling": "kneel", "knightly": "knight", "knitting": "knit", "knots": "knot", "happiness": "happi", "generously": "generous", "skies": "sky", "dying": "die", "national": "nation",
        "rationalization": "ration", "controlling": "control", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "by": "by", "say": "say", "succeeding": "succeed", "news": "news", "inning": "inning", "communication": "communic",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_conversations_and_questions(spark):
    turns = spark.createDataFrame(
        [("C1", 2, "D2:1", "Anna  Ray!", "it's me", None, at(2023, 5, 7)), ("C1", 2, "D2:2", "Bo", None, "a boat", at(2023, 5, 7)), ("C1", 2, "D2:3", None, "x", "", None), (None, 1, "D1:1", "Bo", "x", "", None)],
        "conversation string, session int, turn string, speaker string, text string, caption string, session_at timestamp",
    )
    rows = {r["turn"]: r for r in evaluation.turns_to_remember(turns, 4).collect()}
    assert set(rows) == {"D2:1", "D2:2"} and rows["D2:1"]["value"] == "Anna  Ray!: it\u2019s me" and rows["D2:2"]["value"] == "Bo:  [shared image: a boat]"
    assert rows["D2:1"]["topics"] == ["conv-c1", "session-2"] and rows["D2:1"]["entities"] == ["anna-ray"] and rows["D2:1"]["graph_id"] == 4
    asked = spark.createDataFrame([(1, "C1", "What's up, Bo?", ["D8:6; D9:17", "D:11:26"]), (2, "C1", "lost", ["none"]), (3, "C1", "null", None)], "question_id bigint, conversation string, question string, evidence array<string>")
    found = evaluation.questions_to_recalls(asked)
    assert [(r.query_id, r.keywords, r.topics, r.top) for r in found] == [(1, ("What", "s", "up", "Bo"), ("conv-c1",), 10)]
    assert {r["turn"] for r in evaluation.evidence(asked).collect()} == {"D8:6", "D9:17"}


def test_gate(spark):
    names = "category string, recall double, f1 double"
    base = spark.createDataFrame([(None, 0.9, 0.5), ("a", 0.8, None)], names)
    head = spark.createDataFrame([(None, 0.899, 0.4), ("a", 0.7, 0.1)], names)
    got = {(r["category"], r["metric"]) for r in evaluation.dropped(base, head, ["category"], ["recall", "f1"]).collect()}
    assert got == {(None, "f1"), ("a", "recall")}
    assert evaluation.dropped(base, base, ["category"], ["recall"]).isEmpty() and evaluation.dropped(base.limit(0), head, ["category"], ["recall"]).isEmpty()
