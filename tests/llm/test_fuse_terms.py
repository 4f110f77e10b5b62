import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from mnemos.llm.fuse import fuse_scores, inverse_normal, leading
from mnemos.llm.terms import distinctiveness, document_frequency, graph_of_words, most_distinctive

KIND = "q bigint, i bigint, s string, x double, place int, fused double, __n int"


def test_inverse_normal(spark):
    ps = [i / 1000 for i in range(1, 1000)] + [1e-6, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert max(abs(g - NormalDist().inv_cdf(p)) for g, p in zip(got, ps)) < 1e-7


def brute(rows, weights):
    best, items = {}, set()
    for q, i, s, x in rows:
        if q is None or i is None:
            continue
        items.add((q, i))
        if s in weights and x is not None and math.isfinite(x):
            best[q, s, i] = max(x, best.get((q, s, i), -math.inf))
    z, out = NormalDist().inv_cdf, dict.fromkeys(items, 0.0)
    for (q, s, i), x in best.items():
        xs = [v for (a, b, _), v in best.items() if (a, b) == (q, s)]
        place = sum(v < x for v in xs) + (sum(v == x for v in xs) + 1) / 2
        out[q, i] += weights[s] / sum(weights.values()) * (z(place / (len(xs) + 1)) - z(1 / (2 * (len(xs) + 1))))
    return out


@pytest.mark.parametrize("hot", [1_000_000, 10])
def test_fuse_against_brute_force(spark, hot):
    r = random.Random(2)
    rows = [(1 if r.random() < 0.5 else r.randrange(4), r.randrange(25), r.choice(["a", "b", "c"]), r.choice([None, math.nan, math.inf, 1.0, 2.0, r.gauss(0, 9), 10 ** r.uniform(0, 9)])) for _ in range(260)]
    rows += [(None, 1, "a", 1.0), (1, None, "a", 1.0), (9, 1, None, 1.0), (9, 2, "a", None), *rows[:20]]
    weights = {"a": 2.0, "b": 1.0}
    df = spark.createDataFrame([(*x, 1, 2.0, 3) for x in rows], KIND)
    got = {(x["q"], x["i"]): x["fused"] for x in fuse_scores(df, "q", "i", "s", "x", weights, hot_rows=hot, slices=4).collect()}
    want = brute(rows, weights)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fuse_cases(spark):
    empty = spark.createDataFrame([], KIND)
    assert fuse_scores(empty, "q", "i", "s", "x", {"a": 1.0}).isEmpty()
    for bad in ({}, {"a": 0.0}, {"a": -1.0, "b": 3.0}):
        with pytest.raises(ValueError, match="weights"):
            fuse_scores(empty, "q", "i", "s", "x", bad)
    scaled = [(1, i, "a", float(i)) for i in range(5)] + [(1, i, "b", 1e9 * (5 - i)) for i in range(5)]
    df = spark.createDataFrame([(*x, 0, 0.0, 0) for x in scaled], KIND)
    got = [r["fused"] for r in fuse_scores(df, "q", "i", "s", "x", {"a": 1.0, "b": 1.0}).orderBy("i").collect()]
    assert got == pytest.approx(got[::-1])  # neither range decides
    assert [r["i"] for r in leading(fuse_scores(df, "q", "i", "s", "x", {"a": 1.0}), "q", "i", "fused", 2).orderBy("place").collect()] == [4, 3]


def test_graph_of_words(spark):
    r = random.Random(3)
    texts = {i: " ".join(r.choice("abcdefg") for _ in range(r.randrange(30))) for i in range(30)} | {100: None, 101: "", 102: "?!", 103: "x x x", 104: "Ab, aB; c3", 105: "long " * 20_000 + "end"}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "id bigint, t string, term int, degree int")
    got = {(x["id"], x["term"]): (x["degree"], x["tf"]) for x in graph_of_words(df, ["id"], "t", 3).collect()}
    want = {}
    import re

    for k, v in texts.items():
        w = re.findall(r"[^\W_]+", (v or "").lower())
        for t in set(w):
            near = {w[j] for i, a in enumerate(w) if a == t for j in range(max(0, i - 2), min(len(w), i + 3)) if w[j] != t}
            want[k, t] = (len(near), w.count(t))
    assert got == want


def test_distinctive_terms(spark):
    posts = spark.createDataFrame([(1, "the", 2), (2, "the", 1), (3, "the", 1), (1, "rare", 1), (1, "rare", 1), (2, "gone", 0), (None, None, 1), (4, "the", 1)], "id bigint, w string, n int")
    df = document_frequency(posts, ["id"], "w", "n")
    assert {r["term"]: r["df"] for r in df.collect()} == {"the": 4, "rare": 1}
    total = spark.createDataFrame([(4,)], "n bigint")
    recs = spark.createDataFrame([(1, "the rare the thing the rare the"), (2, None)], "id bigint, t string")
    top = most_distinctive(distinctiveness(recs, ["id"], "t", df, total), ["id"]).collect()
    assert [(r["id"], r["term"], r["degree"]) for r in top] == [(1, "rare", 2)]
    none = spark.createDataFrame([(0,)], "n bigint")
    assert {r["score"] for r in distinctiveness(recs, ["id"], "t", df.limit(0), none).collect()} == {0.0}
