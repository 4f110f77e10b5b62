import random
from pathlib import Path

import pytest

from mnemos.operators import forest, vectors
from mnemos.session import shared_dir


def rows(n, dim=6, seed=1):
    r = random.Random(seed)
    return [(i % 2, i, [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def test_exact_distances_broadcast_or_in_slices(spark):
    data = rows(60) + [(0, 900, [1.0]), (0, 901, None)]
    vecs = spark.createDataFrame(data, "graph_id smallint, fact_key bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, 0, data[0][2]), (2, 1, data[1][2]), (3, 7, data[0][2])], "query_id bigint, graph_id smallint, vector array<double>")
    few, many = ({(r["query_id"], r["fact_key"]): round(r["distance"], 9) for r in vectors.nearest_exact(asked, vecs, n).collect()} for n in (3, 1_000_000))
    assert few == many and len(few) == 60 and few[1, 0] == 0.0


def test_forest(spark):
    data = rows(1200) + [(0, 5000 + i, [9.0] * 6) for i in range(150)] + [(0, 9000, None), (0, 9001, [1.0])]
    vecs = spark.createDataFrame(data, "graph_id smallint, fact_key bigint, embedding array<double>")
    index = tuple(t.cache() for t in forest.build(vecs, 6, trees=3, leaf_rows=40))
    leaves = index[0].collect()
    assert len({(r["tree"], r["fact_key"]) for r in leaves}) == len(leaves) == 3 * 1350
    sizes = index[0].where("fact_key < 5000").groupBy("tree", "graph_id", "node").count().collect()
    assert max(r["count"] for r in sizes) <= 80
    asked = spark.createDataFrame([(i, i % 2, data[i][2]) for i in range(20)], "query_id bigint, graph_id smallint, vector array<double>")
    got = {}
    for wide in (4, 200):
        got[wide] = {(r["query_id"], r["fact_key"]) for r in forest.nearest(asked, vecs, index, 6, k=5, overfetch=wide).collect()}
    want = set()
    for i in range(20):
        d = sorted((sum((a - b) ** 2 for a, b in zip(data[i][2], v)), k) for g, k, v in data if g == i % 2 and v is not None and len(v) == 6)
        want |= {(i, k) for _, k in d[:5]}
    assert got[200] == want and len(got[4] & want) >= 0.5 * len(want)
    assert forest.nearest(asked, vecs.limit(0), forest.build(vecs.limit(0), 6), 6).isEmpty()


def brute(data, asked, k):
    want = set()
    for q, g, x in asked:
        d = sorted((sum((a - b) ** 2 for a, b in zip(x, v)), key) for h, key, v in data if g == h)
        want |= {(q, g, key) for _, key in d[:k]}
    return want


def test_forest_writes_less_than_its_vectors(spark):
    data = rows(4000, dim=32, seed=3)
    vecs = spark.createDataFrame(data, "graph_id smallint, fact_key bigint, embedding array<double>")
    written = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before = written()
    leaves, splits = forest.build(vecs, 32, trees=4, leaf_rows=16)
    assert leaves.count() == 4 * 4000 and splits.agg({"level": "max"}).first()[0] >= 6
    assert written() - before < 4000 * 32 * 8


@pytest.mark.parametrize("small", [False, True])
def test_forest_is_exact_on_request(spark, monkeypatch, small):
    if small:  # graphs larger than a task, in many slices and blocks
        monkeypatch.setattr(forest, "GROWN", 6 * 100)
        monkeypatch.setattr(forest, "SEARCHED", 6 * 70)
        monkeypatch.setattr(forest, "BLOCK", 4)
    data = [(0, i, v) for _, i, v in rows(900)] + [(1, i, v) for _, i, v in rows(400, seed=2)]
    data += [(0, 5000 + i, [3.0] * 6) for i in range(150)] + [(0, 6000 + i, [40.0 + x for x in v]) for _, i, v in rows(300, seed=4)]
    vecs = spark.createDataFrame(data + [(0, 5000, [2.0] * 6), (2, 1, None)], "graph_id smallint, fact_key bigint, embedding array<double>")
    index = tuple(t.cache() for t in forest.build(vecs, 6, trees=2, leaf_rows=20))
    leaves = [(r["graph_id"], r["fact_key"], r["tree"]) for r in index[0].collect()]
    assert len(set(leaves)) == len(leaves) == 2 * len(data)
    assert max(r["count"] for r in index[0].where("fact_key < 5000").groupBy("tree", "graph_id", "node").count().collect()) <= 40
    asked = [(i, g, data[i][2]) for i in range(12) for g in (0, 1)] + [(50, 0, [3.0] * 6), (51, 0, [40.0] * 6), (52, 7, [0.0] * 6), (53, 2, [0.0] * 6)]
    questions = spark.createDataFrame([*asked, (54, 0, [1.0])], "query_id bigint, graph_id smallint, vector array<double>")
    got = {wide: {(r["query_id"], r["graph_id"], r["fact_key"]) for r in forest.nearest(questions, vecs, index, 6, k=5, overfetch=2, exact=wide).collect()} for wide in (False, True)}
    want = brute(data, asked, 5)
    assert got[True] == want and 0.2 * len(want) < len(got[False] & want) < len(want)
