import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemos.llm import names, nearest, similar
from mnemos.llm.components import components


def exact(vs, k, radius):
    by = defaultdict(list)
    for i, g, e in vs:
        if i is not None and g is not None and e is not None and len(e) == 8 and all(x is not None and np.isfinite(x) for x in e) and any(e):
            by[g].append((i, np.array(e, np.float32).astype(float)))
    out = set()
    for rows in by.values():
        for i, e in rows:
            d = sorted({(float(np.sqrt(((e - f) ** 2).sum())), j) for j, f in rows if j != i})
            out |= {(i, j) for x, j in d[:k] if x <= radius}
    return out


@pytest.mark.parametrize("bucket_rows", [4000, 12])
def test_nearest_recall(spark, bucket_rows):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8))
    vs = [(i, i % 2, [float(x) for x in np.float32(centres[i % 20] + r.normal(size=8) * 0.05)]) for i in range(300)]
    vs += [(1000 + i, 0, vs[0][2]) for i in range(30)] + [(2000, 0, None), (2001, 0, [1.0] * 7), (2002, 0, [float("nan")] * 8), (2003, 0, [0.0] * 8), (None, 0, vs[1][2]), (2004, None, vs[1][2])]
    vs += [(3000 + i, 1, vs[i][2]) for i in range(0, 40, 2)] + vs[:25]
    df = spark.createDataFrame([(*v, 1.0, 2) for v in vs], "id bigint, g int, e array<float>, distance double, place int")
    got = {(x["id"], x["other"]) for x in nearest.nearest(df, "id", "e", "g", k=5, dim=8, radius=0.6, bucket_rows=bucket_rows).collect()}
    want = exact(dict.fromkeys((i, g, tuple(e) if e else None) for i, g, e in vs), 5, 0.6)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    copies = {(a, b) for a, b in want if a >= 1000 and b >= 1000 and a < 2000}
    assert copies <= got
    assert nearest.nearest(df.limit(0), "id", "e", "g", dim=8).isEmpty()


@pytest.mark.parametrize("bucket_rows", [4000, 600, 40])
def test_nearest_without_a_radius_is_complete(spark, bucket_rows):
    r = np.random.default_rng(2)
    vs = [(i, i % 5 // 4, [float(x) for x in np.float32(r.normal(size=8))]) for i in range(1000)]
    vs += [(2000 + i, vs[i][1], vs[i][2]) for i in range(30)]
    df = spark.createDataFrame(vs, "id bigint, g int, e array<float>")
    rows = nearest.nearest(df, "id", "e", "g", k=10, dim=8, bucket_rows=bucket_rows).collect()
    assert {(x["id"], x["other"]) for x in rows} == exact(vs, 10, np.inf) and len(rows) == 10 * len(vs)


@pytest.mark.parametrize(("radius", "bucket_rows"), [(None, 4000), (None, 300), (5.0, 4000)])
def test_nearest_ties_go_to_the_smaller_id(spark, radius, bucket_rows):
    # all corners of a small cube are as far from its middle, and all lie in one bucket
    corners = [[1.0 if i >> b & 1 else -1.0 for b in range(10)] + [900.0] for i in range(1024)]
    vs = [(i * 37 % 1024, 0, e) for i, e in enumerate(corners)] + [(5000, 0, [0.0] * 10 + [900.0])]
    df = spark.createDataFrame(vs, "id bigint, g int, e array<float>")
    rows = nearest.nearest(df, "id", "e", "g", k=5, dim=11, radius=radius, bucket_rows=bucket_rows, rotations=1, tables=1, probes=1).where("id = 5000").collect()
    assert sorted((x["place"], x["other"]) for x in rows) == [(i + 1, i) for i in range(5)]


def test_neighbours_of_vectors_far_from_all_others(spark, tmp_path):
    r = np.random.default_rng(4)
    vs = [(i, 1, [float(x) for x in np.float32(r.normal(size=64))]) for i in range(60)]
    spark.createDataFrame(vs, "vec_id bigint, graph_id smallint, embedding array<float>").write.parquet(str(tmp_path / "vectors.parquet"))
    rows = nearest.p2_neighbours(spark, str(tmp_path)).collect()
    assert len(rows) == 600 and min(x["distance"] for x in rows) > 0.5
    assert nearest.p2_found(spark, str(tmp_path)).isEmpty()


WORDS = re.compile(r"[^\W_]+")


def overlap(a, b):
    x, y = Counter(WORDS.findall(a.lower())), Counter(WORDS.findall(b.lower()))
    c = (x & y).total()
    return c / (x.total() + y.total() - c)


def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 9, 15, 40, 140]))]
        for _ in range(3):
            t = list(base)
            for _ in range(r.randrange(1 + len(t) // 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            r.random() < 0.3 and r.shuffle(t)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("hot", "rows", "long"), [(200, 8000, 128), (3, 8000, 30), (3, 6, 128)])
def test_similar_pairs_lose_nothing(spark, monkeypatch, hot, rows, long):
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "LONG", long)
    monkeypatch.setattr(similar, "LEAF", 4)
    ts = texts()
    data = [(i, t, 0) for i, t in enumerate(ts)] + [(900, None, 0), (901, "", 0), (902, " ?! ", 0), (903, ts[0].upper(), 0), (904, ts[0] + "!", 0), (905, "word " * 5000, 0), (906, "word " * 4000, 0), (None, ts[1], 0)]
    df = spark.createDataFrame(data + data[:9], "id bigint, t string, common int")
    got = {(x["a"], x["b"]): (x["common"], x["joint"]) for x in similar.similar_pairs(df, "id", "t", "0.7", rows).collect()}
    good = [(i, t) for i, t, _ in data if i is not None and t and WORDS.search(t)]
    want = {(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if overlap(x, y) >= 0.7 - 1e-12}
    assert got.keys() == want and (905, 906) in got and got[905, 906] == (4000, 5000)


@pytest.mark.parametrize(("threshold", "rows"), [("0.5", 8000), ("0.3", 8000), ("0.3", 60)])
def test_similar_pairs_by_one_frequent_word(spark, threshold, rows):
    data = [(0, "a")] + [(i, f"a b{i}") for i in range(1, 231)] + [(1000 + i, f"a c{i} b{i} d") for i in range(1, 41)]
    assert len(data) > similar.HOT
    got = {(x["a"], x["b"]) for x in similar.similar_pairs(spark.createDataFrame(data, "id bigint, t string"), "id", "t", threshold, rows).collect()}
    assert got == {(a, b) for k, (a, x) in enumerate(data) for b, y in data[k + 1 :] if overlap(x, y) >= float(threshold) - 1e-12} and (0, 1) in got


def test_similar_groups_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f h"), (3, "a b c d e i h"), (4, "z"), (5, "Z!"), (6, None)], "id bigint, t string")
    got = {r["id"]: (r["class"], r["links"], r["group"]) for r in similar.similar_groups(df, "id", "t").collect()}
    assert got == {1: (1, 1, 1), 2: (2, 2, 1), 3: (3, 1, 1), 4: (4, 0, 4), 5: (4, 0, 4)}
    assert similar.similar_pairs(df.limit(0), "id", "t").isEmpty()


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(400, 400), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}


def test_names(spark):
    rows = [
        (1, "robert tunoviposon"), (2, "Tunoviposon, Bob"), (3, "ROBERT  TUNOIVPOSON"), (4, "R. Tunoviposon"), (5, "Dr. Robert B. Tunovíposon"), (6, "roberttunoviposon"), (7, "susanna tunoviposon"),
        (8, "S Tunoviposon"), (20, "margaret kepebymeford"), (21, "michael kepebymeford"), (22, "M. Kepebymeford"), (30, "huvupesy manufacturing limited"), (31, "The Huvupesy Mfg. Ltd"),
        (32, "huvupesy shipping limited"), (33, "Manufacturing Huvupsey Company"), (40, None), (41, " ? "), (42, ""), (50, "w kolihuta"), (51, "W. Kolihuta"), (1, "robert tunoviposon"),
    ]
    df = spark.createDataFrame([(i, 1, v, 0) for i, v in rows] + [(60, 2, "robert tunoviposon", 0), (61, None, "x y", 0)], "id bigint, g int, v string, entity int")
    for block in (3000, 3):
        got = {r["id"]: r["entity"] for r in names.link_names(df, "id", "v", "g", block).collect()}
        groups = defaultdict(set)
        for i, e in got.items():
            groups[e].add(i)
        assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5, 6], [7, 8], [20], [21], [22], [30, 31, 33], [32], [50, 51], [60]]
    assert names.link_names(df.limit(0), "id", "v", "g").isEmpty()


def test_names_in_any_order(spark):
    rows = [
        (1, "Zoltan Kepebymeford"), (2, "Kepebymeford, Zoltan"), (3, "KEPEBYMEFROD ZOLTAN"), (4, "Bela Kepebymeford"), (5, "Kepebymeford, Bela"),
        (10, "Blue Harbour Shipping"), (11, "Harbour Blue Shpg"), (12, "Harbour Glue Shipping"), (13, "Harbour Blue Trading"),
        (20, "robert maria tunoviposon"), (21, "Tunoviposon, Bob Maria"), (30, "north west amber river mills ltd"), (31, "Amber Mills North River West Ltd"),
    ]
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "id bigint, g int, v string")
    for block in (3000, 3):
        groups = defaultdict(set)
        for r in names.link_names(df, "id", "v", "g", block).collect():
            groups[r["entity"]].add(r["id"])
        assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [10, 11, 12], [13], [20, 21], [30, 31]]


def test_jaro_winkler():
    for a, b, want in (("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "", 1.0), ("a", "", 0.0)):
        assert names.jaro_winkler(a, b) == pytest.approx(want, abs=1e-4)
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abcd", "xyzw", 2) == 3


def test_names_in_no_list_in_any_order(spark):
    rows = [
        (1, "Haruki Tanaka"), (2, "Tanaka, Haruki"), (3, "Wei Zhang"), (4, "Zhang Wei"), (5, "Anna Maria Lopez"), (6, "Lopez, Anna Maria"), (7, "Juan Carlos Ortega"), (8, "Ortega Juan Carlos"),
        (9, "Harbor Northwind Ltd"), (10, "Northwind Harbor Ltd"),
    ]
    got = {r["id"]: r["entity"] for r in names.link_names(spark.createDataFrame(rows, "id bigint, v string"), "id", "v").collect()}
    assert all(got[i] == got[i + 1] for i in range(1, 10, 2)) and len(set(got.values())) == 5


def test_names_drawn_at_random(spark):
    """Given names, surnames and firms made of random syllables, typed with one slip, in another order or another case."""
    r = random.Random(12)
    made = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n))
    truth, rows = {}, []
    for e in range(80):
        first, last = (made(3), made(4)) if e % 4 else (f"{made(3)} {made(3)}", "Holdings")
        at = r.randrange(1, len(last) - 2)
        slip = last[:at] + last[at + 1] + last[at] + last[at + 2 :]
        for v in (f"{first} {last}", f"{last} {first}".upper(), f"{first} {slip}" if e % 4 else f"{first} hldgs", f"  {first.title()}   {last}"):
            truth[len(rows)] = e
            rows.append((len(rows), v))
    got = {x["id"]: x["entity"] for x in names.link_names(spark.createDataFrame(rows, "id bigint, v string"), "id", "v").collect()}
    same = [(i, j) for i in truth for j in truth if i < j and truth[i] == truth[j]]
    apart = [(i, j) for i in truth for j in truth if i < j and truth[i] != truth[j]]
    assert sum(got[i] == got[j] for i, j in same) >= 0.97 * len(same) and sum(got[i] == got[j] for i, j in apart) <= 0.001 * len(apart)


def test_hashing_alone_and_with_the_exact_pass(spark):
    """Hashing finds the near ones; the exact pass makes the rest whole, questions and settled vectors in blocks of their own."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(6, 8))
    vs = [(i, 0, [float(x) for x in np.float32(centres[i % 6] + r.normal(size=8) * 0.01)]) for i in range(240)] + [(1000 + i, 0, [float(x) for x in np.float32(r.normal(size=8))]) for i in range(200)]
    df = spark.createDataFrame(vs, "id bigint, g int, e array<float>")
    want = exact(vs, 5, np.inf)
    for rows in (4000, 50):
        got = {(x["id"], x["other"]) for x in nearest.nearest(df, "id", "e", "g", k=5, dim=8, bucket_rows=rows).collect()}
        assert len(got & want) >= 0.999 * len(want) and len(got) == len(want)
    alone = {(x["id"], x["other"]) for x in nearest.nearest(df, "id", "e", "g", k=5, dim=8, settle=False).collect()}
    near = {(a, b) for a, b in want if a < 1000}
    assert len(alone & near) >= 0.97 * len(near) and len(alone & want) < len(want)


def test_tables_and_rotations_follow_angle_and_size():
    p = [nearest._meeting(a, 64, 2, 2, 17) for a in (0.1, 0.3, 0.6)]
    assert p[0] > p[1] > p[2] and nearest._meeting(0.3, 64, 3, 2, 17) < p[1]
    tables = [nearest._tables_for(a, 64, r, 2, 17) for a, r in ((0.1, 2), (0.3, 2), (0.3, 3), (0.5, 3))]
    assert tables == sorted(tables) and tables[0] < tables[-1]
    assert nearest._settled_angle(64, 3, 2, 2, 17) < nearest._settled_angle(64, 8, 2, 2, 17)


@pytest.mark.parametrize("threshold", ["0.2", "0.4", "0.5", "0.7", "0.9"])
def test_similar_pairs_at_any_threshold(spark, threshold):
    """One word in all texts, words in many and in one, short texts and long ones."""
    r = random.Random(3)
    data = [(i, f"the w{i}") for i in range(300)] + [(500, "the")] + [(600 + i, " ".join(r.choice(["the", "of", "x", "y", f"u{i}"]) for _ in range(r.choice([2, 3, 8])))) for i in range(60)]
    got = {(x["a"], x["b"]) for x in similar.similar_pairs(spark.createDataFrame(data, "id bigint, t string"), "id", "t", threshold).collect()}
    assert got == {(a, b) for k, (a, x) in enumerate(data) for b, y in data[k + 1 :] if overlap(x, y) >= float(threshold) - 1e-12}
