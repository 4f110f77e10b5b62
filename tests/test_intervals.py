import random

import pytest

from mnemos.operators.intervals import gaps, periods

KIND = "k string, s bigint, e bigint, __t int, gap int"


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and (e is None or e >= s):
            by.setdefault(k, []).append((s, float("inf") if e is None else e))
    out_p, out_g = set(), set()
    for k, xs in by.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out_p |= {(k, s, None if e == float("inf") else e) for s, e in merged}
        out_g |= {(k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out_p, out_g


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_against_brute_force(spark, hot):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(6)}", s := r.randrange(400), s + r.choice([0, 0, 1, 5, 20, -3])) for _ in range(220)]
    rows += [("open", 3, None), ("open", 1, 2), ("open", 9, 9), (None, 1, 2), ("none", None, 3), ("turned", 5, 4), ("touch", 1, 2), ("touch", 2, 3), ("touch", 3, 3)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + rows[:30]], KIND)
    want_p, want_g = brute(rows)
    assert {tuple(x) for x in periods(df, ["k"], "s", "e", hot_rows=hot, slices=4).collect()} == want_p
    got = [tuple(x) for x in gaps(df, ["k"], "s", "e", hot_rows=hot, slices=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want_g


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], KIND)
    assert periods(df, ["k"], "s", "e").isEmpty() and gaps(df, ["k"], "s", "e").isEmpty()
    with pytest.raises(ValueError, match="name of a result column"):
        gaps(df.withColumnRenamed("k", "gap_end"), ["gap_end"], "s", "e")
