"""The most similar vectors of every vector.

Method: cross-polytope hashing. Unit vectors go through fast pseudo-random
rotations (random signs and a Hadamard transform, three times) and are assigned
to the nearest signed axis; a bucket is the axes of several rotations. Each
vector lies in its bucket of every table and also looks into the bucket next to
it, where the rotation with the narrowest decision takes its second-best axis
(multiprobe). Candidates of a bucket are ranked by their exact distance.

The number of rotations follows the largest group, so that a bucket of an even
collection stays small at any size; the number of tables follows from the chance
that vectors at the largest angle asked for meet, which is simulated.

Crowded regions put many vectors into one bucket. No finer hash tells their
nearest apart reliably, so a bucket above ``bucket_rows`` is compared in pairs of
blocks, each a task of its own, which is exact. Nothing is dropped.

Hashing finds near vectors only. Without a radius the nearest of a vector in an
empty region count too. What hashing found then settles the vectors whose k-th
neighbour is so near that the tables miss a pair at that angle once in a thousand
times or less. The others are the questions of a second, exact pass against all
vectors of their group, in blocks.

Equal vectors are hashed once, as one class, and expanded at the end; a class of
any size adds at most k + 1 of its ids to the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.llm.grouped import bounds, in_blocks, over_groups, pairs_within
from mnemos.session import cut
from mnemos.sources.tables import table

PROBES = 2
EVEN_ROWS = 1_000  # rows of a bucket of an evenly spread group above which one more rotation is taken
MEET = 0.95  # chance that two vectors at the largest angle asked for share a bucket
SETTLED = 0.999  # the same at the angle up to which hashing alone is believed
NEAR = 0.3  # the angle the tables are made for where no radius gives one
BUCKET_ROWS = 4_000
BLOCK = 512  # rows of a bucket from which distances are found by matrix products


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def _codes(unit: np.ndarray, tables: int, rotations: int, probes: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(table, probe, code of each vector); probe 0 is home."""
    width = 1 << (unit.shape[1] - 1).bit_length()
    padded = np.zeros((len(unit), width), np.float32)
    padded[:, : unit.shape[1]] = unit
    rows = np.arange(len(unit))
    for t in range(tables):
        signs = np.random.default_rng([seed, t]).choice(np.array([-1, 1], np.float32), (rotations, 3, width))
        best, gap, other = [], [], []
        for r in range(rotations):
            x = padded
            for s in signs[r]:
                x = _hadamard(x * s)
            size = np.abs(x)
            first = size.argmax(axis=1)
            top = size[rows, first]
            size[rows, first] = -1
            second = size.argmax(axis=1)
            gap.append(top - size[rows, second])
            best.append(2 * first + (x[rows, first] < 0))
            other.append(2 * second + (x[rows, second] < 0))
        weight = (2 * width) ** np.arange(rotations, dtype=np.int64)[:, None]
        best_a, other_a = np.array(best, dtype=np.int64), np.array(other, dtype=np.int64)
        home = (best_a * weight).sum(axis=0)
        yield t, 0, home
        order = np.argsort(np.array(gap), axis=0)
        step = (other_a - best_a) * weight
        for p in range(1, min(probes, rotations + 1)):
            yield t, p, home + step[order[p - 1], rows]


@lru_cache(64)
def _meeting(angle: float, dim: int, rotations: int, probes: int, seed: int, pairs: int = 2000) -> float:
    """The chance that two vectors at ``angle`` meet in one table, from random pairs."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(pairs, dim))), rng.normal(size=(pairs, dim))
    b = np.cos(angle) * a + np.sin(angle) * unit(b - (a * b).sum(axis=1, keepdims=True) * a) if dim > 1 else a
    codes = [[(p, c) for _, p, c in _codes(x.astype(np.float32), 1, rotations, probes, seed)] for x in (a, b)]
    met = np.zeros(pairs, bool)
    for p, x in codes[0]:
        for q, y in codes[1]:
            if not p or not q:  # a guest meets those at home only
                met |= x == y
    return float(met.mean())


def _tables_for(angle: float, dim: int, rotations: int, probes: int, seed: int) -> int:
    p = _meeting(round(min(angle, 1.2), 2), dim, rotations, probes, seed)
    return max(1, math.ceil(math.log(1 - MEET) / math.log(1 - p))) if 0 < p < 1 else 1


def _settled_angle(dim: int, tables: int, rotations: int, probes: int, seed: int) -> float:
    """The largest angle at which ``tables`` miss a pair rarely enough."""
    sure = [a for a in np.arange(0.02, 1.0, 0.02).round(2) if (1 - _meeting(float(a), dim, rotations, probes, seed)) ** tables <= 1 - SETTLED]
    return float(max(sure, default=0.0))


def _hashed(reps: DataFrame, dim: int, tables: int, rotations: int, probes: int, seed: int) -> DataFrame:
    """From (g, id, low, e) one row per bucket looked into: (bucket, id, low, guest, e); a
    guest only looks in. The codes are found once and written beside the vectors."""
    schema = T.StructType.fromDDL("g long, id long, low long, e array<float>, codes array<long>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            unit = (e / np.sqrt((e * e).sum(axis=1, keepdims=True))).astype(np.float32)
            # a code's lowest bit tells guests
            codes = np.stack([((code * tables + t) << 1) | (p > 0) for t, p, code in _codes(unit, tables, rotations, probes, seed)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], schema.names)

    coded = cut(reps.mapInArrow(run, schema))
    rows = coded.withColumn("code", F.explode("codes"))
    home = F.shiftright("code", 1)
    return rows.select(F.xxhash64("g", home).alias("bucket"), "id", "low", (F.col("code").bitwiseAND(1) == 1).alias("guest"), "e")


def _ranked(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row (by distance, then ``low``) of the directed pairs found."""
    a, b, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((low[b], d, a))
    a, b, d = a[order], b[order], d[order]
    start = np.searchsorted(a, a, "left")
    ok = np.arange(len(a)) - start < k
    return a[ok], b[ok], d[ok]


def _compare(rows: DataFrame, dim: int, k: int, radius: float | None, many: int, guests: bool = True) -> DataFrame:
    """(id, other, low, distance): within each bucket (and pair of blocks) the k nearest of each row.
    ``low`` breaks ties: the smallest id with the other vector, as ``id`` is but a hash.
    ``part`` 0 or 1: rows of part 0 and 1 are compared with each other; null: all with all.
    Guests aren't compared with each other; without ``guests`` nothing is looked for on their behalf."""
    schema = T.StructType.fromDDL("id long, other long, low long, distance double")
    limit = np.inf if radius is None else float(radius)

    def exact(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = e[a].astype(np.float64) - e[b]
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, low = t.column("id").to_numpy(), t.column("low").to_numpy()
        key = t.column("bucket").to_numpy()
        guest = t.column("guest").to_numpy()
        part = t.column("part").fill_null(-1).to_numpy()
        e = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        found = []

        def add(a: np.ndarray, b: np.ndarray) -> None:
            ok = ~(guest[a] & guest[b]) & (ids[a] != ids[b]) & ((part[a] < 0) | (part[a] != part[b]))
            a, b = a[ok], b[ok]
            d = exact(e, a, b)
            near = d <= limit
            a, b, d = a[near], b[near], d[near]
            two = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
            found.append(two if guests else tuple(x[~guest[two[0]]] for x in two))
            if sum(len(x[0]) for x in found) > 2_000_000:
                found[:] = [_ranked(found, low, k)]

        starts = bounds(key)
        small = np.diff(starts) < BLOCK
        cuts = np.flatnonzero(np.diff(np.concatenate([[False], small, [False]]).astype(int)))
        for lo, hi in zip(cuts[::2], cuts[1::2]):  # runs of small groups together
            first = starts[lo]
            for a, b in pairs_within(starts[lo : hi + 1] - first, 50_000):
                add(a + first, b + first)
        for g in np.flatnonzero(~small):
            rows = np.arange(starts[g], starts[g + 1])
            sides = [(rows, rows)] if part[rows[0]] < 0 else [(rows[part[rows] == s], rows[part[rows] != s]) for s in (0, 1)]
            for left, right in sides:
                left = left if guests else left[~guest[left]]
                y = e[right].astype(np.float64)
                norm = (y * y).sum(axis=1)
                for i in range(0, len(left), BLOCK):
                    at = left[i : i + BLOCK]
                    x = e[at].astype(np.float64)
                    both = (x * x).sum(axis=1)[:, None] + norm
                    d2 = both - 2 * (x @ y.T)
                    d2[(guest[at, None] & guest[right]) | (ids[at, None] == ids[right])] = np.inf
                    slack = 1e-9 * (1 + both)
                    want = np.isfinite(d2) if radius is None else d2 <= limit * limit + slack
                    if len(right) > 4 * k:  # ties at the last place stay in
                        want &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + slack
                    a, b = np.nonzero(want)
                    a, b = at[a], right[b]
                    d = exact(e, a, b)
                    near = d <= limit
                    found.append(_ranked([(a[near], b[near], d[near])], low, k))
        if found:
            a, b, d = _ranked(found, low, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(low[b]), pa.array(d)], schema.names)

    return over_groups(rows, "bucket", run, schema, many=many)


def nearest(
    vectors: DataFrame,
    vec_id: str,
    embedding: str,
    within: str | None = None,
    k: int = 10,
    dim: int = 64,
    radius: float | None = None,
    tables: int | None = None,
    rotations: int | None = None,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 17,
    settle: bool | None = None,
) -> DataFrame:
    """(``vec_id``, other, distance, place): for every vector up to ``k`` nearest
    others by Euclidean distance, ties to the smaller id, at most ``radius`` away,
    among those with the same ``within``.

    Accuracy: with a ``radius`` hashing alone finds nearly all; tables are made for the angle
    at which that distance appears (two vectors at it meet with a chance of MEET, nearer ones more surely).
    ``settle``, the default without a ``radius``, adds the exact pass for the vectors that hashing
    doesn't settle, at a cost of their number times the size of their group.

    Defined cases: only vectors of ``dim`` finite numbers, not all zero, with an
    id and a ``within`` that are not null take part; repeated rows count once;
    an id given to several different vectors never is its own neighbour; a vector
    without others has no rows; empty in, empty out; other columns are ignored.
    """
    e = F.col(embedding)
    good = e.isNotNull() & (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    group = F.col(within) if within else F.lit(0)
    rows = (
        vectors.select(F.col(vec_id).cast("long").alias("id"), group.alias("g"), F.when(good, e.cast("array<float>")).alias("e"))
        .where("e is not null and id is not null and g is not null")
        .withColumns({"h1": F.xxhash64("g", "e"), "h2": F.xxhash64(F.lit(1), "e", "g")})
    )
    settle = radius is None if settle is None else settle
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(_norm("e"), 0.05, 1000).alias("q"))
    size = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("norm")).first()
    many = size["all"] or 0
    if rotations is None:
        axes, rotations = 2 << (dim - 1).bit_length(), 2
        while (size["most"] or 0) > EVEN_ROWS * axes**rotations and axes ** (rotations + 1) < 2**50:
            rotations += 1
    if tables is None:
        angle = NEAR if radius is None or not size["norm"] else math.asin(min(1.0, radius / size["norm"]))
        tables = _tables_for(angle, dim, rotations, probes, seed)

    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.first("e").alias("e"), F.first("g").alias("g"))
    reps = classes.select(F.xxhash64("g").alias("g"), F.col("h1").alias("id"), "low", "e")
    buckets = _hashed(reps, dim, tables, rotations, probes, seed)
    found = _compare(in_blocks(buckets, "bucket", "id", bucket_rows), dim, k, radius, many * tables * probes)
    near = _nearest_of(found, k)
    if settle:
        near = cut(near)
        sine = math.sin(_settled_angle(dim, tables, rotations, probes, seed))
        last = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
        marked = reps.join(last, "id", "left").withColumn("guest", F.coalesce((F.col("n") >= k) & (F.col("d") <= _norm("e") * sine), F.lit(False)))
        blocks, copies = _question_blocks(cut(marked.select("g", "id", "low", "e", "guest")), bucket_rows)
        near = _nearest_of(near.unionByName(_compare(blocks, dim, k, radius, copies, guests=False)), k)

    members = rows.select("h1", "h2", "g", "id").distinct()
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    heads = members.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("h1", "h2", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    apart = (
        near.join(heads.where(F.size("ids") <= k).select(F.col("h1").alias("id"), "g", "ids"), "id")
        .join(heads.select(F.col("h1").alias("other"), F.col("ids").alias("others")), "other")
        .select("g", F.explode("ids").alias("id"), "others", "distance")
        .select("g", "id", F.explode("others").alias("other"), "distance")
    )
    copies = heads.where(F.size("ids") > 1)
    same = (
        members.join(copies.select("h1", "h2", "ids"), ["h1", "h2"])
        .select("g", "id", F.explode("ids").alias("other"), F.lit(0.0).alias("distance"))
    )
    both = apart.unionByName(same).where("id <> other").repartition("g", "id").groupBy("g", "id", "other").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("g", "id").orderBy("distance", "other")
    out = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.select(F.col("id").alias(vec_id), "other", "distance", "place")


def _norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector among what several buckets found: one shuffle."""
    once = found.repartition("id").groupBy("id", "other").agg(F.min("low").alias("low"), F.min("distance").alias("distance"))
    w = Window.partitionBy("id").orderBy("distance", "low")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _question_blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``rows`` (g, id, low, e, guest) in pairs of blocks of about ``most``, for every pair of
    which one holds questions (rows that are no guests); and how many rows that makes.
    Questions and guests lie in blocks of their own."""
    sizes = rows.groupBy("g").agg(F.count_if(~F.col("guest")).alias("u"), F.count_if("guest").alias("t"))
    sizes = sizes.select("g", F.ceil(F.col("u") / most).cast("int").alias("su"), F.ceil(F.col("t") / most).cast("int").alias("st"), "u", "t")
    copies = sizes.agg(F.sum(F.col("u") * (F.col("su") + F.col("st")) + F.col("t") * F.col("su")).alias("n")).first()["n"] or 0
    at = rows.join(sizes.where("su > 0").drop("u", "t"), "g")
    h = F.xxhash64("id")
    own = F.when(F.col("guest"), F.col("su") + F.pmod(h, F.greatest("st", F.lit(1)))).otherwise(F.pmod(h, F.col("su"))).cast("int")
    to = F.when(F.col("guest"), F.col("su")).otherwise(F.col("su") + F.col("st")) - 1
    at = at.withColumn("r", own).withColumn("o", F.explode(F.sequence(F.lit(0), to)))
    part = F.when(F.col("r") != F.col("o"), (F.col("r") > F.col("o")).cast("int")).alias("part")
    return at.select(F.xxhash64("g", F.least("r", "o"), F.greatest("r", "o")).alias("bucket"), "id", "low", "guest", "e", part), int(copies)


def _near(spark: SparkSession, folder: str, radius: float | None = None) -> DataFrame:
    return nearest(table(spark, folder, "vectors", "vec_id", "graph_id", "embedding"), "vec_id", "embedding", "graph_id", k=10, dim=64, radius=radius)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder, 0.5).select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).withColumn("distance", F.round("distance", 6))


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
_EXACT = """with
ok as (
  select distinct vec_id, graph_id, embedding::double[64] as e from vectors
  where len(embedding) = 64 and list_bool_and([isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])
),
d as (
  select a.vec_id, b.vec_id as other, array_distance(a.e, b.e) as d
  from ok a join ok b on a.graph_id = b.graph_id and a.vec_id <> b.vec_id
),
near as (select vec_id, other, d, row_number() over (partition by vec_id order by d, other)::int as place from d qualify place <= 10)
"""
ORACLE = {
    "p2_found": _EXACT + "select distinct least(vec_id, other) as vec_id_a, greatest(vec_id, other) as vec_id_b from near where d <= 0.5",
    "p2_neighbours": _EXACT + "select vec_id, other, round(d, 6) as distance, place from near",
}
