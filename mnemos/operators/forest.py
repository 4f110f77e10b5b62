"""A forest of random-projection trees over vectors: an index for approximate searches.

Recalls don't use it, they read all vectors exactly; it serves large collections where
a share of the neighbours is enough. Every tree sends a vector down through levels of
nodes; a node splits at the median of its vectors' projections on a random direction
of its own. Nodes that fit a task are split to the end inside it, with all trees of a graph at
once; only graphs above that have their upper levels found by passes over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.session import cut

TREES, LEAF_ROWS, DEEPEST = 16, 64, 30
#: Numbers (rows x dim) that one task takes: of a graph when it grows its trees, and of a slice that is searched.
GROWN, SEARCHED = 8_000_000, 2_000_000
#: Questions that meet the trees of a graph, or a slice of it, at once.
BLOCK = 10_000
#: Levels of the first tree whose nodes an exact search may leave out.
COARSE = 6


def direction(tree: int, level: int, dim: int, seed: int) -> np.ndarray:
    """A random direction for each tree and level, the same wherever it is asked for."""
    return np.random.RandomState([seed, tree, level]).standard_normal(dim)


def projected(columns: np.ndarray, tree: int, levels: range, seed: int) -> np.ndarray:
    """(level, vector) of vectors given as columns; added up in one order, so that equal vectors have equal projections."""
    ways = np.array([direction(tree, v, len(columns), seed) for v in levels]).reshape(len(levels), len(columns))
    out = np.zeros((len(levels), columns.shape[1]))
    for way, x in zip(ways.T, columns):
        out += way[:, None] * x
    return np.clip(np.nan_to_num(out, nan=1e300), -1e300, 1e300)


def _matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _one_each(keys: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with one vector each, the last of a repeated key."""
    order = np.argsort(keys, kind="stable")
    keys, e = keys[order], e[order]
    last = np.append(keys[1:] != keys[:-1], True) if len(keys) else np.zeros(0, bool)
    if not last.all():
        again = np.flatnonzero(~last | np.append(False, ~last[:-1]))
        e[again] = e[again][np.lexsort((*e[again].T[::-1], keys[again]))]
    return keys[last], e[last]


def _good(vectors: DataFrame, dim: int) -> DataFrame:
    e = F.col("embedding")
    return vectors.where((F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull()) & F.col("graph_id").isNotNull() & F.col("fact_key").isNotNull()).select("graph_id", "fact_key", "embedding")


def build(vectors: DataFrame, dim: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(leaves, splits) of ``vectors`` (graph_id, fact_key, embedding): leaves (graph_id, fact_key, tree,
    node) has each vector in one leaf of every tree of its graph; splits (graph_id, tree, node, level, at) the nodes
    above. Nodes are strings of 0 and 1 from the root "".

    A fact is given one vector (the last of a repeated key); those of other lengths aren't indexed. Equal
    projections stay together, so a leaf of equal vectors may be larger than ``leaf_rows``."""
    good, kind = _good(vectors, dim), vectors.schema["graph_id"].dataType.simpleString()
    schema = f"graph_id {kind}, fact_key bigint, tree int, node string, level int, at double"
    room = max(1, GROWN // dim)
    large = [r["graph_id"] for r in good.groupBy("graph_id").count().where(F.col("count") > room).collect()]
    parts, more = good.withColumns({"tree": F.lit(-1), "node": F.lit("")}), None
    if large:
        rows = cut(good.where(F.col("graph_id").isin(large)).groupBy("graph_id", "fact_key").agg(F.max("embedding").alias("embedding")))
        upper, ends = _upper(rows, dim, trees, max(room, leaf_rows), seed)
        vector = vectors.schema["embedding"].dataType.simpleString()
        down = rows.mapInArrow(_down(dim, trees, seed, upper, ends), f"graph_id {kind}, fact_key bigint, embedding {vector}, tree int, node string")
        parts = parts.where(~F.col("graph_id").isin(large)).unionByName(down.where("embedding is not null"))
        whole = down.where("embedding is null").select("graph_id", "fact_key", "tree", "node", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("at"))
        found = [(g, None, t, node, len(node), at) for (g, t), nodes in upper.items() for node, at in nodes.items()]
        more = whole.unionByName(rows.sparkSession.createDataFrame(found, schema))
    grown = parts.groupBy("graph_id", "tree", "node").applyInArrow(_grow(dim, trees, leaf_rows, seed), schema)
    grown = cut(grown if more is None else grown.unionByName(more))
    return grown.where("level is null").select("graph_id", "fact_key", "tree", "node"), grown.where("level is not null").select("graph_id", "tree", "node", "at", "level")


def _upper(rows: DataFrame, dim: int, trees: int, room: int, seed: int) -> tuple[dict, set]:
    """Splits {(graph_id, tree): {node: at}} down to nodes of ``room`` rows, and the larger nodes (graph_id, tree, node) that nothing
    splits. Both are as few as the rows fill tasks."""
    upper: dict[tuple[int, int], dict[str, float]] = {}
    ends: set[tuple[int, int, str]] = set()
    kind = rows.schema["graph_id"].dataType.simpleString()
    for level in range(DEEPEST):
        p = rows.mapInArrow(_down(dim, trees, seed, upper, ends, level), f"graph_id {kind}, tree int, node string, p double")
        at = p.groupBy("graph_id", "tree", "node").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("p", 0.5, 1000).alias("at"), F.min("p").alias("lo"), F.max("p").alias("hi"))
        wide = at.where(F.col("n") > room).collect()
        for r in wide:
            if r["lo"] < r["hi"]:
                upper.setdefault((r["graph_id"], r["tree"]), {})[r["node"]] = r["at"] if r["at"] < r["hi"] else (r["lo"] + r["hi"]) / 2
            else:
                ends.add((r["graph_id"], r["tree"], r["node"]))
        if not any(r["lo"] < r["hi"] for r in wide):
            break
    return upper, ends


def _down(dim: int, trees: int, seed: int, upper: dict, ends: set, level: int | None = None):
    """Takes vectors down the known splits: to their projections at ``level`` in the nodes made by the level above; else to
    one row a tree, without the vector where the node is a leaf for good."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, graphs = _matrix(b["embedding"], dim), b["graph_id"].to_numpy(zero_copy_only=False)
            for tree in range(trees):
                deep = max([len(n) + 1 for (_, t), nodes in upper.items() if t == tree for n in nodes] or [0])
                p = projected(e.T, tree, range(deep if level is None else level + 1), seed)
                at, still = [""] * len(graphs), []
                for i, g in enumerate(graphs.tolist()):
                    splits, node = upper.get((g, tree), {}), ""
                    while node in splits and len(node) < len(p):
                        node += "0" if p[len(node), i] <= splits[node] else "1"
                    at[i] = node
                    if len(node) == level and (g, tree, node) not in ends:
                        still.append(i)
                if level is not None:
                    yield pa.RecordBatch.from_arrays([b["graph_id"].take(pa.array(still, pa.int64())), pa.array(np.full(len(still), tree, np.int32)), pa.array([at[i] for i in still], pa.string()), pa.array(p[level, still])], ["graph_id", "tree", "node", "p"])
                    continue
                left = pa.array([None if (g, tree, n) in ends else i for i, (g, n) in enumerate(zip(graphs.tolist(), at))], pa.int64())
                yield pa.RecordBatch.from_arrays([b["graph_id"], b["fact_key"], b["embedding"].take(left), pa.array(np.full(len(at), tree, np.int32)), pa.array(at, pa.string())], ["graph_id", "fact_key", "embedding", "tree", "node"])

    return down


def _grow(dim: int, trees: int, leaf_rows: int, seed: int):
    """Splits the vectors of a graph in all trees (tree -1), or those of one node of a tree."""

    def grow(rows: pa.Table) -> pa.Table:
        keys, e = _one_each(rows["fact_key"].to_numpy(), _matrix(rows["embedding"], dim))
        one, top = rows["tree"][0].as_py(), rows["node"][0].as_py()
        columns, out = np.ascontiguousarray(e.T), []
        ahead = min(DEEPEST, len(top) + max(1, int(np.log2(max(2, len(keys) / leaf_rows))) + 3))
        for tree in range(trees) if one < 0 else [one]:
            ps = projected(columns, tree, range(len(top), ahead), seed)
            nodes, splits, leaf = [], [], np.zeros(len(keys), np.int32)
            stack = [(top, np.arange(len(keys)))]
            while stack:
                node, at = stack.pop()
                level = len(node)
                if len(at) > leaf_rows and level < DEEPEST:
                    p = ps[level - len(top), at] if level < ahead else projected(columns[:, at], tree, range(level, level + 1), seed)[0]
                    low, high = p.min(), p.max()
                    if low < high:
                        middle = np.partition(p, (len(p) - 1) // 2)[(len(p) - 1) // 2]
                        middle = middle if middle < high else p[p < high].max()
                        splits.append((node, level, middle))
                        stack += [(node + "0", at[p <= middle]), (node + "1", at[p > middle])]
                        continue
                leaf[at] = len(nodes)
                nodes.append(node)
            n, m = len(keys), len(splits)
            node = pa.concat_arrays([pa.array(nodes, pa.string()).take(pa.array(leaf)), pa.array([s[0] for s in splits], pa.string())])
            level = pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array([s[1] for s in splits], pa.int32())])
            middle = pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array([s[2] for s in splits], pa.float64())])
            graph = pa.repeat(rows["graph_id"][0], n + m)
            out.append(pa.table([graph, pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(m, pa.int64())]), pa.array(np.full(n + m, tree, np.int32)), node, level, middle], ["graph_id", "fact_key", "tree", "node", "level", "at"]))
        return pa.concat_tables(out)

    return grow


def nearest(queries: DataFrame, vectors: DataFrame, index: tuple[DataFrame, DataFrame], dim: int, k: int = 10, overfetch: int = 8, seed: int = 11, exact: bool = False) -> DataFrame:
    """(query_id, graph_id, fact_key, distance): the k nearest among the candidates that every tree gives
    a question (query_id, graph_id, vector): its own leaf, then the leaves behind the splits it lies closest to, until
    about k * ``overfetch`` vectors a tree are found; the distances are exact. An ``overfetch`` that reaches all leaves makes the answer exact.

    With ``exact`` the answer is exact for graphs of any size: beyond these candidates a question reads all of the first
    tree but the nodes of its upper levels that lie behind a split further away than the k-th candidate."""
    leaves, splits = index
    code = F.conv(F.concat(F.lit("1"), "node"), 2, 10).cast("int").alias("leaf")  # 1, then the steps from the root
    coded = leaves.select("graph_id", "fact_key", "tree", code)
    sizes = coded.groupBy("graph_id", "tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.withColumn("at", F.lit(None).cast("double")).unionByName(splits.select("graph_id", "tree", code, F.lit(0).cast("bigint").alias("n"), "at"))
    e = F.col("vector").cast("array<double>")
    asked = queries.where((F.size("vector") == dim) & F.col("graph_id").isNotNull()).select("query_id", "graph_id", e.alias("e"))
    blocks = F.broadcast(asked.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    each = lambda rows, part, parts: rows.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    hashed = lambda rows, part, parts, of: rows.withColumn(part, F.pmod(F.xxhash64(of), F.col(parts)).cast("int")).drop(parts)
    asked = hashed(asked.join(blocks, "graph_id"), "block", "blocks", "query_id")
    graph, question = (f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("graph_id", "query_id"))
    keys = ["graph_id", "block"]
    nodes = each(nodes.join(blocks, "graph_id"), "block", "blocks")
    probed = asked.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(
        _probe(dim, k * overfetch, seed, exact), f"{graph}, {question}, block int, e array<double>, whole boolean, tree array<int>, leaf array<int>, upper array<int>, bound array<double>"
    )

    # a graph is searched in slices, each with all questions of a block
    room = max(1, SEARCHED // dim)
    slices = sizes.where("tree = 0").groupBy("graph_id").agg(F.ceil(F.sum("n") / room).cast("int").alias("slices"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    embedding = vectors.schema["embedding"].dataType.simpleString()
    rows = _good(vectors, dim).select("*", none("int", "tree"), none("int", "leaf")).unionByName(coded.select("graph_id", "fact_key", none(embedding, "embedding"), "tree", "leaf"))
    rows = each(hashed(rows.join(F.broadcast(slices), "graph_id"), "slice", "slices", "fact_key").join(blocks, "graph_id"), "block", "blocks")
    probed = each(probed.join(F.broadcast(slices), "graph_id"), "slice", "slices")
    keys = ["graph_id", "block", "slice"]
    near = probed.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_search(dim, k), f"{question}, {graph}, fact_key bigint, distance double")
    top = Window.partitionBy("query_id", "graph_id").orderBy("distance", "fact_key")
    return near.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).drop("n")


def _depth(leaf: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(leaf, 1))).astype(np.int64)


def _coarse(leaf: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The node of the upper levels that a leaf is in."""
    return leaf >> np.maximum(0, depth - COARSE)


def _probe(dim: int, wanted: int, seed: int, exact: bool):
    """For each question the leaves it reads in every tree, or ``whole`` if those of one tree are all of its graph. With ``exact`` also
    the nodes of the first tree's upper levels and how far away they are at least."""

    def probe(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        n, e = asked.num_rows, _matrix(asked["e"], dim)
        which, codes, counts, ats = (nodes[c].to_numpy() for c in ("tree", "leaf", "n", "at"))
        whole, trees, read = np.zeros(n, bool), [[] for _ in range(n)], [[] for _ in range(n)]
        upper, bound = [np.zeros(0, np.int32)] * n, [np.zeros(0)] * n
        for tree in np.unique(which).tolist():
            mine = (which == tree) & (counts > 0)
            leaf, count = codes[mine].astype(np.int64), counts[mine]
            depth = _depth(leaf)
            order = np.argsort(leaf << (DEEPEST - depth), kind="stable")  # as the strings sort
            leaf, count, depth = leaf[order], count[order], depth[order]
            if count.sum() <= wanted or len(leaf) == 1:
                whole[:] = True
                break
            inner = (which == tree) & (counts == 0)
            up = np.argsort(codes[inner])
            above, at = codes[inner][up], ats[inner][up]
            levels = range(int(depth.max()))
            p = projected(e.T, tree, levels, seed)
            length = [float(np.linalg.norm(direction(tree, v, dim, seed))) for v in levels]
            under = [np.flatnonzero(depth > v) for v in levels]
            splits = [at[np.searchsorted(above, leaf[u] >> (depth[u] - v))] for v, u in zip(levels, under)]
            right = [(leaf[u] >> (depth[u] - v - 1)) & 1 == 1 for v, u in zip(levels, under)]
            top, one = np.unique(_coarse(leaf, depth), return_index=True)
            for i in range(n):
                # how far a question is from a leaf: the largest margin by which it lies on the other side of a split above
                margin, away = np.zeros(len(leaf)), np.zeros(len(leaf))
                for v, u, s, r in zip(levels, under, splits, right):
                    m = np.where((p[v, i] > s) != r, np.abs(p[v, i] - s), 0.0)
                    margin[u] = np.maximum(margin[u], m)
                    if exact and tree == 0 and v < COARSE:
                        away[u] = np.maximum(away[u], m / length[v])
                first = np.argsort(margin, kind="stable")
                before = np.cumsum(count[first]) - count[first]
                taken = first[before < wanted]
                whole[i] |= len(taken) == len(leaf)
                read[i].append(leaf[taken].astype(np.int32))
                trees[i].append(np.full(len(taken), tree, np.int32))
                if exact and tree == 0:
                    upper[i], bound[i] = top.astype(np.int32), away[one]
        lists = lambda each, kind: pa.array([np.concatenate(x) if isinstance(x, list) and x else x for x in each], pa.list_(kind))
        blank = lambda each: [[] if w else x for w, x in zip(whole, each)]
        return pa.table(
            [asked["graph_id"], asked["query_id"], asked["block"], asked["e"], pa.array(whole), lists(blank(trees), pa.int32()), lists(blank(read), pa.int32()), lists(blank(upper), pa.int32()), lists(blank(bound), pa.float64())],
            ["graph_id", "query_id", "block", "e", "whole", "tree", "leaf", "upper", "bound"],
        )

    return probe


def _search(dim: int, k: int):
    """The k nearest of each question in a slice of its graph."""

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        placed = rows["tree"].is_valid()
        own, leaves = rows.filter(rows["tree"].is_null()), rows.filter(placed)
        keys, e = _one_each(own["fact_key"].to_numpy(), _matrix(own["embedding"], dim))
        facts, which, codes = (leaves[c].to_numpy() for c in ("fact_key", "tree", "leaf"))
        there = np.isin(keys, facts)
        keys, e = keys[there], e[there]
        known = np.isin(facts, keys)
        facts, which, codes = facts[known], which[known], codes[known]
        found, q = [], _matrix(asked["e"], dim)
        if not len(keys):
            q = q[:0]
        place, trees, upper = np.searchsorted(keys, facts), {}, None
        if not all(asked["whole"].to_pylist()):
            for t in np.unique(which).tolist():
                code, at = codes[which == t], place[which == t]
                order = np.argsort(code, kind="stable")
                trees[t] = code[order], at[order]
                if t == 0:
                    node = np.zeros(len(keys), np.int64)
                    node[at] = _coarse(code.astype(np.int64), _depth(code))
                    upper = np.unique(node, return_inverse=True)
        ids, wholes, plan = asked["query_id"].to_numpy(), asked["whole"].to_pylist(), [asked[c] for c in ("tree", "leaf", "upper", "bound")]
        squares = (e * e).sum(1)
        columns = np.ascontiguousarray(e.T)
        for start in range(0, len(q), 64):
            some = q[start : start + 64]
            own_squares = (some * some).sum(1)
            rough = None  # distances near enough to leave out what is far, of all vectors where some question reads most of them
            for i in range(start, start + len(some)):
                mine = own_squares[i - start]
                error = 1e-12 * (mine + squares)
                tree, leaf, node, bound = (c[i].values.to_numpy() for c in plan)
                if rough is None and (wholes[i] or len(node)):
                    rough = own_squares[:, None] + squares - 2 * (some @ columns)
                if wholes[i]:
                    at, d = np.arange(len(keys)), rough[i - start]
                else:
                    read = np.zeros(len(keys), bool)
                    for t, (code, where) in trees.items():
                        wanted = leaf[tree == t]
                        for x, y in zip(np.searchsorted(code, wanted).tolist(), np.searchsorted(code, wanted, "right").tolist()):
                            read[where[x:y]] = True
                    if len(node):
                        d = rough[i - start]
                        high = (d + error)[read]
                        worst = np.sqrt(np.maximum(0.0, np.partition(high, k - 1)[k - 1])) if len(high) >= k else np.inf
                        # with room for what projections are rounded by
                        enough = worst + 1e-6 * (np.sqrt(mine) + worst)
                        read |= np.isin(upper[0], node[~(bound > enough)])[upper[1]]
                    at = np.flatnonzero(read)
                    d = d[at] if len(node) else mine + squares[at] - 2 * (e[at] @ q[i])
                error = error[at]
                if len(at) > k:
                    at = at[~(d - error > np.partition(d + error, k - 1)[k - 1])]
                sums = np.zeros(len(at))
                for x, y in zip(columns[:, at], q[i]):  # in the order of the numbers, as SQL adds them
                    sums += (x - y) * (x - y)
                distance = np.sqrt(sums)
                best = np.lexsort((keys[at], distance))[:k]
                found.append((np.full(len(best), ids[i]), keys[at][best], distance[best]))
        a, b, c = (np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in range(3))
        graph = pa.repeat(asked["graph_id"][0] if asked.num_rows else rows["graph_id"][0], len(a))
        return pa.table([pa.array(a, asked["query_id"].type), graph, pa.array(b.astype(np.int64)), pa.array(c.astype(float))], ["query_id", "graph_id", "fact_key", "distance"])

    return search
