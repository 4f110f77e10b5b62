"""Records that are the same but for small edits, additions or moved parts.

Two texts are linked if their bags of words overlap by ``threshold`` or more:
the size of the common bag over the size of the joint bag.

Method: a binary trie self-join. A bag becomes a fingerprint in which bit
``hash(word, occurrence) % bits`` is flipped once per element, so two bags whose
symmetric difference has d elements differ in d bits at most. Overlap at or above
the threshold bounds d by ``(1 - t) / (1 + t)`` of the summed sizes, which is the
error budget: pairs of trie nodes are traversed together, differing bits are
counted, and a pair of nodes is dropped once its budget is exceeded. What
remains is checked on the words themselves. Nothing above the threshold is lost.

One trie over everything would meet most pairs of its upper nodes, so it is cut
into groups first, by the rarest words: bags above the threshold share one of
the first ``n - ceil(t n) + 1`` words in a common order, rarest first, and two
of the first ``n - ceil(t n) + 2``. A rare word makes a group; for a frequent
word the group is made by it and a second word. At thresholds of 0.5 or less one
common word may link short bags, which then share no second one, so among them a
frequent word makes a group alone as well.
Groups still too large for one task are compared in pairs of blocks.

Texts with equal bags are one class; classes are compared, not their copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.llm.components import components
from mnemos.llm.grouped import bounds, in_blocks, over_groups
from mnemos.llm.terms import words
from mnemos.session import cut
from mnemos.sources.tables import table

WORDS = 4  # 64-bit words of a fingerprint
FREQUENT = 100_000  # words whose frequency is shipped to the tasks, 16 bytes each
HOT = 200  # records from which on a word needs a second one to make a group
LONG = 128  # words of a text from which on frequent words make groups alone, among long texts
GROUP_ROWS = 8_000
LEAF = 48  # pairs of a node pair from which on it is split further
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _elements(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every (word, occurrence) of each row's bag."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens), dtype=np.int64), lengths)
    coded = tokens.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    starts = bounds(row * max(1, len(hashes)) + code)
    nth = np.arange(len(row)) - np.repeat(starts[:-1], np.diff(starts))
    h = hashes[code] if len(code) else np.empty(0, np.uint64)
    h = (h + nth.astype(np.uint64) * _PRIME) * np.uint64(0xFF51AFD7ED558CCD)
    return row, h ^ (h >> np.uint64(33))


def _prints(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WORDS), np.uint64)
    np.bitwise_xor.at(out, (row, (h >> np.uint64(6)).astype(np.int64) % WORDS), np.uint64(1) << (h & np.uint64(63)))
    return out


def _keys(tokens: pa.Array, t: Fraction, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group keys of each row: (row, key), and the rows' sizes and fingerprints."""
    n_rows = len(tokens)
    row, h = _elements(tokens)
    size = np.bincount(row, minlength=n_rows)
    prints = _prints(row, h, n_rows)
    freq = np.zeros(len(h), np.int64)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        freq = np.where(often[at] == h, counts[at], 0)
    order = np.lexsort((h, freq, row))
    row, h, freq = row[order], h[order], freq[order]
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    need = -(-size * t.numerator // t.denominator)
    p1 = (size - need + 1)[row]
    hot = freq > HOT
    one, two = place < p1, place < p1 + 1
    out_row, out_key = [row[one & ~hot]], [h[one & ~hot]]
    long_floor = LONG * t.numerator // t.denominator
    # bags of more words than 1 / t need two in common; above 0.5 bags that need one have one and are equal
    lone = (need == 1)[row] & (2 * t.numerator <= t.denominator)
    alone = one & hot & ((size[row] >= long_floor) | lone)
    out_row.append(row[alone])
    out_key.append(h[alone] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    short = size[row] < LONG
    first, second = np.flatnonzero(one & hot & short), two & hot & short
    step = 1
    while len(first):
        first = first[first + step < len(row)]
        first = first[row[first + step] == row[first]]
        ok = second[first + step]
        a = first[ok]
        out_row.append(row[a])
        out_key.append((h[a] * _PRIME) ^ (h[a + step] + np.uint64(0x5851F42D4C957F2D)))
        first = a  # places rise, so once the second is out of reach all later ones are
        step += 1
    return np.concatenate(out_row), np.concatenate(out_key), size, prints


def trie_join(prints: np.ndarray, size: np.ndarray, starts: np.ndarray, t: Fraction, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within the groups given by ``starts`` whose fingerprints differ
    by no more bits than their sizes allow. ``part``: rows of part 0 and 1 are
    joined with each other, rows of part -1 with all.

    All groups are traversed at once, a bit at a time. A node is a range of rows
    that agree in the bits so far; the trie is over the folded first 64 bits.
    """
    spread, joint = (t.denominator - t.numerator), (t.denominator + t.numerator)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fold = np.bitwise_xor.reduce(prints, axis=1)
    order = np.lexsort((fold, group))
    fold, group = fold[order], group[order]
    most = np.maximum.reduceat(size[order], starts[:-1]) if len(starts) > 1 else np.empty(0, np.int64)
    budget = 2 * most * spread // joint
    lo = hi = lo2 = hi2 = None
    lo, hi = starts[:-1].copy(), starts[1:].copy()
    lo2, hi2, diff = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)

    def leaves(lo, hi, lo2, hi2):
        many = (hi - lo) * (hi2 - lo2)
        done = 0
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            to = max(int(np.searchsorted(ends, done + 1_000_000, "right")), at + 1)
            m = many[at:to]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat((hi2 - lo2)[at:to], m)
            i, j = np.repeat(lo[at:to], m) + k // wide, np.repeat(lo2[at:to], m) + k % wide
            ok = i < j  # a pair of different nodes has its ranges in this order
            i, j = order[i[ok]], order[j[ok]]
            if part is not None:
                ok = (part[i] < 0) | (part[i] != part[j])
                i, j = i[ok], j[ok]
            bits = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
            both = size[i] + size[j]
            ok = (bits * joint <= both * spread) & (np.minimum(size[i], size[j]) * t.denominator >= np.maximum(size[i], size[j]) * t.numerator)
            yield i[ok], j[ok]
            done, at = ends[to - 1], to

    for bit in range(64):
        small = (hi - lo) * (hi2 - lo2) <= LEAF
        yield from leaves(lo[small], hi[small], lo2[small], hi2[small])
        big = ~small
        lo, hi, lo2, hi2, diff = lo[big], hi[big], lo2[big], hi2[big], diff[big]
        if not len(lo):
            return
        ones = np.concatenate([[0], np.cumsum((fold >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        itself = lo == lo2
        other = ~itself
        new = [
            np.concatenate(x)
            for x in zip(
                (lo, mid, lo2, mid2, diff),
                (mid, hi, mid2, hi2, diff),
                (lo, mid, mid2, hi2, diff + 1),
                (mid[other], hi[other], lo2[other], mid2[other], diff[other] + 1),
            )
        ]
        lo, hi, lo2, hi2, diff = new
        ok = (hi > lo) & (hi2 > lo2)
        ok &= diff <= budget[group[np.minimum(lo, len(group) - 1)]] if len(group) else ok
        lo, hi, lo2, hi2, diff = (x[ok] for x in (lo, hi, lo2, hi2, diff))
    yield from leaves(lo, hi, lo2, hi2)


def bag_classes(records: DataFrame, rec_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, words) of one record per different bag, and (id, class) of all records; wordless texts are left out."""
    rows = records.select(F.col(rec_id).alias("id"), F.array_sort(words(F.col(text))).alias("words")).where("id is not null and size(words) > 0")
    rows = rows.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")})
    classes = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.first("words").alias("words")))  # five stages read it
    members = rows.select("h1", "h2", "id").distinct().join(classes.select("h1", "h2", "class"), ["h1", "h2"])
    return classes.select(F.col("class").alias("id"), "words"), members.select("id", "class")


def class_links(classes: DataFrame, threshold: str = "0.7", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b, common, joint) with a < b: all linked pairs of different bags."""
    spark, t = classes.sparkSession, Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and not above 1")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(_elements(b.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    freq = classes.select("words").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    top = freq.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    often = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(often)
    shipped = spark.sparkContext.broadcast((often[order], top.column("n").to_numpy()[order]))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, key, size, prints = _keys(b.column(1), t, *shipped.value)
                at = pa.array(row)
                cols = [pa.array(key.view(np.int64)), b.column(0).take(at), pa.array(size[row].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(prints[row, k].view(np.int64)) for k in range(WORDS))], names)

    names = ["key", "id", "n", *(f"f{k}" for k in range(WORDS))]
    id_kind = classes.schema["id"].dataType
    longs = [T.StructField(x, T.LongType()) for x in names]
    rows = classes.select("id", "words").mapInArrow(keyed, T.StructType([longs[0], T.StructField("id", id_kind), *longs[2:]]))
    rows = cut(rows)  # found once, read for the groups' sizes and for the groups
    todo = in_blocks(rows, "key", "id", group_rows)

    def join(tab: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = tab.column("id").combine_chunks()
        prints = np.stack([tab.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
        part = tab.column("part").fill_null(-1).to_numpy()
        for i, j in trie_join(prints, tab.column("n").to_numpy(), bounds(tab.column("key").to_numpy()), t, part):
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], ["a", "b"])

    pair = T.StructType([T.StructField("a", id_kind), T.StructField("b", id_kind)])
    found = over_groups(todo, "key", join, pair, many=rows.count()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    with_words = found.join(classes.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(classes.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, common, joint = [], [], []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                c = (Counter(x) & Counter(y)).total()
                u = len(x) + len(y) - c
                if c * t.denominator >= u * t.numerator:
                    keep.append(k), common.append(c), joint.append(u)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(common, pa.int64()), pa.array(joint, pa.int64())], ["a", "b", "common", "joint"])

    out = T.StructType([*pair.fields, T.StructField("common", T.LongType()), T.StructField("joint", T.LongType())])
    return with_words.select("a", "b", "wa", "wb").mapInArrow(verify, out)


def similar_pairs(records: DataFrame, rec_id: str, text: str, threshold: str = "0.7", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b, common, joint), a < b: every pair of records whose texts are linked, copies included.

    Defined cases: records with a null id or without words (null, empty, only
    punctuation) have no links; repeated rows count once; an id with several texts
    is linked by any of them, never with itself; texts of any length are taken
    whole; empty in, empty out; other columns are ignored. The result names every
    pair of copies, which grows with the square of a text's copies: use
    ``similar_groups`` where that is too much.
    """
    classes, members = bag_classes(records, rec_id, text)
    links = class_links(classes, threshold, group_rows)
    a = members.select(F.col("class").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("class").alias("b"), F.col("id").alias("ib"))
    apart = links.join(a, "a").join(b, "b").select("ia", "ib", "common", "joint")
    sizes = classes.select(F.col("id").alias("a"), F.size("words").cast("long").alias("common"))
    twice = members.groupBy("class").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("class").alias("a"))
    again = a.join(twice, "a", "left_semi")
    same = again.join(again.select("a", F.col("ia").alias("ib")), "a").where("ia < ib").join(sizes, "a").select("ia", "ib", "common", F.col("common").alias("joint"))
    both = apart.unionAll(same).where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common", "joint")
    return both.groupBy("a", "b").agg(F.max_by(F.struct("common", "joint"), F.col("common") / F.col("joint")).alias("s")).select("a", "b", "s.common", "s.joint")


def similar_groups(records: DataFrame, rec_id: str, text: str, threshold: str = "0.7", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(``rec_id``, class, links, group): one row per record with words. ``class`` is
    the smallest id with the same bag, ``links`` the number of other classes that
    class is linked with, ``group`` the smallest id of the records reached by links."""
    classes, members = bag_classes(records, rec_id, text)
    links = class_links(classes, threshold, group_rows)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    reach = components(links, "a", "b").select(F.col("id").alias("class"), F.col("component").alias("group"))
    with_links = members.join(ends, "class", "left").join(reach, "class", "left")
    return with_links.select(F.col("id").alias(rec_id), "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(table(spark, folder, "hits", "hit_id", "value"), "hit_id", "value")
    return pairs.select(F.col("a").alias("hit_id_a"), F.col("b").alias("hit_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "hits", "hit_id", "value"), "hit_id", "value")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
_BAGS = """with recursive
h as (select distinct hit_id, value from hits where value is not null),
w as (select hit_id, unnest(regexp_extract_all(lower(value), '[\\p{L}\\p{N}]+')) as w from h),
c as (select hit_id, w, count(*) as n from w group by all),
s as (select hit_id, sum(n) as size, string_agg(w || '=' || n, ' ' order by w) as bag from c group by all),
common as (
  select a.hit_id as hit_id_a, b.hit_id as hit_id_b, sum(least(a.n, b.n)) as common
  from c a join c b on a.w = b.w and a.hit_id < b.hit_id group by all
),
pairs as (
  select hit_id_a, hit_id_b, sa.bag as bag_a, sb.bag as bag_b from common
  join s sa on sa.hit_id = hit_id_a join s sb on sb.hit_id = hit_id_b
  where common * 10 >= 7 * (sa.size + sb.size - common)
)
"""
ORACLE = {
    "p5_found": _BAGS + "select hit_id_a, hit_id_b from pairs",
    "p5_groups": _BAGS + """,
ends as (select hit_id_a as a, hit_id_b as b from pairs union all select hit_id_b, hit_id_a from pairs),
reach as (select hit_id as id, hit_id as least_id from s union select e.b, r.least_id from reach r join ends e on e.a = r.id),
groups as (select id, min(least_id) as g from reach group by all),
links as (select bag_a as bag, count(distinct bag_b) as n from (select bag_a, bag_b from pairs union all select bag_b, bag_a from pairs) where bag_a <> bag_b group by all)
select s.hit_id, min(s.hit_id) over (partition by s.bag) as class, coalesce(n, 0) as links, g as "group"
from s left join links using (bag) join groups on id = s.hit_id""",
}
