"""Passages of held-out test items inside training documents.

Method: the word n-grams of the test items are hashed and shipped to every
task; each document's words are slid over once, windows whose hash is known are
verified word by word, and adjoining verified windows become one span, which
can be cut out of the document.

Words are lower-cased runs of letters and digits, so line breaks, punctuation,
diff and comment marks between them don't matter. The set that is shipped is
bounded by ``block_words``: a larger test set is taken in several blocks of at
most so many words, each with a pass of its own over the documents; no item is
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemos.session import cut
from mnemos.sources.tables import table

#: Consecutive words that make a leak.
SPAN = 12
#: Words of test items shipped at once: at 12 words a window about 100 bytes a word, so 0.2 GB at most.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive ids."""
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _PRIME + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


class _Grams:
    """The n-grams of some items, sorted by hash."""

    def __init__(self, items: list[tuple], n: int) -> None:
        self.n, self.code = n, {}
        rows, owners, hashes = [], [], []
        for at, (_, text) in enumerate(items):
            ids = np.array([self.code.setdefault(w, len(self.code) + 1) for w in _WORD.findall(text.lower())], dtype=np.int32)
            if len(ids) >= n:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, n))
                hashes.append(_rolled(ids, n))
                owners.append(np.full(len(rows[-1]), at))
        self.items = [i for i, _ in items]
        if rows:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.rows, self.owners, self.hashes = np.concatenate(rows)[order], np.concatenate(owners)[order], h[order]
        else:
            self.rows, self.owners, self.hashes = np.empty((0, n), np.int32), np.empty(0, int), np.empty(0, np.uint64)

    def spans(self, text: str) -> list[tuple]:
        """(item, first word, word after the last) of every maximal span."""
        get = self.code.get
        ids = np.array([get(w, 0) for w in _WORD.findall(text.lower())], dtype=np.int32)
        if len(ids) < self.n or not len(self.hashes):
            return []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        whole = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        if not len(whole):
            return []
        found = _rolled(ids, self.n)[whole]
        first, last = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        many = last - first
        at = np.repeat(whole, many)
        gram = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        same = (self.rows[gram] == ids[at[:, None] + np.arange(self.n)]).all(axis=1)
        out = []
        for item, start in sorted({*zip(self.owners[gram[same]].tolist(), at[same].tolist())}):
            if out and out[-1][0] == item and start <= out[-1][2]:
                out[-1][2] = start + self.n
            else:
                out.append([item, start, start + self.n])
        return [(self.items[i], a, b) for i, a, b in out]


@lru_cache(2)
def _shared(shipped, n: int) -> _Grams:
    """The n-grams of a broadcast, made once per worker process, not per task."""
    return _Grams(shipped.value, n)


def leaked_spans(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = SPAN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(``doc_id``, ``item_id``, start_char, end_char, n_words): every maximal run
    of windows of ``n`` words that a document shares with an item, with its place in the text.

    Defined cases: null and short texts on either side match nothing; items with
    equal text are all reported; repeated item rows count once, repeated document
    rows give repeated spans; either table empty, the result is empty; columns not
    named are ignored.
    """
    spark = documents.sparkSession
    picked = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("t is not null and d is not null")
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null and i is not null").distinct()
    words = wanted.select(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"] // 2
    blocks = max(1, -(-words // block_words))
    names = [doc_id, item_id, "start_char", "end_char", "n_words"]
    kinds = [picked.schema["d"].dataType, wanted.schema["i"].dataType, T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])

    def scan(shipped):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = _shared(shipped, n)
            for b in batches:
                out: list[list] = [[] for _ in names]
                at = []
                for row, t in enumerate(b.column(1).to_pylist()):
                    if spans := grams.spans(t):
                        places = [m.span() for m in _WORD.finditer(t.lower())] if len(t.lower()) == len(t) else _places(t)
                        for item, first, after in spans:
                            at.append(row)
                            for k, v in enumerate((item, places[first][0], places[after - 1][1], after - first), 1):
                                out[k].append(v)
                arrays = [b.column(0).take(pa.array(at, pa.int64()))]
                columns = [pa.array(v, kind) for v, kind in zip(out[1:], (to_arrow_type(kinds[1]), *[pa.int64()] * 3))]
                yield pa.RecordBatch.from_arrays([*arrays, *columns], schema.names)

        return run

    parts = []
    for k in range(blocks):
        block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shipped = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in block.collect()])
        parts.append(picked.mapInArrow(scan(shipped), schema))
    return reduce(DataFrame.unionAll, parts).toDF(*names)


def _places(text: str) -> list[tuple[int, int]]:
    """Where the words lie in the text itself, where lower-casing changes its length."""
    out = []
    for m in _WORD.finditer(text):
        # a character whose lower case has parts that are no letters splits its word
        out += [m.span()] * len(_WORD.findall(m.group().lower()))
    return out


def leaking(spans: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """(``doc_id``, ``item_id``): which items each document holds."""
    return spans.select(doc_id, item_id).distinct()


#: Documents with leaks up to which their spans are shipped to the documents, about 100 bytes each.
SHIPPED_DOCUMENTS = 500_000


def decontaminate(documents: DataFrame, doc_id: str, text: str, spans: DataFrame, mode: str = "cut") -> DataFrame:
    """The documents without leaks: ``mode`` "cut" takes the spans out of the text
    (spans of several items that overlap are cut out once),
    "drop" leaves the documents out. Documents with a null id stay as they are.

    The texts stay where they are read: the spans, few beside them, are broadcast.
    Above SHIPPED_DOCUMENTS leaking documents only their texts are shuffled."""
    if mode not in ("cut", "drop"):
        raise ValueError("mode must be cut or drop")
    found = cut(spans.groupBy(doc_id).agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("__spans")))
    few = found.count() <= SHIPPED_DOCUMENTS
    if mode == "drop":
        return documents.join(F.broadcast(found.select(doc_id)) if few else found, doc_id, "left_anti")
    empty = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate(
        "__spans",
        empty,
        lambda s, x: F.struct(
            F.concat(s["kept"], F.substr(F.col(text), (s["at"] + 1).cast("int"), F.greatest(x["start_char"] - s["at"], F.lit(0)).cast("int"))).alias("kept"),
            F.greatest(s["at"], x["end_char"]).alias("at"),
        ),
        lambda s: F.concat(s["kept"], F.substr(F.col(text), (s["at"] + 1).cast("int"))),
    )
    joined = documents.join(F.broadcast(found) if few else found, doc_id, "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)).drop("__spans")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaking(_spans(spark, folder), "doc_id", "item_id")


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder)


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate(docs, "doc_id", "text", _spans(spark, folder))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_clean": p7_clean}
_GRAMS = f"""with
iw as (select distinct item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from eval_items),
ig as (select distinct item_id, array_to_string(w[k:k + {SPAN - 1}], ' ') as g
       from (select item_id, w, unnest(range(1, len(w) - {SPAN - 2})) as k from iw)),
dw as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents),
dg as (select doc_id, k, array_to_string(w[k:k + {SPAN - 1}], ' ') as g
       from (select doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) as k from dw)),
hit as (select distinct doc_id, item_id, k from dg join ig using (g))"""
_SPANS = f"""{_GRAMS},
runs as (select *, sum(step) over (partition by doc_id, item_id order by k) as run
         from (select *, case when k - lag(k) over (partition by doc_id, item_id order by k) <= {SPAN} then 0 else 1 end as step from hit)),
words as (select doc_id, item_id, min(k) as a, max(k) + {SPAN - 1} as b from runs group by doc_id, item_id, run),
placed as (
  select doc_id, item_id, b - a + 1 as n_words, w, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') as gap, a, b from words join dw using (doc_id)
),
spans as (
  select doc_id, item_id, n_words, (list_sum([len(x) for x in gap[1:a]]) + coalesce(list_sum([len(x) for x in w[1:a - 1]]), 0))::bigint as start_char,
    (list_sum([len(x) for x in gap[1:b]]) + list_sum([len(x) for x in w[1:b]]))::bigint as end_char from placed
)"""
ORACLE = {
    "p7_found": f"{_GRAMS} select distinct doc_id, item_id from hit",
    "p7_spans": f"{_SPANS} select doc_id, item_id, start_char, end_char, n_words from spans",
    "p7_clean": f"""{_SPANS},
far as (select *, max(end_char) over (partition by doc_id order by start_char, end_char rows between unbounded preceding and 1 preceding) as before from (select distinct doc_id, start_char, end_char from spans)),
parts as (
  select doc_id, start_char as pos, substr(text, coalesce(before, 0) + 1, greatest(start_char - coalesce(before, 0), 0)) as part from far join documents using (doc_id)
  union all select doc_id, 1e12, substr(text, max(end_char) + 1) from spans join documents using (doc_id) group by doc_id, text
),
cut as (select doc_id, string_agg(part, '' order by pos) as text from parts group by all)
select d.doc_id, coalesce(c.text, d.text) as text from documents d left join cut c using (doc_id)""",
}
