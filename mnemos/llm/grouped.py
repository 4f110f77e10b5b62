"""Runs a function over whole groups inside Arrow batches, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounds(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


#: Rows of a task that compares groups; with more rows there are more tasks, not larger ones.
TASK_ROWS = 500_000


def over_groups(rows: DataFrame, key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType, at_least: int = 20_000, many: int = 0) -> DataFrame:
    """Shuffles ``rows`` by ``key`` (a long) and calls ``run`` with tables of whole
    groups, sorted by the key. A table holds ``at_least`` rows unless it is the
    last, and one group more at most: callers bound the size of a group. ``many``
    is the number of rows, roughly; it sets the number of tasks.
    """

    def feed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            many += b.num_rows
            if many < at_least:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column(key)
            last = keys[-1].as_py()
            # the last group may go on in the next batch; the rows are sorted by the key
            cut = int(np.searchsorted(keys.to_numpy(), last, "left"))
            if cut:
                yield from run(whole.slice(0, cut).combine_chunks())
            held = whole.slice(cut).combine_chunks().to_batches()
            many = whole.num_rows - cut
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    # the work follows the pairs in a group, not the bytes by which adaptive execution would join partitions
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // TASK_ROWS))
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(feed, schema)


def pairs_within(starts: np.ndarray, chunk: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) with a < b of the same group, about ``chunk`` of them at a time."""
    n = int(starts[-1])
    end = np.repeat(starts[1:], np.diff(starts))
    many = end - np.arange(n) - 1
    total = np.cumsum(many)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + chunk, "right")), at + 1)
        m = many[at:to]
        a = np.repeat(np.arange(at, to), m)
        yield a, a + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = to


def in_blocks(rows: DataFrame, key: str, row_id: str, most: int) -> DataFrame:
    """``rows`` with ``part``, ready for ``over_groups``: groups of more than ``most``
    rows are replaced by the pairs of their blocks (rows of part 0 and 1 are to be
    compared with each other, null: all with all). Exact, for the few groups that
    no finer key could split. ``rows`` are read three times: let them be written out."""
    names = rows.columns
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > most)
    large = sizes.select(key, F.ceil(F.col("__m") / most).cast("int").alias("__s"))
    plain = rows.select(*names, F.lit(None).cast("int").alias("part"))
    if large.isEmpty():
        return plain
    at = rows.join(large, key).withColumn("__r", F.pmod(F.xxhash64(row_id), F.col("__s")).cast("int"))
    at = at.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    part = F.when(F.col("__r") != F.col("__o"), (F.col("__r") > F.col("__o")).cast("int")).alias("part")
    new = F.xxhash64(key, F.least("__r", "__o"), F.greatest("__r", "__o")).alias(key)
    blocks = at.select(*(new if c == key else F.col(c) for c in names), part)
    return plain.join(large, key, "left_anti").select(*names, "part").unionAll(blocks)
