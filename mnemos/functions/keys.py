"""Keys of nodes: a seeded 64-bit hash of a type tag and a value, so that a fact and a topic of one text differ."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def key(tag: str, value: str, seed: int = 0) -> int:
    """As a signed number, the way it is stored."""
    h = xxhash.xxh64_intdigest(f"{tag}:{value}".encode(), seed)
    return h - 2**64 if h >= 2**63 else h


def keyed(tag: str, value: Column, seed: int = 0) -> Column:
    """The same for a column. Spark's hash is XXH64 too, but its function fixes another seed, so
    the expression is made with ours; where the JVM can't be reached a pandas UDF does it."""
    tagged = F.concat(F.lit(f"{tag}:"), value)
    try:
        jvm = SparkSession.active().sparkContext._jvm
        utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
        hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.PythonUtils.toSeq([utils.expression(tagged._jc)]), seed)
        return F.when(tagged.isNotNull(), Column(utils.column(hashed)))
    except Exception:  # noqa: BLE001 - a remote session has no JVM here
        return _keyed_in_python(tag, value, seed)


def _keyed_in_python(tag: str, value: Column, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else key(tag, v, seed)).astype("Int64")

    return run(value)
