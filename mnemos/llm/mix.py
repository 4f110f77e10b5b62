"""Mixing sources to target weights.

Method: capped water-filling. Each source is to give its share of a total; one
that would have to be repeated more often than allowed is clamped there and its
excess goes to the others in proportion, until nothing exceeds its cap. Every
document is then taken the whole number of times its source needs, and a seeded
random part of the source once more.

Sizes are tokens of a public tokenizer whose file is a parameter.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.operators.ordered import HOT_ROWS, SLICES, running
from mnemos.session import cut
from mnemos.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoder(shipped, pattern: str):
    """The encoder of a broadcast vocabulary, made once per worker process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(documents: DataFrame, text: str, *keep: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(``keep``, tokens): the size of each text; 0 for null and empty texts. The driver reads
    the file ``tokenizer`` and ships it, about a megabyte, with the job."""
    picked = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("tokens", T.LongType())])

    with open(tokenizer, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shipped, pattern)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], schema.names)

    return picked.mapInArrow(run, schema)


def feasible_total(sizes: Mapping[str, float], shares: Mapping[str, float], caps: Mapping[str, float]) -> float:
    """The largest total at which every share can be met; sources without anything to give don't count."""
    return min((sizes.get(s, 0) * caps[s] / w for s, w in shares.items() if w > 0 and sizes.get(s, 0) * caps[s] > 0), default=0.0)


def water_fill(sizes: Mapping[str, float], shares: Mapping[str, float], caps: Mapping[str, float], total: float) -> dict[str, float]:
    """How much each source gives; less than ``total`` altogether only if all are clamped."""
    most = {s: sizes.get(s, 0) * caps[s] for s in shares}
    given, free = {}, {s for s in shares if shares[s] > 0}
    while free:
        rest, weight = total - sum(given.values()), sum(shares[s] for s in free)
        over = {s for s in free if rest * shares[s] / weight > most[s]}
        given |= {s: most[s] for s in over} if over else {s: rest * shares[s] / weight for s in free}
        free = free - over if over else set()
    return {s: given.get(s, 0.0) for s in shares}


def _level(planned: DataFrame, total: float | None) -> float:
    """Water-filling over a table (s, w, most) of any number of sources: what one unit of weight
    receives. Sources that receive their ``most`` at a lower level are clamped; each round
    takes what they leave to the others, until no further source is clamped."""
    able = planned.where("w > 0 and most > 0").select("w", "most", (F.col("most") / F.col("w")).alias("limit"))
    if total is None:
        total = able.agg(F.min("limit")).first()[0] or 0.0
    level = 0.0
    while True:
        full = F.col("limit") < level
        r = able.agg(F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("w"))).alias("weight")).first()
        after = max(level, (total - (r["given"] or 0.0)) / r["weight"]) if r["weight"] else math.inf
        if after == level or after == math.inf:
            return after
        level = after


def mix(sized: DataFrame, doc_id: str, source: str, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, max_sources: int = 10_000, hot_rows: int = HOT_ROWS, slices: int = SLICES, total_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Draws documents by source. Returns two tables:

    * draw: (``doc_id``, ``source``, tokens, repeats), documents that are used, ``repeats`` times each;
    * report: a row per target source with available, planned and drawn tokens, the target
      and reached share, and the most often one of its documents is used.

    ``sized`` has ``doc_id``, ``source`` and tokens; ``targets`` has source,
    target_share and max_repeats. Up to ``max_sources`` of them are planned on the driver;
    more are planned as a table, with the same result. Without a total it is the largest at which
    all targets are met; with ``total_tokens``, or ``total_share`` of all that the caps allow,
    sources that can't give their part are clamped.

    Defined cases: rows with a null id are skipped; repeated ids count once (the
    larger size); documents of no target source, null among them, are not drawn; a
    null or negative share or cap counts as 0; a source without tokens gives
    nothing and its share goes to the others. The same seed draws the same
    documents whatever the partitioning.
    """
    spark = sized.sparkSession
    clean = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).cast("double")
    wanted = targets.where("source is not null").groupBy(F.col("source").alias("s")).agg(clean("target_share").alias("w"), clean("max_repeats").alias("cap"))
    rows = wanted.limit(max_sources + 1).collect()
    few = len(rows) <= max_sources
    wanted = F.broadcast(spark.createDataFrame(rows, wanted.schema)) if few else cut(wanted)
    docs = cut(
        sized.select(F.col(doc_id).alias("d"), F.col(source).alias("s"), F.col("tokens").cast("long").alias("n"))
        .where("d is not null and s is not null")
        .join(wanted.select("s"), "s", "left_semi")
        .groupBy("d")
        .agg(F.min("s").alias("s"), F.max(F.greatest("n", F.lit(0))).alias("n"))
    )
    sizes = docs.groupBy("s").agg(F.sum("n").cast("double").alias("size"))
    if few:
        have = {r["s"]: r["size"] or 0.0 for r in sizes.collect()}
        shares, caps = {r["s"]: r["w"] for r in rows}, {r["s"]: r["cap"] for r in rows}
        total = feasible_total(have, shares, caps) if total_tokens is None else float(total_tokens)
        if total_share is not None:
            total = total_share * sum(have.get(s, 0) * caps[s] for s in shares if shares[s] > 0)
        given = water_fill(have, shares, caps, total)
        planned = spark.createDataFrame([(s, shares[s], caps[s], have.get(s, 0.0), given[s]) for s in shares], "s string, w double, cap double, size double, given double")
    else:
        planned = wanted.join(sizes, "s", "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
        planned = cut(planned.withColumn("most", F.col("size") * F.col("cap")))
        if total_share is not None:
            total_tokens = total_share * (planned.where("w > 0").agg(F.sum("most")).first()[0] or 0.0)
        level = _level(planned, total_tokens)
        planned = planned.withColumn("given", F.when(F.col("w") > 0, F.least("most", F.col("w") * F.lit(level))).otherwise(F.lit(0.0))).drop("most")
    times = F.when(F.col("size") > 0, F.least(F.col("given") / F.col("size"), "cap")).otherwise(F.lit(0.0))
    planned = planned.withColumn("times", times).withColumns({"whole": F.floor("times").cast("int"), "part": (F.col("times") - F.floor("times")) * F.col("size")}).drop("times")
    planned = F.broadcast(planned) if few else planned
    placed = running(docs.withColumn("h", F.xxhash64(F.lit(seed), "d")), ["s"], "h", "n", (), hot_rows, slices, tie=["d"])
    extra = (F.col("__sum") - F.col("n") / 2 <= F.col("part")).cast("int")
    used = placed.join(planned, "s").withColumn("r", F.col("whole") + extra).where("r > 0")
    draw = used.select(F.col("d").alias(doc_id), F.col("s").alias(source), F.col("n").alias("tokens"), F.col("r").alias("repeats"))
    sums = used.groupBy("s").agg(F.sum(F.col("n") * F.col("r")).alias("drawn"), F.max("r").alias("most"))
    sums = cut(sums) if not few else sums
    all_drawn = F.broadcast(sums.agg(F.sum("drawn").alias("all_drawn")))
    report = planned.join(sums, "s", "left").join(all_drawn).select(
        F.col("s").alias(source),
        F.col("w").alias("target_share"),
        F.col("size").cast("long").alias("available_tokens"),
        F.col("given").alias("planned_tokens"),
        F.coalesce("drawn", F.lit(0)).alias("drawn_tokens"),
        F.coalesce(F.col("drawn") / F.col("all_drawn"), F.lit(0.0)).alias("reached_share"),
        F.coalesce("most", F.lit(0)).alias("most_repeats"),
        F.col("cap").cast("int").alias("max_repeats"),
    )
    return draw, report


def _mix(spark: SparkSession, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    sized = token_counts(table(spark, folder, "documents", "doc_id", "source", "text"), "text", "doc_id", "source")
    return mix(sized, "doc_id", "source", table(spark, folder, "mix_targets"), **how)


def p8_draw(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_clamped(spark: SparkSession, folder: str) -> DataFrame:
    """Half of all the caps allow is drawn: sources that can't give their part are clamped at their caps, the others give more."""
    return _mix(spark, folder, total_share=0.5)[1]


def p8_planned(spark: SparkSession, folder: str) -> DataFrame:
    """The same by characters, whose sizes SQL can add up: what each source is to give, how often
    its documents are used at most, and whether what was drawn is within one document of the plan."""
    docs = table(spark, folder, "documents", "doc_id", "source", "n_chars").withColumnRenamed("n_chars", "tokens")
    report = mix(docs, "doc_id", "source", table(spark, folder, "mix_targets"), total_share=0.5)[1]
    longest = docs.groupBy("source").agg(F.max("tokens").alias("longest"))
    near = F.abs(F.col("drawn_tokens") - F.col("planned_tokens")) <= F.coalesce("longest", F.lit(0))
    return report.join(longest, "source", "left").select("source", "available_tokens", F.round("planned_tokens", 2).alias("planned_tokens"), "most_repeats", near.alias("near"))


QUERIES = {"p8_draw": p8_draw, "p8_shares": p8_shares, "p8_clamped": p8_clamped, "p8_planned": p8_planned}
# the level of water-filling is found here by trying every number of clamped sources, in the order of their limits
ORACLE = {
    "p8_planned": """with
t as (select source as s, greatest(coalesce(max(target_share), 0), 0) as w, greatest(coalesce(max(max_repeats), 0), 0) as cap from mix_targets where source is not null group by all),
d as (select doc_id, min(source) as s, max(greatest(n_chars, 0)) as n from documents where doc_id is not null and source in (select s from t) group by all),
z as (select s, w, cap, coalesce((select sum(n) from d where d.s = t.s), 0)::double as size from t),
o as (select *, size * cap as most, size * cap / w as lim from z where w > 0 and size * cap > 0),
c as (select a.lim, (select coalesce(sum(most), 0) from o b where b.lim < a.lim) as given, (select sum(w) from o b where b.lim >= a.lim) as weight,
      (select coalesce(max(lim), 0) from o b where b.lim < a.lim) as below, (select 0.5 * sum(size * cap) from z where w > 0) as total from o a),
l as (select min((total - given) / weight) as level from c where (total - given) / weight between below and lim),
g as (select s, size, case when w > 0 then least(size * cap, w * level) else 0 end as given from z, l)
select s as source, size::bigint as available_tokens, round(given, 2) as planned_tokens,
  case when size = 0 or given = 0 then 0 else floor(given / size) + case when given / size - floor(given / size) > 1e-9 then 1 else 0 end end::int as most_repeats, true as near
from g"""
}
