"""Remember inputs from a stream, and event-time counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemos.sources.store import MemoryStore


def ingest_stream(rows: DataFrame, store: MemoryStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Files every micro-batch of remember inputs (see ``store.REMEMBER``). A batch that is
    repeated after a failure changes nothing: facts and edges are keyed by what they say."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: store.remember(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def written_per_window(rows: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """(window, ``keys``, n): remember inputs per window of event time; rows later than ``late`` are dropped by the watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
