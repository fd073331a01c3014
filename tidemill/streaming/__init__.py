"""Strategies driven by micro-batches, and event-time operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..loader import apply as apply_load
from ..spec import LoadSpec
from ..store import TableStore

#: The mark of a table that holds the number of the last batch applied.
BATCH = "stream_batch"


def load_stream(stream: DataFrame, store: TableStore, spec: LoadSpec, checkpoint: str, before: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Apply a load type to each micro-batch of a stream.

    Each batch is applied once: its number becomes current in the same step as
    its rows, so a batch that Spark delivers again after a failure is known.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number <= store.version(spec.name).marks.get(BATCH, -1):
            return
        rows = (before(batch) if before else batch).persist()
        try:
            if not rows.isEmpty():
                apply_load(store, spec, rows, date.today(), **{BATCH: number})
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], late: str, **aggregates: str) -> DataFrame:
    """Aggregates by window and keys; rows later than ``late`` behind the newest are dropped by Spark."""
    aggs = [F.expr(e).alias(n) for n, e in aggregates.items()]
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], late: str, **aggregates: str) -> DataFrame:
    aggs = [F.expr(e).alias(n) for n, e in aggregates.items()]
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggs).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggregates)
