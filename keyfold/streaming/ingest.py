"""Streams of operations into a store: each micro-batch is one named, idempotent write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, order: str, name: str = "ops", compact: bool = True, every_ms: int | None = None) -> StreamingQuery:
    """Start writing a stream of (key, value, op) rows, ordered by ``order`` within a batch, into ``store``.

    A batch that is replayed after a failure carries its old number and is skipped, so each row is written once. The store
    flushes by its own limit; due compactions run between batches. ``every_ms`` is the store's sync policy if not given; without either all
    that is available is taken, then the query ends.
    """
    every_ms = store.options.sync.every_ms if every_ms is None else every_ms

    def batch(df: DataFrame, number: int) -> None:
        store.write(df, order, batch=(name, number))
        store.sync()  # before the stream holds the batch for done
        if compact:
            store.compact_range()

    writer = ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every_ms is None else {"processingTime": f"{every_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def latest_per_key(ops: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The newest (order, value, op) per key of a stream, as a running aggregate (update or complete mode)."""
    from pyspark.sql import functions as F

    return ops.groupBy(key).agg(F.max(F.struct(order, "value", "op")).alias("newest")).select(key, "newest.*")
