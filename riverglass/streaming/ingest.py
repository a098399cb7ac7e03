"""Ingestion of a stream of items into a store, a transaction for each micro-batch. An extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, *, event_time: str | None = None, late: str = "10 minutes", defer_keywords: bool = False) -> StreamingQuery:
    """Upserts each micro-batch of items (id, text, declared fields) and starts the query.

    With event_time, repeats of an id inside the watermark are dropped. A batch that is repeated after a
    failure replaces its items by themselves. With defer_keywords the index waits for sync_keywords().
    """
    if event_time:
        stream = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.drop(event_time) if event_time and event_time not in store.kinds else batch
        with store.transaction():
            if defer_keywords:
                store.defer_keywords()
            store.upsert(rows, store.embed(rows) if store.encoder else None)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
