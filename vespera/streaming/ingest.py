"""Continuous ingestion: micro-batches of operations become versions of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vespera.plans import overlay
from vespera.plans.engine import Dataset


def write_batch(dataset: Dataset, batch: DataFrame, batch_id: int, order_col: str = "seq") -> None:
    """One micro-batch (id, vec, op, order): the last operation of each id is stored, and readers see all or none.

    A batch delivered again stores the same rows again, which changes nothing.
    """
    last = overlay.latest(batch, order_col).select("id", "vec", "op")
    dataset.lock.demand()
    dataset.store.apply(dataset._checked(last), bulk=False)


def ingest(dataset: Dataset, stream: DataFrame, checkpoint: str, order_col: str = "seq", available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """stream: (id, vec, op, order_col) of a streaming source."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write_batch(dataset, batch, n, order_col))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
