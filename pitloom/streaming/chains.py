"""Histories kept up by a stream of late and corrected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitloom.operators.history import ChainStore


def keep_history(updates: DataFrame, store: ChainStore, checkpoint: str):
    """Applies every micro-batch of a streaming DataFrame to the store; only the chains a batch touches are rebuilt.

    The stream is known to the store by its checkpoint, so a batch that is run again after a failure is taken in once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if batch.take(1):
            store.apply(batch, checkpoint, number)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
